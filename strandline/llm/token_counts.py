"""Token counts of whole texts without making token ids per document.

A text falls into pre-tokens that are encoded independently of each other. The pre-tokens of the whole corpus are
counted, each distinct one is encoded once, and a document's count is the sum of its pre-token frequencies times their
piece counts. The most frequent pre-tokens, a bounded number, are looked up inside the task; the rest is joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_texts, written

HEAD = 1 << 18
FLUSH = 400_000
LIMIT = 1024

#: Texts of these characters only are split by the pattern below, others by the library's own splitter: letters,
#: numbers and white space of other scripts differ between versions of Unicode.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*\Z")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: The public byte-level pre-token pattern over those characters.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


class Pieces:
    """Splitting and counting with one tokenizer file: .json by tokenizers, .model by sentencepiece.

    A .model, and a .json without a pre-tokenizer or with special strings that take in their surroundings, has no
    pre-tokens that are independent of each other: ``splits`` is false, and texts are counted whole.
    """

    def __init__(self, path: str) -> None:
        self.special: list[str] = []
        self.byte_level = self.splits = False
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        config = json.loads(tokenizer.to_str())
        before = config["pre_tokenizer"] or {}
        self.byte_level = config["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and config["normalizer"] for t in config["added_tokens"])
        self.byte_level, self.splits = self.byte_level and plain, bool(before) and plain
        self.special = [t["content"] for t in config["added_tokens"]]
        self.normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.library_split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else None
        self.count = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.whole = self.count
        if self.splits and not self.byte_level:
            named = set(self.special)
            self.count = lambda pieces: [1 if p in named else len(tokenizer.model.tokenize(p)) for p in pieces]

    def split(self, text: str) -> list[str]:
        """The pre-tokens; a special token's string is one of its own."""
        if any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.split(part))]
        if not self.byte_level:
            return [piece for piece, _ in self.library_split(self.normal(text))]
        if PLAIN.match(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library_split(text)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _most_frequent(vocabulary: DataFrame, head: int) -> DataFrame:
    """At most ``head`` rows with the largest n: whole classes of similar n, found from a count per class.

    An ordered limit would send that many rows of every partition to the driver; the classes are about a thousand numbers.
    """
    vocabulary = vocabulary.withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    least, total = None, 0
    for row in sorted(vocabulary.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        total += row["count"]
        if total > head:
            break
        least = row["class"]
    return vocabulary.filter(F.lit(False) if least is None else F.col("class") >= least).drop("class")


def count_tokens(docs: DataFrame, tokenizer: str, head: int = HEAD, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens above ``limit``).

    ``tokenizer`` is the path of a tokenizer file that every executor has. Null counts as empty: 0 bytes, 0 tokens.
    Repeated rows each get their row, ids of any kind and nulls pass as they are, an empty table gives no rows, further
    columns are ignored. At most ``head`` pre-tokens are held by a task, the rest is joined, with the same result for
    any ``head``. A tokenizer without independent pre-tokens counts whole texts, without a shuffle.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(pieces(tokenizer).split(text))
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"piece": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"piece": list(seen.keys()), "n": list(seen.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=pieces(tokenizer).count(batch["piece"].tolist()))

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not pieces(tokenizer).splits:
        counts = map_texts(texts, "n_bytes long, n_tokens long", lambda values: [[len(t.encode()) for t in values], pieces(tokenizer).whole(values)])
        return counts.withColumn("over_limit", F.col("n_tokens") > limit)
    counted = texts.select("text").mapInPandas(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = written(counted.mapInPandas(encode, "piece string, n long, tokens long"))
    top = _most_frequent(vocabulary, head)
    known = docs.sparkSession.sparkContext.broadcast({r.piece: r.tokens for r in top.select("piece", "tokens").collect()})

    def sums(values: list) -> list:
        cost = known.value
        n_tokens, rest = [], []
        for text in values:
            frequency = Counter(pieces(tokenizer).split(text))
            n_tokens.append(sum(n * cost.get(p, 0) for p, n in frequency.items()))
            rest.append([{"piece": p, "n": n} for p, n in frequency.items() if p not in cost])
        return [[len(t.encode()) for t in values], n_tokens, rest]

    summed = map_texts(texts, "n_bytes long, head_tokens long, rest array<struct<piece:string,n:long>>", sums)
    summed = written(summed.withColumn("row", F.monotonically_increasing_id()))
    rest = summed.select("row", F.explode("rest").alias("p")).select("row", "p.piece", F.col("p.n").alias("times"))
    rest_tokens = rest.join(vocabulary.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("rest_tokens"))
    n_tokens = F.col("head_tokens") + F.coalesce("rest_tokens", F.lit(0))
    return summed.join(rest_tokens, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
