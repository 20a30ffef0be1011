"""Benchmark decontamination by BM25 retrieval with block-max WAND.

Test items are the indexed collection, training passages are the queries. Each item is indexed in units of at most
64 words; a unit's term impacts are BM25 weights divided by its score against itself, so that a score says which share
of the unit a passage holds. Units lie in blocks, and each term has its largest impact over all units and in each block
that has it. A passage is scored only where the sum of block maxima can reach the threshold; there, the posting lists
are walked from pivot to pivot. What is retrieved is verified by the share of its word 5-grams that stand in the
document around the passage: those of the item, of the unit, of the question and of the answer.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import keep_rows, written

K1, B = 1.2, 0.75
UNIT_WORDS = 64
CHUNK_WORDS = 32
PASSAGE_CHUNKS = 3
BLOCK_UNITS = 4
RETRIEVE = 0.6
OVERLAP = 0.8
NGRAM = 5
#: Words from which a question counts by itself, without its answer, and a unit without the rest of its item.
ENOUGH_WORDS = 13
#: Largest part of the benchmark that is broadcast at once, in bytes of text; a larger one is worked off part by part.
SHARD_BYTES = 8 << 20
#: A term in more blocks than this, and than a sixteenth of all, is bounded by its largest impact anywhere.
WIDE_BLOCKS = 64
#: Sums and block maxima that a task holds at once.
SLICE_CELLS = 1 << 20

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_KEEP).split()


def units_of(text: str | None) -> list[list[bytes]]:
    """The words in as few pieces of equal length as hold at most UNIT_WORDS each."""
    words = terms_of(text)
    length = math.ceil(len(words) / max(1, math.ceil(len(words) / UNIT_WORDS)))
    return [words[k : k + length] for k in range(0, len(words), length or 1)]


def _hashed_runs(words: list[bytes], n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)], dtype=np.uint64)


def _ngrams(words: list[bytes]) -> tuple[int, np.ndarray]:
    """Length and distinct hashes of the n-grams; fewer words than NGRAM make one, none make none."""
    n = min(NGRAM, len(words))
    return n, np.unique(_hashed_runs(words, n)) if n else np.empty(0, dtype=np.uint64)


class Index:
    """Inverted index over the units of some items, with document frequencies of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n_units: int, mean_length: float) -> None:
        #: (item_id, words, words of the question, n-grams of the item, the question and the answer)
        self.items: list[tuple] = []
        #: (item, words, n-grams)
        self.units: list[tuple] = []
        self.vocabulary: dict[bytes, int] = {}
        self.postings: list[tuple[array, array]] = []
        for item_id, text in items:
            # The answer is the last line of several.
            lines = [x for x in (text or "").split("\n") if terms_of(x)]
            question, answer = ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (text, "")
            parts = [terms_of(x) for x in (text, question, answer)]
            self.items.append((item_id, len(parts[0]), len(parts[1]), *map(_ngrams, parts)))
            for words in units_of(text):
                norm = K1 * (1 - B + B * len(words) / mean_length)
                weight = {}
                for word, tf in Counter(words).items():
                    idf = math.log(1 + (n_units - frequency[word] + 0.5) / (frequency[word] + 0.5))
                    weight[self.vocabulary.setdefault(word, len(self.vocabulary))] = idf * tf * (K1 + 1) / (tf + norm)
                whole = sum(weight.values())
                self.postings += [(array("q"), array("d")) for _ in range(len(self.vocabulary) - len(self.postings))]
                for t, w in weight.items():
                    self.postings[t][0].append(len(self.units))
                    self.postings[t][1].append(w / whole)
                self.units.append((len(self.items) - 1, len(words), _ngrams(words)))
        self._bound()

    def _bound(self) -> None:
        """Per term its blocks and the largest impact in each, one term after another; terms in too many have one bound."""
        n_blocks = max(1, math.ceil(len(self.units) / BLOCK_UNITS))
        blocks, maxima, self.reach = [], [], [0]
        for units, weights in self.postings:
            block = np.frombuffer(units, dtype=np.int64) // BLOCK_UNITS
            first = np.flatnonzero(np.diff(block, prepend=-1))
            blocks.append(block[first])
            maxima.append(np.maximum.reduceat(np.frombuffer(weights, dtype=float), first))
            self.reach.append(self.reach[-1] + len(first))
        self.term_max = [float(m.max()) for m in maxima]
        self.of_term = [(array("q", b), array("d", m)) for b, m in zip(blocks, maxima, strict=True)]
        self.block, self.block_max = (np.concatenate([*x, np.empty(0, dtype=kind)]) for x, kind in ((blocks, np.int64), (maxima, float)))
        self.reach = np.array(self.reach, dtype=np.int64)
        self.n_blocks = n_blocks
        self.wide = np.diff(self.reach) > max(WIDE_BLOCKS, n_blocks / 16)
        # One more entry for words that are in no item.
        self.wide_max = np.append(np.where(self.wide, self.term_max, 0.0), 0.0)
        self.narrow = np.append(np.where(self.wide, 0, np.diff(self.reach)), 0)

    def _in_block(self, term: int, block: int) -> float:
        blocks, maxima = self.of_term[term]
        at = bisect_left(blocks, block)
        return maxima[at] if at < len(blocks) and blocks[at] == block else 0.0

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Units whose score against the distinct ``terms`` reaches ``threshold``: block-max WAND."""
        lists = [(self.postings[t][0], self.postings[t][1], self.term_max[t], t) for t in terms]
        threshold -= 1e-12
        cursors = [[units[0], 0, k] for k, (units, _, _, _) in enumerate(lists)]
        found = []

        def advance(cursor: list, to: int) -> bool:
            units = lists[cursor[2]][0]
            cursor[1] = bisect_left(units, to, cursor[1])
            if cursor[1] == len(units):
                return False
            cursor[0] = units[cursor[1]]
            return True

        while cursors:
            cursors.sort()
            bound, p = 0.0, -1
            for k, cursor in enumerate(cursors):
                bound += lists[cursor[2]][2]
                if bound >= threshold:
                    p = k
                    break
            if p < 0:
                break
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            head, block = cursors[: p + 1], pivot // BLOCK_UNITS
            if sum(self._in_block(lists[c[2]][3], block) for c in head) < threshold:
                to = min((block + 1) * BLOCK_UNITS, cursors[p + 1][0] if p + 1 < len(cursors) else 1 << 62)
                to = max(to, pivot + 1)
            elif head[0][0] == pivot:
                score = sum(lists[c[2]][1][c[1]] for c in head)
                if score >= threshold:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            cursors = [c for c in head if c[0] >= to or advance(c, to)] + cursors[p + 1 :]
        return found

    def verify(self, unit: int, words: list[bytes]) -> tuple[float, float, float, float]:
        """Shares of the item's, the unit's, the question's and the answer's n-grams among ``words``; an empty answer counts as present."""
        item, _, own = self.units[unit]
        whole, question, answer = self.items[item][3:]
        there = {n: _hashed_runs(words, n) for n in {n for n, _ in (whole, own, question, answer) if n}}
        return tuple(float(np.isin(grams, there[n]).mean()) if n else 1.0 for n, grams in (whole, own, question, answer))

    def holds(self, unit: int, shares: tuple[float, float, float, float], overlap: float) -> bool:
        """Whether a document with such shares holds the item, a whole unit of it, or its question."""
        whole, own, question, answer = shares
        item, n_words, _ = self.units[unit]
        asked = question if answer >= 0.5 or self.items[item][2] >= ENOUGH_WORDS else 0.0
        return max(whole, own if n_words >= ENOUGH_WORDS else 0.0, asked) >= overlap

    def scan(self, texts: list[str | None], retrieve: float, overlap: float) -> dict[int, dict[int, tuple]]:
        """For each text with verified items: item -> (score, overlap, passage, question and answer overlap), the largest of each."""
        out: dict[int, dict[int, tuple]] = {}
        waiting: list[tuple[int, list[bytes], np.ndarray]] = []
        none, size = len(self.vocabulary), 0
        for k, text in enumerate(texts):
            words = terms_of(text)
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(none)), dtype=np.int64, count=len(words))
            waiting.append((k, words, ids))
            size += (len(words) // CHUNK_WORDS + PASSAGE_CHUNKS) * self.n_blocks + int(self.narrow[ids].sum())
            if size >= SLICE_CELLS:
                self._scan(waiting, retrieve, overlap, out)
                waiting, size = [], 0
        self._scan(waiting, retrieve, overlap, out)
        return out

    def _passages(self, ids: list[np.ndarray], starts: np.ndarray, retrieve: float) -> np.ndarray:
        """First chunks of the passages whose bound reaches the threshold in some block."""
        none, n_chunks = len(self.vocabulary), int(starts[-1]) + PASSAGE_CHUNKS
        chunk = np.concatenate([starts[d] + np.arange(len(x)) // CHUNK_WORDS for d, x in enumerate(ids)])
        term = np.concatenate(ids)
        in_chunk, of_term = np.divmod(np.unique((chunk * (none + 1) + term)[term < none]), none + 1)
        wide = np.bincount(in_chunk, weights=self.wide_max[of_term], minlength=n_chunks)
        anywhere = sum(wide[k : n_chunks - PASSAGE_CHUNKS + 1 + k] for k in range(PASSAGE_CHUNKS))
        times = self.narrow[of_term]
        # For each narrow term of a chunk its blocks and their maxima, summed per chunk and block, then per passage.
        times = self.narrow[of_term]
        entry = np.repeat(self.reach[of_term] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        cell = np.repeat(in_chunk, times) * self.n_blocks + self.block[entry]
        bound = np.bincount(cell, weights=self.block_max[entry], minlength=n_chunks * self.n_blocks).reshape(n_chunks, self.n_blocks)
        passage = sum(bound[k : n_chunks - PASSAGE_CHUNKS + 1 + k] for k in range(PASSAGE_CHUNKS))
        return np.flatnonzero(passage.max(axis=1) + anywhere >= retrieve - 1e-6)

    def _scan(self, documents: list[tuple[int, list[bytes], np.ndarray]], retrieve: float, overlap: float, out: dict) -> None:
        none = len(self.vocabulary)
        ids = [x for _, _, x in documents]
        # Empty chunks behind each document keep passages from running into the next one.
        starts = np.concatenate([[0], np.cumsum([-(-len(x) // CHUNK_WORDS) + PASSAGE_CHUNKS - 1 for x in ids])]).astype(np.int64)
        if not sum(map(len, ids)):
            return
        for c in self._passages(ids, starts, retrieve).tolist():
            if c >= starts[-1]:
                continue
            d = int(np.searchsorted(starts, c, side="right")) - 1
            at = int(c - starts[d]) * CHUNK_WORDS
            there = np.unique(ids[d][at : at + PASSAGE_CHUNKS * CHUNK_WORDS])
            document, words, _ = documents[d]
            for unit, score in self.retrieve([int(t) for t in there if t < none], retrieve):
                item = self.units[unit][0]
                reach = self.items[item][1] + PASSAGE_CHUNKS * CHUNK_WORDS
                shares = self.verify(unit, words[max(0, at - reach) : at + PASSAGE_CHUNKS * CHUNK_WORDS + reach])
                if self.holds(unit, shares, overlap):
                    known = out.setdefault(document, {}).get(item, (0.0,) * 5)
                    out[document][item] = tuple(map(max, (score, *shares), known))


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes over parts of the benchmark of about ``shard_bytes`` of text each; statistics are of the whole benchmark.

    Items without words are in no index; items with a null id are indexed under null.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = items.sparkSession

    def unit_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [u for text in batch["text"] for u in units_of(text)]
            if units:
                yield pd.DataFrame({"term": [t for u in units for t in {*u, b""}], "words": [len(u) * (t == b"") for u in units for t in {*u, b""}]})

    # The empty term counts all units and their words.
    frequency = written(items.mapInPandas(unit_terms, "term binary, words long").groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words")))
    total = frequency.filter(F.octet_length("term") == 0).first()
    if total is None:
        return
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n_shards = max(1, math.ceil(size / shard_bytes))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards))
    for k in range(n_shards):
        rows = sorted(((r.item_id, r.text) for r in items.filter(shard == k).collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))
        own = sorted({t for _, text in rows for t in terms_of(text)})
        if not own:
            continue
        wanted = spark.createDataFrame([(bytearray(t),) for t in own], "term binary")
        known = {bytes(r.term): r.n for r in frequency.join(wanted, "term", "left_semi").collect()}
        yield Index([r for r in rows if terms_of(r[1])], known, total.n, total.words / total.n)


MEASURES = ("score", "overlap", "passage_overlap", "question_overlap", "answer_overlap")


def find_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, and the shares of the item's, the found unit's, the question's and the answer's n-grams.

    Every passage of every whole text is queried. Null and empty texts have no passages; repeated rows each get their
    rows; ids of any kind and null ids pass as they are; an empty table on either side gives no rows; further columns
    are ignored.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *(T.StructField(m, T.DoubleType()) for m in MEASURES)])
    found = None
    for index in indexes(benchmark):
        shared = context.broadcast(index)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            item_type = to_arrow_type(schema["item_id"].dataType)
            for batch in batches:
                hits = shared.value.scan(batch.column("text").to_pylist(), retrieve, overlap)
                rows = [(d, shared.value.items[i][0], *v) for d, per_item in hits.items() for i, v in per_item.items()]
                if rows:
                    at, items, *measures = zip(*rows, strict=True)
                    columns = [batch.column("doc_id").take(pa.array(at)), pa.array(items, item_type), *(pa.array(m, pa.float64()) for m in measures)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def remove_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the documents that hold a test item, in one pass over them for each part of the benchmark."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(texts: list, shared=shared) -> list:
            hits = shared.value.scan(texts, retrieve, overlap)
            return [d not in hits for d in range(len(texts))]

        docs = keep_rows(docs, clean)
    return docs
