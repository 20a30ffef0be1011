"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share six of their eight positional bytes at least, and two of
their four byte pairs. A list of single bytes would hold a 256th of all fingerprints, so lists are split by what must be
shared anyway: under each combination of two byte pairs there are postings for the other four positional bytes. The
postings that two fingerprints share are tallied per pair; with the four bytes of the list, pairs that reach six are
retained, the rest are dropped, and what is retained is verified bit by bit. A list with more than a few dozen different
fingerprints is not paired: its members go to an index of all fingerprints one bit away, where two members meet exactly
if they differ in at most two bits, and a list has 65 members at most.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.candidates import Measure, similar_groups
from strandline.llm.common import ids_and_bytes, map_texts, written
from strandline.llm.components import components
from strandline.llm.paragraph_dedup import FLUSH_WORDS, _hash_words, _WordHashes, minhash_bands, shingle_hashes, tune_bands

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
LIST_LIMIT = 32
ROWS = 1 << 16
#: The byte pairs that make a list: two of the four.
PAIRS_OF_PAIRS = tuple(combinations(range(4), 2))


def _majority(digests: bytes, width: int) -> bytes:
    """Bits that are set in over half of the digests of ``width`` bytes each; zero without digests."""
    table = np.frombuffer(digests, dtype=np.uint8).reshape(-1, width)
    counts = np.zeros(8 * width, dtype=np.int64)
    for k in range(0, len(table), ROWS):
        counts += np.unpackbits(table[k : k + ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(table)).tobytes()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by a space; fewer words make one run, none make none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ([0, *ends[: len(words) - size].tolist()])
    return [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint_of(words: list[bytes], size: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, most significant first, of lower-cased words."""
    digest = xxhash.xxh64_digest
    return _majority(b"".join([digest(s, SEED) for s in shingles(words, size)]), 8)


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> bytes:
    return fingerprint_of((text or b"").lower().split(), size)


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (a signed long) for every row."""
    whole = lambda texts: [np.frombuffer(b"".join(fingerprint(t, size) for t in texts), dtype=">i8").astype(np.int64)]
    return map_texts(ids_and_bytes(docs), "fp long", whole)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def tallied_pairs(lists: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of members of one of the ``lists`` (list, bytes, fp) that share enough positional bytes.

    The four bytes of the list are shared by all its members; the others are counted one posting at a time.
    """
    others = F.array(*[F.array(*[F.lit(k) for k in range(8) if k // 2 not in pair]) for pair in PAIRS_OF_PAIRS])
    byte = lambda k: F.struct(k.alias("place"), F.expr("shiftrightunsigned(fp, 8 * place_)").bitwiseAND(F.lit(255)).alias("byte"))
    postings = lists.withColumn("place_", F.explode(F.get(others, F.col("list")))).select("list", "bytes", "fp", byte(F.col("place_")).alias("posting"))
    left, right = postings.withColumnRenamed("fp", "a"), postings.withColumnRenamed("fp", "b")
    shared = left.join(right, ["list", "bytes", "posting"]).filter(F.col("a") < F.col("b")).groupBy("list", "bytes", "a", "b").agg(F.count("*").alias("n"))
    return shared.filter(F.col("n") + 4 >= 8 - max_bits).select("a", "b")


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct values of ``prints.fp`` that connect all pairs with at most ``max_bits`` <= 2 differing bits."""
    if max_bits > 2:
        raise ValueError("the index guarantees two differing bits")
    masks = [_signed(sum(0xFFFF << (16 * k) for k in pair)) for pair in PAIRS_OF_PAIRS]
    keys = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    postings = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    lengths = postings.groupBy("list", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(postings.join(lengths, ["list", "bytes"]))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = tallied_pairs(met.filter(F.col("n") <= list_limit).drop("n"), max_bits).filter(close)
    crowded = met.filter(F.col("n") > list_limit).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    star = around.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    if max_bits < 2:
        star = around.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b")).filter("a < b").filter(close)
    return found.unionByName(star).distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable).

    Equal fingerprints are one node of the graph, so copies are never paired. Null and empty texts have fingerprint
    zero and link like others; a null doc_id is never a component's name unless all its ids are null; ids pass as they
    are, whatever their type; repeated rows each get their row; an empty table gives no rows; further columns are ignored.
    """
    prints = written(fingerprints(docs, size))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(close_pairs(nodes, max_bits))
    joined = nodes.join(groups, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    names = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity of word shingles ---------------------------------------------------------------------

SIMILAR_WORDS = 5
SIMILARITY = 0.8


def _text_rows(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """``docs`` as c0, c1, ... with digest (of the words), fp (the fingerprint) and keys (MinHash bands of the shingles)."""

    def made(values: list) -> list:
        known, waiting, n_words = _WordHashes(), [], 0
        digests, prints, keys = [], [], []
        for k, text in enumerate(values):
            words = (text or "").encode().lower().split()
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            prints.append(fingerprint_of(words))
            waiting.append(np.unique(shingle_hashes(_hash_words(words, known), size)) if words else np.zeros(1, dtype=np.uint64))
            n_words += len(words)
            if n_words > FLUSH_WORDS or k + 1 == len(values):
                lengths = np.array([len(x) for x in waiting])
                keys += list(minhash_bands(np.concatenate(waiting), np.cumsum(lengths) - lengths, bands, rows))
                waiting, n_words = [], 0
        return [digests, np.frombuffer(b"".join(prints), dtype=">i8").astype(np.int64), keys]

    renamed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    both = renamed.withColumn("text", F.col(text))
    return map_texts(both, "digest binary, fp long, keys array<long>", made)


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """node, hashes of texts (node, text)."""

    def made(values: list) -> list:
        known = _WordHashes()
        words = [(t or b"").lower().split() for t in values]
        return [[np.unique(shingle_hashes(_hash_words(w, known), size)).view(np.int64) if w else [] for w in words]]

    return map_texts(texts, "hashes array<long>", made)


def _print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) with equal fingerprints or fingerprints that the index links: each to the least node there."""
    least = written(prints.groupBy("fp").agg(F.min("node").alias("least")))
    equal = prints.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = close_pairs(least.select("fp"))
    ends = [least.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}")) for side in "ab"]
    linked = close.join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return equal.unionByName(linked)


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIMILAR_WORDS) -> DataFrame:
    """``docs`` with one document of each group of exact and near copies: the smallest doc_id, null ids last.

    Texts with equal words (ignoring ASCII case and spacing) are exact copies. Near copies are texts whose sets of
    ``size``-word shingles have a cosine of ``similarity``, the measure that SimHash stands for; for sets of one size
    that is a Jaccard similarity of similarity / (2 - similarity). Candidates come from the SimHash index and, as its
    two bits guarantee nothing at that distance, from MinHash bands tuned for the least Jaccard similarity that the
    measure allows, whatever the lengths; all are verified exactly. Null and empty texts are copies of each other. Of
    repeated rows one stays. An empty table gives no rows; all columns are kept.
    """
    measure = Measure(similarity, cosine=True)
    names = {f"c{k}": name for k, name in enumerate(docs.columns)}
    text, doc_id = (next(k for k, name in names.items() if name == wanted) for wanted in ("text", "doc_id"))
    rows = written(_text_rows(docs, *tune_bands(measure.share), size).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("id"), F.col("row")))
    nodes = written(rows.groupBy("digest").agg(first.alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    nodes = nodes.select(F.col("first.row").alias("node"), "first", "fp", "keys")  # a text's node is named by its first row

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = rows.select(F.col("row").alias("node"), F.col(text).cast("binary").alias("text"))
        return _shingle_sets(texts.join(wanted, "node"), size)

    groups = similar_groups(nodes.select("node", "keys"), sets_of, measure, more=_print_pairs(nodes.select("node", "fp"))).withColumnRenamed("node", "grouped")
    named = nodes.join(groups, F.col("node") == F.col("grouped"), "left").select("first", F.coalesce("component", "node").alias("component"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(stay, "row", "left_semi").select(*[F.col(c).alias(name) for c, name in names.items()])
