"""Substring deduplication of paragraphs by MinHash banding.

A paragraph is a line with enough words, or short lines in a row that have enough together. Equal paragraphs (by words,
ignoring case and spacing) are one node. Each node has MinHash values over its 5-word shingles, in bands tuned for high
recall at the wanted similarity; nodes that collide in a band are compared by the exact Jaccard similarity of their
shingles, and the similar ones are joined into components. The first occurrence of a component stays, the others are
removals.

Passages that repeat word by word inside longer lines, or over several lines, are found by segments that the words
themselves choose, whatever stands around them: of the segments of 26 words that begin in any stretch of 50 words, the
one with the least hash. Two texts that share 50 words in a row thus share a segment, and neighbouring segments of a
passage leave no word between them out. Segments that occur again are joined into spans. All of this takes one pass over
the texts; only candidates for similar paragraphs are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.candidates import Measure, similar_edges
from strandline.llm.common import discard, map_texts, written
from strandline.llm.components import components

#: Every passage of so many words that occurs twice, word by word, is found wherever it stands.
RUN_WORDS = 50
SEGMENT_WORDS = 26
SHINGLE_WORDS = 5
SIMILARITY = 0.8
MIN_WORDS = 25
RECALL = 0.99
#: Chance to collide that is tolerated at a third of the similarity.
CHANCE = 0.1
#: Words whose hashes a task holds at once.
FLUSH_WORDS = 1 << 17


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """(bands, rows) with the fewest values that find ``similarity`` with ``recall`` and a third of it with ``chance`` at most."""
    best = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))
        if 1 - (1 - (similarity / 3) ** rows) ** bands <= chance and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word runs of a paragraph, from its words' hashes; a shorter paragraph is one run."""
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = _mix(total + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return total


def minhash_bands(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (paragraph, band): ``hashes`` lie one paragraph after another, each beginning at its entry of ``starts``.

    A key mixes the least values of a band's hashes under odd multipliers and shifts.
    """
    seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor, shift = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for r in range(rows):
            j = band * rows + r
            key = _mix(key ^ np.minimum.reduceat(hashes * factor[j] + shift[j], starts)) + np.uint64(r)
        keys[:, band] = key
    return keys.view(np.int64)


def _all_shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes() of many paragraphs at once: their hashes one after another, and where each paragraph begins."""
    ends = np.cumsum(lengths)
    if lengths.min() < size:
        parts = [shingle_hashes(words[b - n : b], size) for b, n in zip(ends, lengths, strict=True)]
        counts = np.array([len(x) for x in parts])
        return np.concatenate(parts), np.cumsum(counts) - counts
    counts = lengths - size + 1
    inside = np.arange(len(words)) + size <= np.repeat(ends, lengths)
    return shingle_hashes(words, size)[inside[: len(words) - size + 1]], np.cumsum(counts) - counts


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hash_words(words: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


# --- segments that the words choose ---------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, the first of equal ones, in every stretch of ``width`` values."""
    at, reach = np.arange(len(values)), 1
    pick = lambda a, b: np.where(values[b] < values[a], b, a)
    while 2 * reach <= width:
        at, reach = pick(at[:-reach], at[reach:]), 2 * reach
    return pick(at[: len(at) - (width - reach)], at[width - reach :]) if reach < width else at


def chosen_segments(words: np.ndarray, lengths: np.ndarray, size: int = RUN_WORDS, segment: int = SEGMENT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of the chosen segments of many texts, whose words' hashes lie one text after another."""
    n, ends = len(words), np.cumsum(lengths)
    none = np.empty(0, dtype=np.int64)
    if n < size:
        return none, none, none
    powers = np.cumprod(np.full(n, BASE))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    back = np.cumprod(np.full(n, BASE_INVERSE))
    hashes = _mix((sums[segment:] - sums[:-segment]) * back[: n - segment + 1])
    text = np.repeat(np.arange(len(lengths)), lengths)
    window = np.flatnonzero(np.arange(n - size + 1) + size <= ends[text[: n - size + 1]])
    at = np.unique(_least_at(hashes, size - segment + 1)[window])
    return text[at], at - (ends - lengths)[text[at]], hashes[at].view(np.int64)


# --- one pass over the texts ----------------------------------------------------------------------------------------

ANALYSED = "digest binary, n_words long, line int, p_line array<int>, p_start array<int>, p_end array<int>, p_node array<binary>, p_keys array<long>, s_key array<long>, s_at array<int>"


def _paragraph_lines(lengths: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(first, last) line of each paragraph: lines of ``least`` words, and short ones in a row that have as many together."""
    first, held = 0, 0
    for k, n in enumerate(lengths):
        if n >= least:
            yield k, k
            first, held = k + 1, 0
        else:
            first = k if not held else first
            held += n
            if held >= least:
                yield first, k
                first, held = k + 1, 0


def analyse(docs: DataFrame, bands: int, rows: int, size: int = SHINGLE_WORDS, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """One written row per document with words: row, doc_id, text_hash, digest (of the words), its paragraphs (p_*) and chosen segments (s_*)."""

    def flush(texts: list[list[list[bytes]]], known: _WordHashes) -> list[list]:
        flat = [[w for line in lines for w in line] for lines in texts]
        hashes = _hash_words([w for words in flat for w in words], known)
        lengths = np.array([len(words) for words in flat], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        out: list[list] = [[xxhash.xxh3_128_digest(b" ".join(words)) for words in flat], lengths.tolist(), []]
        places, found, of_text = [], [], []
        for k, lines in enumerate(texts):
            counts = [len(x) for x in lines]
            ends = np.cumsum(counts).tolist()
            out[2].append(next((i for i, c in enumerate(counts) if c), 0))
            for a, b in _paragraph_lines(counts, max(1, min_words)):
                start, end = ends[a] - counts[a], ends[b]
                places.append((a, start, end, xxhash.xxh3_128_digest(b" ".join(flat[k][start:end]))))
                found.append(hashes[begins[k] + start : begins[k] + end])
                of_text.append(k)
        cuts = np.searchsorted(of_text, np.arange(len(texts) + 1)).tolist()
        keys = minhash_bands(*_all_shingles(np.concatenate(found), np.array([len(x) for x in found]), size), bands, rows) if found else np.empty((0, bands), dtype=np.int64)
        for c in range(4):
            out.append([[p[c] for p in places[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        out.append([keys[a:b].ravel() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        text, at, key = chosen_segments(hashes, lengths, run_words)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        out += [[key[a:b] for a, b in parts], [at[a:b].astype(np.int32) for a, b in parts]]
        return out

    def compute(values: list) -> list:
        known, waiting, size_waiting = _WordHashes(), [], 0
        columns: list[list] = [[] for _ in ANALYSED.split(", ")]
        for text in [*values, None]:
            if text is not None:
                lines = [line.split() for line in text.lower().split(b"\n")]
                waiting.append(lines)
                size_waiting += sum(map(len, lines))
            if waiting and (size_waiting > FLUSH_WORDS or text is None):
                for column, part in zip(columns, flush(waiting, known), strict=True):
                    column += part
                waiting, size_waiting = [], 0
        return columns

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(map_texts(texts.withColumn("row", F.monotonically_increasing_id()), ANALYSED, compute).filter("n_words > 0"))


# --- segments that occur again --------------------------------------------------------------------------------------


def _unknown() -> Column:
    return F.col("doc_id").isNull().alias("unknown")


def _segment_spans(texts: DataFrame, copies: DataFrame, run_words: int = RUN_WORDS, segment: int = SEGMENT_WORDS) -> DataFrame:
    """Chains of segments that occur before: row, start, end, first_row, cluster, shift, last_shift, same_end.

    ``shift`` is how far the chain's first segment stands from its first occurrence, ``last_shift`` its last one; up to
    ``same_end`` all stand as the first. In another text than that of the first occurrences a chain has one shift. A
    cluster is a chain of first occurrences. In one text, what is nearer than ``run_words`` to its first occurrence does
    not count. Of texts of equal words only the first takes part.
    """
    distinct = texts.filter(F.size("s_key") > 0).select("row", "s_key", "s_at").join(copies.select("first_row"), F.col("row") == F.col("first_row"), "left_semi")
    postings = distinct.select("row", F.inline(F.arrays_zip("s_key", "s_at"))).toDF("row", "key", "at")
    again = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = written(postings.join(again, "key").join(texts.select("row", "doc_id"), "row"))
    firsts = met.groupBy("key").agg(F.min(F.struct(_unknown(), "doc_id", "row", "at")).alias("first"))
    firsts = firsts.select("key", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))
    along = Window.partitionBy("first_row").orderBy("first_at")
    begins = F.coalesce(F.col("first_at") - F.lag("first_at").over(along) > segment, F.lit(True))
    clusters = firsts.withColumn("cluster", F.last(F.when(begins, F.col("key")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = met.drop("doc_id").join(clusters, "key").withColumn("shift", F.col("at") - F.col("first_at"))
    own = F.col("row") == F.col("first_row")
    found = found.filter(~own | (F.col("shift") >= run_words)).withColumn("lane", F.when(~own, F.col("shift")))
    lane = Window.partitionBy("row", "cluster", "first_row", "lane").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(lane) > segment, F.lit(True))
    chained = found.withColumn("new", new).withColumns({
        "chain": F.sum(F.col("new").cast("int")).over(lane.rowsBetween(Window.unboundedPreceding, 0)),
        "begins_with": F.last(F.when(F.col("new"), F.col("shift")), ignorenulls=True).over(lane.rowsBetween(Window.unboundedPreceding, 0)),
    })
    spans = chained.groupBy("row", "cluster", "first_row", "lane", "chain", F.col("begins_with").alias("shift")).agg(
        F.min("at").alias("start"), (F.max("at") + segment).alias("end"), F.max(F.struct("at", "shift"))["shift"].alias("last_shift"), (F.max(F.when(F.col("shift") == F.col("begins_with"), F.col("at"))) + segment).alias("same_end"),
    )
    return written(spans.drop("lane", "chain"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def _passages(texts: DataFrame, copies: DataFrame, spans: DataFrame, around: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Passages of ``run_words`` words that occur again: row, line, start, end, cluster, first_doc_id, first_line, occurrences, removed.

    ``around`` has the surroundings (left, lines, right, after) of places (at_row, at_start, at_end, at_same): of the
    ``spans`` and of where they stand first. Spans are prolonged as far as both agree; what overlaps is one passage. The first
    occurrence of a passage in its own text ends where the second begins. Texts of equal words are passages as a whole.
    """
    here, there = (around.toDF(*[f"{c}{k}" for c in around.columns]) for k in (0, 1))
    at = lambda k, *place: [F.col(f"{name}{k}") == c for name, c in zip(("at_row", "at_start", "at_end", "at_same"), place, strict=True)]
    first = [F.col("first_row"), F.col("start") - F.col("shift"), F.col("end") - F.col("last_shift"), F.col("same_end") - F.col("shift")]
    joined = spans.join(here, at(0, *[F.col(c) for c in ("row", "start", "end", "same_end")])).join(there, at(1, *first))
    agree = {name: _agreeing(F.col(f"{side}0"), F.col(f"{side}1")) for name, side in (("l", "left"), ("r", "right"), ("m", "after"))}
    both = joined.withColumns(agree)
    both = both.withColumns({"start": F.col("start") - F.col("l"), "end": F.col("end") + F.col("r"), "same_end": F.col("same_end") + F.col("m")}).filter(F.col("end") - F.col("start") >= run_words)
    line = lambda k: F.get(f"lines{k}", F.col("l")).alias("line")
    first_end = F.col("same_end") - F.col("shift")
    second = F.min("start").over(Window.partitionBy("row", "cluster", "first_row"))
    first_end = F.when(F.col("row") == F.col("first_row"), F.least(first_end, second)).otherwise(first_end)
    copied = both.select("row", "cluster", "first_row", F.lit(True).alias("removed"), "start", "end", line(0))
    original = both.select(F.col("first_row").alias("row"), "cluster", "first_row", F.lit(False).alias("removed"), (F.col("start") - F.col("shift")).alias("start"), first_end.alias("end"), line(1))
    lane = Window.partitionBy("row", "cluster", "first_row", "removed").orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    merged = copied.unionByName(original).distinct().withColumn("new", new).withColumn("part", F.sum("new").over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("row", "cluster", "first_row", "removed", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("line").alias("line"))
    merged = written(merged.withColumn("cluster", F.lower(F.lpad(F.hex("cluster"), 16, "0"))))
    named = merged.groupBy("cluster").agg(F.count("*").alias("occurrences"), F.min(F.when(~F.col("removed"), F.struct("start", "line")))["line"].alias("first_line"))
    ids = texts.select(F.col("row").alias("first_row"), F.col("doc_id").alias("first_doc_id"))
    order = ["row", "line", "start", "end", "cluster", "first_doc_id", "first_line", "occurrences", "removed"]
    parts = merged.join(named, "cluster").join(ids, "first_row").select(order)
    whole = texts.filter(F.col("n_words") >= MIN_WORDS).select("row", "digest", "line", "n_words").join(copies.filter("occurrences > 1"), "digest")
    whole = whole.withColumns({"start": F.lit(0), "end": F.col("n_words").cast("int"), "cluster": F.lower(F.hex("digest")), "removed": F.col("row") != F.col("first_row")})
    return whole.select(order).unionByName(parts)


def _not_in_lines(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """The ``runs`` of clusters of which some span has words in no row of ``lines``."""
    of_text = lines.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("lines"))
    both = runs.join(of_text, "row", "left")
    reach = lambda at, line: F.when((line["start"] <= at) & (line["end"] > at), line["end"]).otherwise(at)
    bare = F.coalesce(F.aggregate("lines", F.col("start"), reach), F.col("start")) < F.col("end")
    return runs.join(both.filter(bare).select("cluster").distinct(), "cluster", "left_semi")


# --- similar paragraphs ---------------------------------------------------------------------------------------------


READ = "node array<long>, hashes array<array<long>>, at_row array<long>, at_start array<int>, at_end array<int>, at_same array<int>, left array<array<long>>, lines array<array<int>>, right array<array<long>>, after array<array<long>>"


def _read_again(docs: DataFrame, texts: DataFrame, places: DataFrame, asks: DataFrame, size: int, reach: int = SEGMENT_WORDS) -> DataFrame:
    """One row per text with something asked for, as arrays.

    node, hashes: the sorted shingle hashes of the ``places`` (doc_id, text_hash, node, start, end). at_row, at_start,
    at_end, at_same, left, lines, right, after: for the ``asks`` (doc_id, text_hash, row, start, end, same_end) the hashes
    of the words before the start, nearest first, and after the two ends; ``lines`` has the line of the first word and of
    those before.
    ``twin`` tells that the text stands in several rows of one id.
    """

    def compute(rows: list) -> list:
        known = _WordHashes()
        out: list[list] = [[] for _ in range(10)]
        for row in rows:
            lines = [line.split() for line in row["text"].lower().split(b"\n")]
            hashes = _hash_words([w for line in lines for w in line], known)
            line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            places, asks = row["places"] or [], row["asks"] or []
            before = [slice(max(0, a["start"] - reach), a["start"]) for a in asks]
            made = (
                [p["node"] for p in places],
                [np.unique(shingle_hashes(hashes[p["start"] : p["end"]], size)).view(np.int64) for p in places],
                *([a[name] for a in asks] for name in ("row", "start", "end", "same_end")),
                [hashes[b].view(np.int64)[::-1] for b in before],
                [line[b.start : a["start"] + 1][::-1].astype(np.int32) for a, b in zip(asks, before, strict=True)],
                *([hashes[a[end] : a[end] + reach].view(np.int64) for a in asks] for end in ("end", "same_end")),
            )
            for column, part in zip(out, made, strict=True):
                column.append(part)
        return out

    # A text has no more first occurrences than paragraphs; what is asked of it are distinct places of its own.
    places = places.select("doc_id", "text_hash", F.struct("node", "start", "end").alias("place"), F.lit(None).alias("ask"))
    asks = asks.select("doc_id", "text_hash", F.lit(None).alias("place"), F.struct("row", "start", "end", "same_end").alias("ask"))
    wanted = places.unionByName(asks).groupBy(F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")).agg(F.collect_list("place").alias("places"), F.collect_list("ask").alias("asks"))
    twins = texts.groupBy(F.col("doc_id").alias("twin_id"), F.col("text_hash").alias("twin_hash")).agg(F.count("*").alias("n")).filter("n > 1")
    wanted = wanted.join(twins, F.col("wanted_id").eqNullSafe(F.col("twin_id")) & (F.col("wanted_hash") == F.col("twin_hash")), "left")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
    return written(map_texts(held.select(F.col("n").isNotNull().alias("twin"), F.struct("text", "places", "asks").alias("held")), READ, compute, "held"))


def _asked(read: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The rows of some arrays of _read_again(), once each; only texts that stand in several rows need a comparison."""
    of = lambda twin: read.filter(F.col("twin") == twin).select(F.inline(F.arrays_zip(*names)))
    return of(False).unionByName(of(True).dropDuplicates(keys))


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per occurrence of a paragraph or passage that occurs again, the same or nearly so.

    doc_id, line, start, end (words of the document), cluster (hexadecimal digest of the cluster), first_doc_id and
    first_line (the occurrence that stays: smallest doc_id, then line; null ids last), occurrences, removed (false for
    that one). Further rows are the passages of RUN_WORDS words or more that occur again word by word and of which some
    occurrence is not made of such paragraphs; their line is that of their first word. Stretches under ``min_words``
    words between longer lines are in no paragraph. Null and empty texts make no rows. Repeated rows of ``docs`` count as
    occurrences of their own, of which one is not removed. Ids of any kind pass as they are. An empty table gives no
    rows; further columns are ignored.
    """
    bands, rows = tune_bands(similarity)
    texts = analyse(docs, bands, rows, size, min_words)
    first = F.min(F.struct(_unknown(), "doc_id", "row", "line"))
    copies = texts.groupBy("digest").agg(first.alias("first"), F.count("*").alias("occurrences"))
    copies = written(copies.select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line"), "occurrences"))
    spans = _segment_spans(texts, copies)
    # However often a passage stands elsewhere, its first occurrence is asked for once.
    here = spans.select("row", "start", "end", "same_end")
    there = spans.select(F.col("first_row").alias("row"), F.col("start") - F.col("shift"), F.col("end") - F.col("last_shift"), F.col("same_end") - F.col("shift")).toDF(*here.columns)
    asks = here.unionByName(there).distinct().join(texts.select("row", "doc_id", "text_hash"), "row")

    place = F.posexplode(F.arrays_zip("p_line", "p_start", "p_end", "p_node")).alias("p", "place")
    places = texts.filter(F.size("p_line") > 0).select("row", "doc_id", "text_hash", place, "p_keys").select(
        "row", "doc_id", "text_hash", F.col("place.p_line").alias("line"), F.col("place.p_start").alias("start"), F.col("place.p_end").alias("end"), F.col("place.p_node").alias("node"),
        F.slice("p_keys", F.col("p") * bands + 1, bands).alias("keys"),
    )
    order = F.struct(_unknown(), "doc_id", "line", "row", "start", "end", "text_hash")
    nodes = places.groupBy(F.col("node").alias("digest")).agg(F.min(order).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("times"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    read: list[DataFrame] = []

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = nodes.join(wanted, "node").select("node", "first.doc_id", "first.text_hash", "first.start", "first.end")
        read.append(_read_again(docs, texts, places, asks, size))
        return _asked(read[0], ["node", "hashes"], ["node"])

    groups = components(similar_edges(nodes.select("node", "keys"), sets_of, Measure(similarity)))
    named = nodes.drop("keys").join(groups.withColumnRenamed("node", "grouped"), F.col("node") == F.col("grouped"), "left").withColumn("component", F.coalesce("component", "node"))
    clusters = named.groupBy("component").agg(F.min("first").alias("first"), F.min("digest").alias("name"), F.sum("times").alias("occurrences")).filter("occurrences > 1")
    members = named.select(F.col("digest").alias("node"), "component").join(clusters, "component")
    lines = places.drop("keys", "doc_id", "text_hash").join(members, "node").select(
        "row", "line", "start", "end", F.lower(F.hex("name")).alias("cluster"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), "occurrences",
        ((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).alias("removed"),
    )
    lines = written(lines)
    discard(nodes)
    place = ["at_row", "at_start", "at_end", "at_same"]
    around = _asked(read[0], [*place, "left", "lines", "right", "after"], place)
    runs = _not_in_lines(written(_passages(texts, copies, spans, around)), lines).select(lines.columns)
    return lines.unionByName(runs).join(texts.select("row", "doc_id"), "row").select("doc_id", *[c for c in lines.columns if c != "row"])
