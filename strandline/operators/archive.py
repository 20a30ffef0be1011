"""Appending overlapping deliveries, and an archive that never changes what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, from_micros, micros, round_us
from strandline.operators.joins import close_neighbours, nearest_within
from strandline.operators.windows import ranges
from strandline.params import DEFAULTS, Params

MODE_WIDTH = 0.2
MODE_LEAST = 5
MODE_SPAN = 0.5


def bucketed(samples: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return samples.withColumn("bucket", from_micros(round_us(micros("ts"), p.merge_bucket)))


def mode_offset(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The most common difference: keys, offset, n_pairs.

    Few or closely packed differences give their median; else bins of 0.2 are counted from 0.2 below the smallest, and
    the median of what lies within 0.2 of the fullest bin's middle is taken (the middle itself below three values).
    """
    spans = deltas.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.min("delta").alias("low"), F.max("delta").alias("high"), F.median("delta").alias("mid"))
    binned = deltas.join(spans, keys).withColumn("bin", F.floor((F.col("delta") - F.col("low") + MODE_WIDTH) / MODE_WIDTH))
    fullest = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("top"))
    centred = binned.join(fullest, keys).withColumn("centre", F.col("low") - MODE_WIDTH + (F.col("top") + 0.5) * MODE_WIDTH)
    near = F.when(F.abs(F.col("delta") - F.col("centre")) <= MODE_WIDTH, F.col("delta"))
    found = centred.groupBy(*keys, "n_pairs", "low", "high", "mid", "centre").agg(F.median(near).alias("near_mid"), F.count(near).alias("near_n"))
    plain = (F.col("n_pairs") < MODE_LEAST) | (F.col("high") - F.col("low") < MODE_SPAN)
    offset = F.when(plain, F.col("mid")).when(F.col("near_n") >= 3, F.col("near_mid")).otherwise(F.col("centre"))
    return found.select(*keys, offset.alias("offset"), "n_pairs")


def frame_offsets(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How far a delivery lies above what is stored, from nearest pairs in time."""
    pairs = nearest_within(new, known, keys).join(new.select(*keys, "event_id", "value"), [*keys, "event_id"])
    return mode_offset(pairs.select(*keys, (F.col("value") - F.col("near_value")).alias("delta")), keys)


def append(known: DataFrame, new: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``known`` with the aligned delivery: one row per bucket, the one with the latest time (the new one on a tie)."""
    offsets = frame_offsets(known, new, keys)
    aligned = new.join(offsets, keys, "left").withColumn("value", F.col("value") - F.coalesce("offset", F.lit(0.0)))
    both = known.select(*keys, "ts", "value", "event_id", F.lit(0).alias("is_new")).unionByName(aligned.select(*keys, "ts", "value", "event_id", F.lit(1).alias("is_new")))
    last = bucketed(both, p).groupBy(*keys, "bucket").agg(F.max_by(F.struct("ts", "value", "is_new"), F.struct("ts", "is_new", "event_id")).alias("s"))
    return last.select(*keys, "bucket", "s.*")


def append_conflicts(known: DataFrame, new: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Buckets that both sides have with clearly different last values."""
    last = lambda f, name: bucketed(f, p).groupBy(*keys, "bucket").agg(F.max_by("value", F.struct("ts", "event_id")).alias(name))
    both = last(known, "known_value").join(last(new, "new_value"), [*keys, "bucket"])
    return both.filter(F.abs(F.col("new_value") - F.col("known_value")) > p.conflict)


def append_counts(known: DataFrame, new: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Buckets added and updated by a delivery, per key."""
    old = bucketed(known, p).select(*keys, "bucket").distinct().withColumn("old", F.lit(1))
    seen = bucketed(new, p).select(*keys, "bucket").distinct().join(old, [*keys, "bucket"], "left")
    return seen.groupBy(*keys).agg(F.count(F.when(F.col("old").isNull(), 1)).alias("added"), F.count("old").alias("updated"))


def append_report(known: DataFrame, new: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """What a delivery does, per key: added, updated, conflicts, offset, n_pairs, warnings.

    Conflicts are counted after alignment. Warnings name what an operator should look at: no overlap with what is
    stored, fewer pairs than ``p.sure_pairs``, an offset of ``p.warn_offset`` or more.
    """
    offsets = frame_offsets(known, new, keys)
    aligned = new.join(offsets.select(*keys, "offset"), keys, "left").withColumn("value", F.col("value") - F.coalesce("offset", F.lit(0.0)))
    conflicts = append_conflicts(known, aligned, keys, p).groupBy(*keys).agg(F.count("*").alias("conflicts"))
    counted = append_counts(known, new, keys, p).join(conflicts, keys, "left").join(offsets, keys, "left")
    n, offset = F.coalesce("n_pairs", F.lit(0)), F.coalesce("offset", F.lit(0.0))
    warnings = F.array_compact(F.array(
        F.when(n == 0, "no overlap: appended as it is"), F.when(n.between(1, p.sure_pairs - 1), "few overlapping rows"), F.when(F.abs(offset) >= p.warn_offset, "large offset"),
    ))
    return counted.select(*keys, "added", "updated", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), offset.alias("offset"), n.alias("n_pairs"), warnings.alias("warnings"))


def quorum(candidates: DataFrame, live: DataFrame, archive: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Candidates that two sources agree on in their bucket, or that continue the archive closely."""
    sources = bucketed(live, p).groupBy(*series, "bucket").agg(F.countDistinct("source").alias("n_sources"))
    counted = bucketed(candidates, p).join(sources, [*series, "bucket"], "left")
    close = close_neighbours(candidates, archive, series, p).select(*series, "event_id", F.lit(True).alias("continues"))
    marked = counted.join(close, [*series, "event_id"], "left").withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)), "continues": F.coalesce("continues", F.lit(False))})
    return marked.filter((F.col("n_sources") >= p.quorum) | F.col("continues"))


def promote(candidates: DataFrame, live: DataFrame, archive: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Rows to append to the archive: the last per bucket, where the archive has none, that pass the quorum."""
    last = bucketed(candidates, p).groupBy(*series, "bucket").agg(F.max_by(F.struct("ts", "value", "event_id"), F.struct("ts", "event_id")).alias("s")).select(*series, "s.*")
    held = bucketed(archive, p).select(*series, "bucket").distinct()
    fresh = bucketed(last, p).join(held, [*series, "bucket"], "left_anti").drop("bucket")
    return quorum(fresh, live, archive, series, p)


def promotion_report(candidates: DataFrame, live: DataFrame, archive: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Per series: rows_before, rows_promoted, rows_archived_already, rows_deferred, rows_after."""
    buckets = bucketed(candidates, p).select(*series, "bucket").distinct()
    held = bucketed(archive, p).select(*series, "bucket").distinct().withColumn("held", F.lit(1))
    offered = buckets.join(held, [*series, "bucket"], "left").groupBy(*series).agg(F.count("*").alias("offered"), F.count("held").alias("rows_archived_already"))
    promoted = promote(candidates, live, archive, series, p).groupBy(*series).agg(F.count("*").alias("rows_promoted"))
    before = archive.groupBy(*series).agg(F.count("*").alias("rows_before"))
    both = offered.join(promoted, series, "left").join(before, series, "left").na.fill(0)
    deferred = F.col("offered") - F.col("rows_archived_already") - F.col("rows_promoted")
    return both.select(*series, "rows_before", "rows_promoted", "rows_archived_already", deferred.alias("rows_deferred"), (F.col("rows_before") + F.col("rows_promoted")).alias("rows_after"))


def contamination_rounds(archive: DataFrame, merged: DataFrame, series: list[str], limit: float = 3.0, near_limit: float = 2.5, rounds: int = 2) -> DataFrame:
    """Archive rows that disagree with the merged series of their bucket or with their archived neighbourhood.

    First the bucket's merged value (``merged``: series, bucket, value); then, for rows without one, rounds against the
    median of the rows not yet flagged: over 6 hours to both sides where nothing lies within 30 minutes, else over a day.
    Returns series, ts, event_id, value, flag (1, then a number for each round), the ``reference`` that the value was held
    against, and whether the row stood ``alone``.
    """
    truth = merged.select(*series, "bucket", F.col("value").alias("truth"))
    rows = bucketed(archive).join(truth, [*series, "bucket"], "left")
    wrong = F.abs(F.col("value") - F.col("truth")) > limit
    rows = rows.withColumns({"flag": F.when(wrong, 1).otherwise(0), "reference": F.when(wrong, F.col("truth")), "alone": F.lit(False)})
    for r in range(rounds):
        active = F.when(F.col("flag") == 0, F.col("value"))
        rows = ranges(rows, series, active, [DEFAULTS.neighbour, 6 * HOUR, DAY])
        alone = F.col("near")[0]["n_values"] - F.when(active.isNotNull(), 1).otherwise(0) == 0
        wide = lambda field: F.when(alone, F.col("near")[1][field]).otherwise(F.col("near")[2][field])  # noqa: B023, E731
        far = F.abs(F.col("value") - wide("median")) > F.when(alone, near_limit).otherwise(limit)
        orphan = F.col("truth").isNull() & (F.col("flag") == 0) & (wide("n_values") >= 3) & far
        new = {"flag": F.lit(r + 2), "reference": wide("median"), "alone": alone}
        rows = rows.withColumns({c: F.when(orphan, to).otherwise(F.col(c)) for c, to in new.items()}).drop("near")
    return rows.filter("flag > 0").select(*series, "ts", "event_id", "value", "flag", "reference", "alone")
