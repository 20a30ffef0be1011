"""Joins on time: nearest rows, buckets, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.timebuckets import HOUR, MINUTE, from_micros, micros
from strandline.operators.scans import neighbours, strides
from strandline.params import DEFAULTS, Params


def nearest(probe: DataFrame, base: DataFrame, keys: list[str], chunk: int = DEFAULTS.chunk) -> DataFrame:
    """``probe`` with the nearest row of ``base`` in time: near_us and near_value, null where a key has no base row.

    Of two at the same distance the earlier wins; of base rows at one time the one with the largest event_id. Both
    sides are laid in one order and the last base row before and the first after are carried along, chunk by chunk, so
    that no pairs arise and a long series is shared by many tasks. Probe rows without a time have no neighbour.
    """
    last_at = base.groupBy(*keys, micros("ts").alias("us")).agg(F.max_by("value", "event_id").alias("value")).filter("us IS NOT NULL")
    mark = F.struct(F.col("us"), F.col("value"))
    both = last_at.select(*keys, "us", mark.alias("hit"), F.lit(0).alias("side"), F.lit(None).cast(probe.schema["event_id"].dataType).alias("event_id")).unionByName(
        probe.select(*keys, micros("ts").alias("us"), F.lit(None).cast("struct<us:bigint,value:double>").alias("hit"), F.lit(1).alias("side"), "event_id").filter("us IS NOT NULL")
    )
    found = neighbours(both, keys, F.col("hit"), ["side", "event_id"], chunk).filter("side = 1")
    first = F.col("a").isNull() | (F.col("us") - F.col("b.us") <= F.col("a.us") - F.col("us"))
    hit = F.when(F.col("b").isNotNull() & first, F.col("b")).otherwise(F.col("a"))
    return found.select(*keys, "event_id", "us", hit["us"].alias("near_us"), hit["value"].alias("near_value"))


def nearest_within(probe: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of new and known rows for aligning a delivery with what is stored.

    The tolerance is three median strides of the base, between 15 minutes and 6 hours (1 hour for a single row); rows
    beyond the base's span by more than half a stride (the tolerance for a single row) do not count.
    """
    spans = base.groupBy(*keys).agg(F.min(micros("ts")).alias("low_us"), F.max(micros("ts")).alias("high_us"))
    limits = spans.join(strides(base, keys), keys, "left")
    tolerance = F.coalesce(F.least(F.greatest(3 * F.col("median_us"), F.lit(15.0 * MINUTE)), F.lit(6.0 * HOUR)), F.lit(1.0 * HOUR))
    margin = F.coalesce(F.col("median_us") / 2, tolerance)
    joined = nearest(probe, base, keys).join(limits, keys)
    inside = (F.col("us") >= F.col("low_us") - margin) & (F.col("us") <= F.col("high_us") + margin)
    return joined.filter((F.abs(F.col("us") - F.col("near_us")) <= tolerance) & inside).select(*keys, "event_id", from_micros(F.col("near_us")).alias("near_ts"), "near_value")


def close_neighbours(probe: DataFrame, base: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """event_id of probe rows whose nearest base row is close in time and value."""
    near = nearest(probe, base, keys).join(probe.select(*keys, "event_id", "value"), [*keys, "event_id"])
    close = (F.abs(F.col("us") - F.col("near_us")) <= p.neighbour) & (F.abs(F.col("value") - F.col("near_value")) <= p.neighbour_value)
    return near.filter(close).select(*keys, "event_id")


def in_intervals(samples: DataFrame, ends: DataFrame, keys: list[str], chunk: int = DEFAULTS.chunk) -> DataFrame:
    """Samples with the interval (prev_ts, end_ts] between consecutive ``ends`` (keys, ts) that holds them.

    Each sample takes the next end at or after it and the last one before it, by carrying the ends along in time order,
    chunk by chunk.
    """
    both = ends.select(*keys, "ts", F.col("ts").alias("end"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("event_id")).unionByName(
        samples.select(*keys, "ts", F.lit(None).cast("timestamp_ntz").alias("end"), F.lit(0).alias("side"), "value", "event_id")
    )
    timed = both.withColumn("us", micros("ts")).filter("us IS NOT NULL")
    # An end stands after the samples of its own time: it is theirs, and not yet behind them.
    marked = neighbours(timed, keys, F.col("end"), ["side"], chunk, keep=["ts", "value", "event_id"]).filter("side = 0 AND b IS NOT NULL AND a IS NOT NULL")
    return marked.select(*keys, "ts", "value", "event_id", F.col("b").alias("prev_ts"), F.col("a").alias("end_ts"))
