"""Regular grids, peaks, and the episodes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import HOUR, floor_us, from_micros, micros
from strandline.operators.joins import in_intervals
from strandline.operators.prominence import apart, prominences
from strandline.operators.scans import cut, neighbours
from strandline.params import DEFAULTS, Params


def hourly(samples: DataFrame, keys: list[str], width: int = HOUR, chunk: int = DEFAULTS.chunk) -> DataFrame:
    """Bucket means on a complete grid, gaps filled linearly along the grid: keys, ts, value, filled.

    Rows with a null are dropped, of rows at one time the one with the largest event_id counts, and a key with fewer
    than two distinct times gives no rows. Each bucket lays out the grid up to the next one.
    """
    clean = samples.dropna(subset=["ts", "value"]).groupBy(*keys, micros("ts").alias("us")).agg(F.max_by("value", "event_id").alias("value"))
    means = clean.groupBy(*keys, floor_us(F.col("us"), width).alias("us")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    steps = neighbours(means, keys, F.struct("us", "mean"), [], chunk, strict=True, keep=["mean", "n"]).filter("n >= 2 OR b IS NOT NULL OR a IS NOT NULL")
    points = F.explode(F.sequence("us", F.coalesce(F.col("a.us") - width, F.col("us")), F.lit(width)))
    full = steps.select(*keys, F.col("us").alias("from_us"), "mean", "a", points.alias("us"))
    line = F.col("mean") + (F.col("a.mean") - F.col("mean")) * ((F.col("us") - F.col("from_us")) / (F.col("a.us") - F.col("from_us")))
    here = F.col("us") == F.col("from_us")
    return full.select(*keys, from_micros(F.col("us")).alias("ts"), F.when(here, F.col("mean")).otherwise(line).alias("value"), (~here).alias("filled"))


def local_maxima(grid: DataFrame, keys: list[str], chunk: int = DEFAULTS.chunk, flat: bool = True) -> DataFrame:
    """Strict local maxima of a regular grid without nulls; a flat top counts once, at its middle (the earlier of two), or not at all."""
    rows = neighbours(grid.select(*keys, micros("ts").alias("us"), "value"), keys, F.struct("us", "value"), [], chunk, strict=True, keep=["value"])
    if not flat:
        return rows.filter((F.col("b.value") < F.col("value")) & (F.col("a.value") < F.col("value"))).select(*keys, from_micros(F.col("us")).alias("ts"), "value")
    begins = F.col("b").isNull() | (F.col("b.value") != F.col("value"))
    ends = rows.filter(begins | F.col("a").isNull() | (F.col("a.value") != F.col("value")))
    # Of one value a stretch's first and last row, or its only one, follow each other.
    before = Window.partitionBy(*keys, "value").orderBy("us")
    ends = ends.select(*keys, "us", "value", begins.alias("begins"), (F.col("b.value") < F.col("value")).alias("rises"), (F.col("a.value") < F.col("value")).alias("falls"), (F.col("a.us") - F.col("us")).alias("step"))
    first = lambda c: F.when(F.col("begins"), F.col(c)).otherwise(F.lag(c).over(before))
    tops = ends.withColumns({"first_us": first("us"), "rose": first("rises")}).filter("falls AND rose")
    middle = F.col("first_us") + F.floor((F.col("us") - F.col("first_us")) / (2 * F.col("step"))).cast("long") * F.col("step")
    return tops.select(*keys, from_micros(middle).alias("ts"), "value")


#: Rows of a grid that a task looks through at once for peaks.
STRETCH = 4096


def detect_peaks(samples: DataFrame, keys: list[str], p: Params = DEFAULTS, height: float | None = None, flat: bool = True) -> DataFrame:
    """keys, ts, value, prominence of every peak of the hourly grid. A series is shared by as many tasks as it has chunks."""
    return prominent(hourly(samples, keys, HOUR, p.chunk), keys, p, height, flat=flat)


def prominent(grid: DataFrame, keys: list[str], p: Params = DEFAULTS, height: float | None = None, width: int = HOUR, stretch: int = STRETCH, flat: bool = True) -> DataFrame:
    """Peaks of a regular grid (keys, ts, value) of ``width``: at least p.distance_days apart, the highest first.

    The distance is counted in steps of the grid, 24 to the day whatever its width. Without ``flat`` tops of several equal
    values are no peaks.
    """
    distance, chunk = max(1, round(p.distance_days * 24)) * width, max(p.chunk, stretch * width) if stretch else p.chunk
    tops = local_maxima(grid, keys, p.chunk, flat).select(*keys, micros("ts").alias("us"), "value")
    tops = tops if height is None else tops.filter(F.col("value") >= height)
    tops = apart(tops, keys, distance, chunk) if distance > width else tops
    tops = cut(tops)
    found = prominences(grid.select(*keys, micros("ts").alias("us"), "value"), tops, keys, chunk)
    return found.filter(F.col("prominence") >= p.prominence).select(*keys, from_micros(F.col("us")).alias("ts"), "value", "prominence")


def episodes(samples: DataFrame, peaks: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Build-ups between consecutive peaks: prev_ts, end_ts, trough_ts, trough_value, n_rows (trough to peak), place (1: latest).

    The trough is the first minimum within 14 days of the previous peak; episodes with too few rows before or after it
    are left out.
    """
    rows = in_intervals(samples, peaks, keys).withColumn("us", micros("ts"))
    early = F.col("us") <= micros("prev_ts") + p.trough_search
    trough = F.min_by(F.struct("ts", "value"), F.when(early, F.struct("value", "us", "event_id")))
    low = rows.groupBy(*keys, "prev_ts", "end_ts").agg(F.count("*").alias("n_all"), F.max(early.cast("int")).alias("any_early"), trough.alias("t"))
    low = low.filter((F.col("n_all") >= p.episode_rows) & (F.col("any_early") == 1)).select(*keys, "prev_ts", "end_ts", F.col("t.ts").alias("trough_ts"), F.col("t.value").alias("trough_value"))
    rise = rows.join(low, [*keys, "prev_ts", "end_ts"]).filter("ts >= trough_ts").groupBy(*keys, "prev_ts", "end_ts", "trough_ts", "trough_value").agg(F.count("*").alias("n_rows"))
    return rise.filter(F.col("n_rows") >= p.episode_rows).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("end_ts"))))


def current_trough(samples: DataFrame, peaks: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """First minimum within 14 days after the last peak, per key with rows there."""
    last = peaks.groupBy(*keys).agg(F.max("ts").alias("peak_ts"))
    after = samples.join(last, keys).filter((F.col("ts") > F.col("peak_ts")) & (micros("ts") <= micros("peak_ts") + p.trough_search))
    low = after.groupBy(*keys, "peak_ts").agg(F.min_by(F.struct("ts", "value"), F.struct("value", "ts", "event_id")).alias("t"))
    return low.select(*keys, "peak_ts", F.col("t.ts").alias("trough_ts"), F.col("t.value").alias("trough_value"))


def backtest_segments(samples: DataFrame, peaks: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """The latest segments between prominent peaks: trough is the first minimum of the whole interval."""
    rows = in_intervals(samples, peaks.filter(F.col("prominence") > p.backtest_prominence), keys)
    low = rows.groupBy(*keys, "prev_ts", "end_ts").agg(F.count("*").alias("n_rows"), F.min_by(F.struct("ts", "value"), F.struct("value", "ts", "event_id")).alias("t"))
    found = low.filter(F.col("n_rows") >= p.episode_rows).select(*keys, "prev_ts", "end_ts", F.col("t.ts").alias("trough_ts"), F.col("t.value").alias("trough_value"), "n_rows")
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("end_ts")))).filter(F.col("place") <= p.backtest_segments)
