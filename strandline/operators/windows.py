"""Window operators over series: differences, rolling medians, rate and outlier filters, neighbourhoods."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.timebuckets import HOUR, micros
from strandline.params import DEFAULTS, Params


def by_time(keys: list[str], *more: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts", *more)


def whole(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def steps_between(samples: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Continuity audit: neighbouring rows, however far apart in time, whose values differ by more than ``p.step``."""
    w = by_time(keys)
    pairs = samples.withColumns({"before_ts": F.lag("ts").over(w), "before_value": F.lag("value").over(w)})
    delta = F.abs(F.col("value") - F.col("before_value"))
    return pairs.filter(delta > p.step).select(*keys, "before_ts", "ts", "before_value", "value", delta.alias("delta"))


def rolling_median(samples: DataFrame, keys: list[str], before: int = 2, after: int = 2, least: int = 3) -> DataFrame:
    """``local_median`` of the rows around each row, null where there are fewer than ``least``."""
    w = by_time(keys).rowsBetween(-before, after)
    return samples.withColumn("local_median", F.when(F.count("value").over(w) >= least, F.percentile("value", F.lit(0.5)).over(w)))


def outlier_flags(samples: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Rolling-median outlier filter: ``dropped`` where a value is far from its local median; short series keep all."""
    far = F.abs(F.col("value") - F.col("local_median")) > p.rolling_threshold
    enough = F.count("*").over(whole(keys)) >= p.rolling_rows
    return rolling_median(samples, keys).withColumn("dropped", F.coalesce(enough & far, F.lit(False)))


def rate_flags(samples: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Physical-rate filter: both rows of a too steep step are flagged; if that is too many of a series, none is.

    Steps are cut to whole seconds, and a step of no time counts as a minute.
    """
    w = by_time(keys)
    seconds = F.floor((micros("ts") - F.lag(micros("ts")).over(w)) / 1e6)
    hours = F.when(seconds <= 0, 60.0).otherwise(seconds) / 3600.0
    steep = samples.withColumn("steep", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) / hours > p.rate_cap, F.lit(False)))
    marked = steep.withColumn("marked", F.col("steep") | F.coalesce(F.lead("steep").over(w), F.lit(False)))
    share = F.avg(F.col("marked").cast("double")).over(whole(keys))
    return marked.withColumn("dropped", F.col("marked") & (share <= p.rate_share)).drop("steep")


def gradient(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Second-order differences on uneven steps in value per hour, one-sided at the ends; null for a single row."""
    w = by_time(keys)
    hours = micros("ts") / float(HOUR)
    near = samples.withColumns({"h": hours, "hb": hours - F.lag(hours).over(w), "ha": F.lead(hours).over(w) - hours, "vb": F.lag("value").over(w), "va": F.lead("value").over(w)})
    inner = (F.col("hb") ** 2 * F.col("va") + (F.col("ha") ** 2 - F.col("hb") ** 2) * F.col("value") - F.col("ha") ** 2 * F.col("vb")) / (
        F.col("hb") * F.col("ha") * (F.col("ha") + F.col("hb"))
    )
    slope = (
        F.when(F.col("hb").isNotNull() & F.col("ha").isNotNull(), inner)
        .when(F.col("hb").isNotNull(), (F.col("value") - F.col("vb")) / F.col("hb"))
        .when(F.col("ha").isNotNull(), (F.col("va") - F.col("value")) / F.col("ha"))
    )
    return near.withColumn("gradient", slope).drop("h", "hb", "ha", "vb", "va")


def _frames(us: np.ndarray, values: pa.ChunkedArray, span: int, asked: np.ndarray) -> tuple[list, list, list]:
    """Rows, known values and their median within ``span`` of each row asked for; ``us`` ascends.

    The frame moves along once: values enter and leave a sorted list of their ranks.
    """
    known = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy()
    order = np.argsort(np.where(known, numbers, np.inf), kind="stable")  # NaN comes last, as in Spark
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    first, behind = np.searchsorted(us, us - span, "left").tolist(), np.searchsorted(us, us + span, "right").tolist()
    rank, known, by_rank = rank.tolist(), known.tolist(), numbers[order].tolist()
    frame: list[int] = []
    rows, counts, medians = [], [], []
    low = high = 0
    for i in np.flatnonzero(asked).tolist():
        while high < behind[i]:
            if known[high]:
                insort(frame, rank[high])
            high += 1
        while low < first[i]:
            if known[low]:
                del frame[bisect_left(frame, rank[low])]
            low += 1
        n = len(frame)
        rows.append(high - low)
        counts.append(n)
        medians.append(0.5 * by_rank[frame[(n - 1) // 2]] + 0.5 * by_rank[frame[n // 2]] if n else None)
    return rows, counts, medians


def ranges(samples: DataFrame, keys: list[str], value: Column, spans: list[int], chunk: int = DEFAULTS.chunk) -> DataFrame:
    """``samples`` with ``near``: for each of ``spans`` (microseconds to both sides) a struct of n_rows, n_values and median.

    The row itself counts, as do others of its time; nulls of ``value`` are rows without a value, and no value has a null
    median. Null keys are a key of their own. A row without a time has a null ``near`` and is in nobody's. A series is
    scanned in chunks of time, each with the rows of its neighbours that its own rows see: no frame is built anew for a
    row, and one long series is shared by all tasks.
    """
    widest = max(spans)
    width = max(chunk, widest)
    at = lambda us: F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")
    # Rows without a time need no company: they are spread, whatever their number.
    alone = F.array(F.pmod(F.xxhash64(*samples.columns), F.lit(64)))
    marked = samples.withColumns({"value_": value.cast("double"), "us_": micros("ts")})
    marked = marked.withColumns({"low_": F.col("us_") - widest, "high_": F.col("us_") + widest})
    spread = marked.withColumn("chunk_", F.explode(F.when(F.col("us_").isNull(), alone).otherwise(F.sequence(at("low_"), at("high_"))))).withColumn("own_", F.col("us_").isNull() | (at("us_") == F.col("chunk_"))).drop("low_", "high_")
    kept = samples.columns
    near = "array<struct<n_rows:long,n_values:long,median:double>>"
    shape = pa.list_(pa.struct([("n_rows", pa.int64()), ("n_values", pa.int64()), ("median", pa.float64())]))

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.or_(rows["own_"], pc.is_valid(rows["us_"])))
        timed = rows.filter(pc.is_valid(rows["us_"])).sort_by("us_")
        asked = timed["own_"].to_numpy(zero_copy_only=False)
        us = timed["us_"].cast(pa.int64()).to_numpy()
        found = [_frames(us, timed["value_"], span, asked) for span in spans]
        each = [[{"n_rows": r, "n_values": n, "median": m} for r, n, m in zip(*f, strict=True)] for f in found]
        own = timed.filter(timed["own_"]).select(kept).append_column("near", pa.array([list(row) for row in zip(*each, strict=True)], shape))
        rest = rows.filter(pc.is_null(rows["us_"])).select(kept)
        return pa.concat_tables([own, rest.append_column("near", pa.nulls(rest.num_rows, shape))])

    schema = T.StructType([*samples.schema.fields, T.StructField("near", T._parse_datatype_string(near))])
    return spread.groupBy(*keys, "chunk_").applyInArrow(scan, schema)


def around(samples: DataFrame, keys: list[str], span: int, chunk: int = DEFAULTS.chunk) -> DataFrame:
    """``near_rows`` and ``near_median`` over ``span`` microseconds to both sides, the row itself included; null without a time."""
    near = F.col("near")[0]
    return ranges(samples, keys, F.col("value"), [span], chunk).withColumns({"near_rows": near["n_rows"], "near_median": near["median"]}).drop("near")


def trailing(samples: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Rows within ``span`` microseconds of the newest row of their key."""
    us = micros("ts")
    return samples.withColumn("newest_us", F.max(us).over(whole(keys))).filter(us >= F.col("newest_us") - span).drop("newest_us")


def recent_slice(samples: DataFrame, keys: list[str], days: int = 30, least: int = 2) -> DataFrame:
    """The trailing ``days`` of each key, or nothing where they hold fewer than ``least`` rows."""
    recent = trailing(samples, keys, days * 24 * HOUR).withColumn("n_recent", F.count("*").over(whole(keys)))
    return recent.filter(F.col("n_recent") >= least).drop("n_recent")


def trailing_slope(samples: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Least-squares slope per hour of the trailing rows; null below three rows or two distinct times."""
    hours = (micros("ts") - F.col("newest_us")) / float(HOUR)
    recent = samples.withColumn("newest_us", F.max(micros("ts")).over(whole(keys))).filter(micros("ts") >= F.col("newest_us") - span)
    enough = (F.count("*") >= 3) & (F.countDistinct("ts") >= 2)
    return recent.withColumn("hours", hours).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.when(enough, F.regr_slope("value", "hours")).alias("slope"))


def drop_from_recent_max(samples: DataFrame, keys: list[str], span: int = 24 * HOUR) -> DataFrame:
    recent = trailing(samples, keys, span)
    last = F.max_by("value", F.struct("ts", "event_id"))
    return recent.groupBy(*keys).agg(F.max("value").alias("recent_max"), last.alias("last_value"), (F.max("value") - last).alias("drop"))


def newest(samples: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, numbered in ``place``."""
    return samples.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def keep_last(samples: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last by ``order``."""
    columns = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(*keys, "last.*")


def late_window(samples: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """The trailing rows for a late fit: half of the rows, but no more than lie within the last week."""
    us = micros("ts")
    counted = samples.withColumns({"n": F.count("*").over(whole(keys)), "newest_us": F.max(us).over(whole(keys))})
    recent = F.sum((us >= F.col("newest_us") - int(p.late_hours * HOUR)).cast("int")).over(whole(keys))
    ranked = counted.withColumns({"recent": recent, "back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))})
    return ranked.filter(F.col("back") <= F.least(F.ceil(F.col("n") * p.late_share), F.col("recent"))).drop("n", "newest_us", "recent", "back")
