"""Phase of the current build-up, state of a series, simple forecasts as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, from_micros, micros
from strandline.operators.windows import drop_from_recent_max, trailing_slope
from strandline.params import DEFAULTS, Params

ACTIVE_SLOPE, ACTIVE_DROP = -0.5, 2.0
STARTING_SLOPE, STARTING_CHANGE = -0.15, 0.10


def interval_forecast(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Last peak plus the median interval, with quartiles from three intervals on: keys, next_us, low_us, high_us, n_peaks."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gaps = peaks.withColumn("gap", micros("ts") - F.lag(micros("ts")).over(w))
    out = gaps.groupBy(*keys).agg(
        F.max(micros("ts")).alias("last_us"), F.count("*").alias("n_peaks"), F.count("gap").alias("n_gaps"), F.median("gap").alias("mid"),
        F.percentile("gap", F.lit(0.25)).alias("q1"), F.percentile("gap", F.lit(0.75)).alias("q3"),
    ).filter("n_peaks >= 2")
    at = lambda x: F.floor(F.col("last_us") + x + 0.5).cast("long")
    wide = F.col("n_gaps") >= 3
    return out.select(*keys, at(F.col("mid")).alias("next_us"), F.when(wide, at(F.col("q1"))).alias("low_us"), F.when(wide, at(F.col("q3"))).alias("high_us"), "n_peaks")


def phase(samples: DataFrame, trough: DataFrame, episodes: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Hours since the current trough against the median of the last build-ups: fraction, late."""
    now = samples.groupBy(*keys).agg(F.max("ts").alias("now"))
    hours = F.timestamp_diff("MICROSECOND", "trough_ts", "end_ts") / float(HOUR)
    past = episodes.filter(F.col("place") <= p.episodes).groupBy(*keys).agg(F.median(hours).alias("median_h"), F.count("*").alias("n_episodes"))
    both = now.join(trough, keys).join(past.filter(F.col("n_episodes") >= p.episodes_least), keys)
    elapsed = F.greatest(F.timestamp_diff("MICROSECOND", "trough_ts", "now") / float(HOUR), F.lit(0.0))
    fraction = elapsed / F.nullif(F.col("median_h"), F.lit(0.0))
    return both.select(*keys, elapsed.alias("elapsed_h"), "median_h", fraction.alias("fraction"), "n_episodes", (fraction >= p.phase_switch).alias("late"))


def classify(samples: DataFrame, forecast: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """State of each series at ``now``: active, starting, calm, imminent or overdue.

    ``forecast`` has keys, next_us, low_us, high_us (null where unknown). ``now`` is given, never read from the clock.
    """
    slope = lambda hours, name: trailing_slope(samples, keys, int(hours * HOUR)).select(*keys, F.col("slope").alias(name))
    facts = drop_from_recent_max(samples, keys)
    for hours, name in ((3, "slope_3h"), (0.5, "slope_half_h"), (6, "slope_6h")):
        facts = facts.join(slope(hours, name), keys, "left")
    facts = facts.join(forecast, keys, "left").withColumn("now_us", micros(now))
    active = (F.col("slope_3h") < ACTIVE_SLOPE) & (F.col("drop") > ACTIVE_DROP)
    starting = (F.col("slope_half_h") < STARTING_SLOPE) & (F.col("slope_6h") - F.col("slope_half_h") > STARTING_CHANGE)
    low, high = F.coalesce("low_us", F.col("next_us") - 2 * DAY), F.coalesce("high_us", F.col("next_us") + 2 * DAY)
    state = F.when(active, "active").when(starting, "starting").when(low.isNull() | (F.col("now_us") < low), "calm").when(F.col("now_us") <= high, "imminent").otherwise("overdue")
    return facts.select(*keys, "slope_3h", "slope_half_h", "slope_6h", "drop", state.alias("state"))


def crossing(m1: Column, b1: Column, m2: Column, b2: Column, earliest: Column, latest: Column, limit: float = DEFAULTS.value_limit) -> Column:
    """Where two lines meet, as an expression; null when parallel, out of range or beyond the value limit."""
    root = (b2 - b1) / F.when(F.abs(m1 - m2) >= 1e-12, m1 - m2)
    value = m2 * root + b2
    return F.when(root.between(earliest, latest) & (value > -limit) & (value < limit), root)


def curve_crossing(curve: Callable[[Column], Column], trend: Callable[[Column], Column], start: Column, days: float = DEFAULTS.horizon_days, limit: float = DEFAULTS.value_limit, steps: int = 90, halvings: int = 40) -> Column:
    """Where a curve first meets a trend within ``days`` of ``start``, as an expression: struct<day, value>, or null.

    The gap between the two is scanned at ``steps`` equal steps; the first zero counts, or the first change of sign, whose
    bracket is halved ``halvings`` times. A meeting beyond the value limit is none, as is one after it.
    """
    at = lambda k: start + k * (days / steps)
    gap = lambda x: curve(x) - trend(x)
    gaps = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: gap(at(k)))
    known = F.struct(gaps.alias("g"), F.lit(None).cast("int").alias("k"))
    # The first step at which the scan hits or passes the trend, by one walk along the gaps.
    found = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)), known,
        lambda s, k: F.struct(s["g"].alias("g"), F.when(s["k"].isNotNull(), s["k"]).when((F.get(s["g"], k) == 0) | (F.get(s["g"], k) * F.get(s["g"], k + 1) < 0), k).alias("k")),
        lambda s: F.struct(s["k"].alias("k"), F.get(s["g"], s["k"]).alias("gap")),
    )
    ends = F.struct(at(found["k"]).alias("low"), at(found["k"] + 1).alias("high"), found["gap"].alias("gap"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        before = gap(middle) * s["gap"] > 0
        return F.struct(F.when(before, middle).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(middle).alias("high"), s["gap"].alias("gap"))

    def root(s: Column) -> Column:
        day = F.when(s["gap"] == 0, s["low"]).otherwise((s["low"] + s["high"]) / 2)
        value = trend(day)
        return F.when((value > -limit) & (value < limit), F.struct(day.alias("day"), value.alias("value")))

    turns = F.when(found["gap"] == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(halvings)))
    return F.when(found["k"].isNotNull(), F.aggregate(turns, ends, halve, root))


def weighted_axis(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted straight line of value over pixel with weights (confidence / 100) ** 4, and its residuals.

    labels: keys, px, value, conf. Also the guard: a residual above 0.5 rejects the axis.
    """
    w = F.pow(F.col("conf") / 100.0, 4)
    sums = labels.withColumn("w", w).groupBy(*keys).agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("px")).alias("sx"), F.sum(F.col("w") * F.col("value")).alias("sy"),
        F.sum(F.col("w") * F.col("px") ** 2).alias("sxx"), F.sum(F.col("w") * F.col("px") * F.col("value")).alias("sxy"), F.count("*").alias("n_labels"),
    )
    slope = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("s") * F.col("sxx") - F.col("sx") ** 2, F.lit(0.0))
    line = sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.nullif("s", F.lit(0.0)))
    residual = F.abs(F.col("value") - F.col("slope") * F.col("px") - F.col("intercept"))
    fitted = labels.join(line.select(*keys, "slope", "intercept", "n_labels"), keys)
    return fitted.groupBy(*keys, "slope", "intercept", "n_labels").agg(F.max(residual).alias("max_residual")).withColumn("rejected", F.col("max_residual") > 0.5)


def drift_guard(axes: DataFrame, history: DataFrame, keys: list[str], share: float = 0.03, most_px: float = 1.0, labels: DataFrame | None = None) -> DataFrame:
    """Fall back to the median of past slopes where the slope drifts and the residual exceeds a pixel.

    With ``labels`` (keys, px, value, conf) and an ``intercept`` in ``axes``, ``used_intercept`` is fitted anew for a
    slope that was replaced: the weighted mean of what the labels leave.
    """
    past = history.groupBy(*keys).agg(F.median("slope").alias("usual"))
    both = axes.join(past, keys, "left")
    drift = F.abs(F.col("slope") - F.col("usual")) / F.nullif(F.abs(F.col("usual")), F.lit(0.0))
    back = F.coalesce((drift > share) & (F.col("max_residual") / F.nullif(F.abs(F.col("slope")), F.lit(0.0)) > most_px), F.lit(False))
    used = both.withColumn("fallback", back).withColumn("used_slope", F.when(back, F.col("usual")).otherwise(F.col("slope")))
    if labels is None:
        return used
    w = F.pow(F.col("conf") / 100.0, 4)
    left = labels.join(used.select(*keys, "used_slope"), keys).groupBy(*keys).agg((F.sum(w * (F.col("value") - F.col("used_slope") * F.col("px"))) / F.sum(w)).alias("refitted"))
    return used.join(left, keys, "left").withColumn("used_intercept", F.when(F.col("fallback"), F.col("refitted")).otherwise(F.col("intercept"))).drop("refitted")


def window_faults(windows: DataFrame, expected: dict[str, float], growing: tuple = (), now: Column | None = None, tolerance_h: float = 2.0, most_age_h: float = 72.0) -> DataFrame:
    """``windows`` (source, start_ts, end_ts) with ``fault``: null, or why a window cannot be right.

    A source with an ``expected`` span in hours keeps to it; a ``growing`` one has 30 days to 5 years; and no window ends
    farther from ``now`` than ``most_age_h``.
    """
    hours = F.timestamp_diff("MICROSECOND", "start_ts", "end_ts") / float(HOUR)
    spans = F.create_map(*[F.lit(x) for pair in (expected or {"": 0.0}).items() for x in pair])
    wanted = F.try_element_at(spans, F.col("source"))
    age = F.abs(F.timestamp_diff("MICROSECOND", F.col("end_ts"), now)) / float(HOUR) if now is not None else F.lit(0.0)
    fault = (
        F.when(F.abs(hours - wanted) > tolerance_h, "span")
        .when(F.col("source").isin(*growing) & ~hours.between(30.0 * 24, 5.0 * 365 * 24), "growing span")
        .when(age > most_age_h, "end")
    )
    return windows.withColumn("fault", fault)


def pixels_to_data(points: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, px, py) with ts and value by the axes of their image, and the value of one pixel.

    axes: keys, slope, intercept (value over py), x0, y0, x1, y1 (the plot's box), start_ts, end_ts.
    """
    both = points.join(axes, keys)
    share = (F.col("px") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    ts = from_micros(F.round(micros("start_ts") + share * F.timestamp_diff("MICROSECOND", "start_ts", "end_ts")).cast("long"))
    height = F.col("y1") - F.col("y0")
    per_pixel = F.abs(F.col("slope") * height) / F.greatest(height, F.lit(1))
    return both.select(*points.columns, ts.alias("ts"), (F.col("slope") * F.col("py") + F.col("intercept")).alias("value"), per_pixel.alias("per_pixel"))


def ransac_line(points: DataFrame, keys: list[str], within: float = 2.0, least: int = 3) -> DataFrame:
    """The line through two labels that most labels agree with: inliers first, then summed confidence, then the pair.

    points: keys, label_id, px, value, conf. Labels of one image are few, so all lines are tried.
    """
    a, b = (points.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("label_id", "px", "value")]) for side in ("a", "b"))
    lines = a.join(b, keys).filter((F.col("label_id_a") < F.col("label_id_b")) & (F.col("value_a") != F.col("value_b")))
    lines = lines.withColumn("m", F.try_divide(F.col("px_b") - F.col("px_a"), F.col("value_b") - F.col("value_a"))).withColumn("c", F.col("px_a") - F.col("m") * F.col("value_a"))
    near = lines.join(points, keys).filter(F.abs(F.col("px") - F.col("m") * F.col("value") - F.col("c")) <= within)
    counted = near.groupBy(*keys, "label_id_a", "label_id_b", "m", "c").agg(F.count("*").alias("inliers"), F.sum("conf").alias("conf"))
    best = F.max_by(F.struct("m", "c", "inliers", "conf"), F.struct(F.col("inliers"), F.col("conf"), -F.col("label_id_a"), -F.col("label_id_b")))
    return counted.groupBy(*keys).agg(best.alias("l")).select(*keys, "l.*").filter(F.col("inliers") >= least)


def nearest_of(x: Column, values: tuple) -> Column:
    """The one of ``values`` nearest to ``x``, the smaller of two as near."""
    tries = F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.struct(F.abs(v - x).alias("off"), v.alias("v")))
    return F.array_min(tries)["v"]


def shown_range(samples: DataFrame, peaks: DataFrame, keys: list[str], back_days: int = 90, before_days: int = 7, ahead_days: int = 14) -> DataFrame:
    """What a chart shows: from ``back_days`` before the end, or a week before the first peak if that is earlier, to two weeks ahead; and where its marker stands."""
    first = peaks.groupBy(*keys).agg(F.min(micros("ts")).alias("first_us"))
    x = samples.groupBy(*keys).agg(F.max(micros("ts")).alias("hi"), F.max("value").alias("most"), F.min("value").alias("least")).join(first, keys)
    low = F.least(F.col("hi") - back_days * DAY, F.col("first_us") - before_days * DAY)
    return x.select(*keys, from_micros(low).alias("zoom_from"), from_micros(F.col("hi") + ahead_days * DAY).alias("zoom_to"), (F.col("most") + 0.1 * (F.col("most") - F.col("least"))).alias("marker"))
