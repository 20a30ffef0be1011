"""Robust lines and the forecasts that rest on them, from sums that merge.

A Huber line is the minimum of a loss that is quadratic near the line and linear beyond a scale. Each round asks all points
for a handful of sums, which partial aggregation merges, and moves every key's line by them; no task holds a key's points.
The scale comes from medians that count values in cells first and look at one cell's values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.robust import LEAST_SCALE, MAD_TO_SIGMA, TUNING
from strandline.functions.timebuckets import DAY, HOUR, from_micros, micros
from strandline.operators.joins import in_intervals
from strandline.operators.peaks import current_trough, episodes
from strandline.operators.scans import cut
from strandline.operators.state import crossing, phase
from strandline.params import DEFAULTS, Params

#: Rounds of a fit at most, rounds after which it is asked whether all lines stand still, and cells of a median.
ROUNDS, ASKED, CELLS = 90, 6, 4096


def medians(values: DataFrame, keys: list[str], value: str, cells: int = CELLS) -> DataFrame:
    """keys, median of ``value`` (never null or NaN), exactly, with the memory of the values of one or two cells per key.

    A first pass counts values in cells of equal width between a key's extremes, the second reads the cells that hold the
    middle. Where most values crowd into one cell they are few distinct ones, or else that cell is read whole.
    """
    ends = values.groupBy(*keys).agg(F.min(value).alias("low_"), F.max(value).alias("high_"), F.count("*").alias("n_"))
    place = F.when(F.col("high_") > F.col("low_"), F.floor((F.col(value) - F.col("low_")) / (F.col("high_") - F.col("low_")) * cells)).otherwise(0)
    celled = values.join(ends, keys).select(*keys, F.col(value).alias("v_"), "n_", place.cast("int").alias("cell_"))
    counts = celled.groupBy(*keys, "cell_", "n_").agg(F.count("*").alias("m_"))
    upto = F.sum("m_").over(Window.partitionBy(*keys).orderBy("cell_"))
    low, high = F.floor((F.col("n_") + 1) / 2), F.floor(F.col("n_") / 2) + 1  # ranks of the one or two middle values
    middle = counts.withColumn("before_", upto - F.col("m_")).filter((F.col("before_") < high) & (F.col("before_") + F.col("m_") >= low))
    near = celled.join(middle.select(*keys, "cell_", "before_"), [*keys, "cell_"])
    inside = near.groupBy(*keys, "n_").agg(F.min("before_").alias("before_"), F.sort_array(F.collect_list("v_")).alias("all_"))
    at = lambda rank: F.get("all_", (rank - F.col("before_") - 1).cast("int"))
    return inside.select(*keys, ((at(low) + at(high)) / 2).alias("median"))


def _step(s0: str, s1: str, s2: str) -> tuple[Column, Column]:
    """The move of slope and level that solves the two equations; of the level alone where all x are one."""
    a, b, c = F.col(s0), F.col(s1), F.col(s2)
    det = a * c - b * b
    whole = det > 1e-12 * a * c
    slope = F.when(whole, (a * F.col("g1") - b * F.col("g0")) / det).otherwise(0.0)
    level = F.when(whole, (c * F.col("g0") - b * F.col("g1")) / det).when(a > 0, F.col("g0") / a).otherwise(0.0)
    return slope, level


def huber_lines(points: DataFrame, keys: list[str], scale: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keys, slope, middle, level (at x = middle), scale, n of the Huber line of y over x for every key with two points or more.

    Without ``scale`` it is 1.345 sigma, from the median deviation of the first line's residuals. A round takes Newton's
    step, which ends after few rounds, exactly, once points are near the line; before, and where that does not lower the
    loss, it takes the reweighted step, which does. The rounds end when all lines stand still. Points with a
    null are left out; a key whose x are all equal has a level line.
    """
    rows = cut(points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"]))
    first = rows.groupBy(*keys).agg(F.avg("x").alias("middle"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("m"), F.avg("y").alias("c"), F.count("*").alias("n")).filter("n >= 2")
    x = F.col("x") - F.col("middle")
    if scale is None:
        first = cut(first)
        rest = rows.join(first, keys).select(*keys, (F.col("y") - F.col("m") * x - F.col("c")).alias("r"))
        off = rest.join(medians(rest, keys, "r"), keys).select(*keys, F.abs(F.col("r") - F.col("median")).alias("off"))
        first = first.join(medians(off, keys, "off"), keys).withColumn("f", F.greatest(TUNING * F.col("median") * MAD_TO_SIGMA, F.lit(LEAST_SCALE))).drop("median")
    else:
        first = first.withColumn("f", F.lit(float(scale)))
    now = first.select(*keys, "middle", "n", "f", F.col("m").alias("try_m"), F.col("c").alias("try_c"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("c"), F.lit(float("inf")).alias("loss"), F.lit(0.0).alias("safe_m"), F.lit(0.0).alias("safe_c"))
    for _ in range(0, rounds, ASKED):
        for _ in range(ASKED):
            now = _round(rows, now, keys)
        now = cut(now)
        moved = (F.abs(F.col("try_m") - F.col("m")) > 1e-11 * (1 + F.abs("m"))) | (F.abs(F.col("try_c") - F.col("c")) > 1e-11 * (1 + F.abs("c")))
        if not now.agg(F.max(moved)).first()[0]:
            break
    return now.select(*keys, F.col("m").alias("slope"), "middle", F.col("c").alias("level"), F.col("f").alias("scale"), "n")


def _round(rows: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The lines after all points have told what they say of the tried ones."""
    x, f = F.col("x") - F.col("middle"), F.col("f")
    r = F.col("y") - F.col("try_m") * x - F.col("try_c")
    far = F.abs(r) > f
    told = rows.join(now, keys).select(*now.columns, x.alias("x"), r.alias("r"), F.when(far, 0.0).otherwise(1.0).alias("in"), F.when(far, f / F.abs(r)).otherwise(1.0).alias("w"))
    psi = F.col("w") * F.col("r")
    loss = F.when(F.col("in") == 1.0, F.col("r") * F.col("r")).otherwise(2 * f * F.abs(F.col("r")) - f * f)
    sums = told.groupBy(*now.columns).agg(
        F.sum(loss).alias("new_loss"), F.sum(psi).alias("g0"), F.sum(psi * F.col("x")).alias("g1"),
        *[F.sum(F.col(w) * F.pow("x", F.lit(float(k)))).alias(f"{w}{k}") for w in ("in", "w") for k in range(3)],
    )
    better = F.col("new_loss") <= F.col("loss")
    (newton_m, newton_c), (safe_m, safe_c) = _step("in0", "in1", "in2"), _step("w0", "w1", "w2")
    enough = F.col("in0") >= 2
    newton_m, newton_c = F.when(enough, newton_m).otherwise(safe_m), F.when(enough, newton_c).otherwise(safe_c)
    chosen = lambda yes, no: F.when(better, yes).otherwise(no)
    return sums.select(
        *keys, "middle", "n", "f",
        chosen(F.col("try_m") + newton_m, F.col("m") + F.col("safe_m")).alias("try_m"), chosen(F.col("try_c") + newton_c, F.col("c") + F.col("safe_c")).alias("try_c"),
        chosen(F.col("try_m"), F.col("m")).alias("m"), chosen(F.col("try_c"), F.col("c")).alias("c"), F.least("loss", "new_loss").alias("loss"),
        chosen(safe_m, F.col("safe_m")).alias("safe_m"), chosen(safe_c, F.col("safe_c")).alias("safe_c"),
    )


LINE_MODELS = ("auto", "linear", "linear_naive", "linear_hist", "linear_stitched")


def line_forecasts(samples: DataFrame, peaks: DataFrame, keys: list[str], recent_peaks: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """keys, model_id, next_ts, value of the five models that cross a line with the trend through the peaks.

    ``linear_naive`` fits the rows since the current trough, ``linear`` the late ones of them, ``auto`` the one or the
    other by the phase; ``linear_hist`` takes the median slope of the past episodes through the trough, and
    ``linear_stitched`` the slope of all their rows laid on one start. A model without a crossing has nulls.
    ``samples`` have keys, ts, value, event_id; ``peaks`` keys, ts, value, of which ``recent_peaks`` are used.
    """
    day = lambda c: micros(c) / float(DAY)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    tops = cut(peaks.select(*keys, "ts", "value").withColumn("place", place).filter(F.col("place") <= recent_peaks if recent_peaks else F.lit(True)).drop("place"))
    rows = samples.select(*keys, "ts", "value", "event_id").dropna(subset=["ts", "value"])
    trough = cut(current_trough(rows, tops, keys, p))
    past = cut(episodes(rows, tops, keys, p).filter(F.col("place") <= p.episodes))
    ends = rows.groupBy(*keys).agg(F.max("ts").alias("last_ts")).join(tops.groupBy(*keys).agg(F.max("ts").alias("last_peak"), F.count("*").alias("n_peaks")), keys)

    rise = rows.join(trough.select(*keys, "trough_ts"), keys).filter("ts >= trough_ts")
    ranked = rise.withColumns({"back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))})
    sizes = rise.join(ends.select(*keys, "last_ts"), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum((micros("ts") >= micros("last_ts") - int(p.late_hours * HOUR)).cast("long")).alias("recent"))
    late_n = F.least(F.ceil(F.col("n") * p.late_share), F.col("recent"))
    marked = ranked.join(sizes, keys).filter(F.col("n") >= p.fit_rows)
    late = marked.filter((late_n >= p.fit_rows) & (F.col("back") <= late_n))

    inside = in_intervals(rows, tops, keys).join(past.select(*keys, "prev_ts", "end_ts", "trough_ts", "trough_value"), [*keys, "prev_ts", "end_ts"]).filter("ts >= trough_ts")
    point = lambda frame, name, x, y, part=F.lit(""): frame.select(*keys, F.lit(name).alias("fit"), part.alias("part"), x.alias("x"), y.alias("y"))
    value, of = F.col("value"), day("ts")
    points = point(tops, "trend", of, value).unionByName(point(marked, "linear_naive", of, value)).unionByName(point(late, "linear", of, value))
    points = points.unionByName(point(inside, "episode", of, value, F.col("end_ts").cast("string"))).unionByName(point(inside, "stitched", of - day("trough_ts"), value - F.col("trough_value")))
    fits = cut(huber_lines(points, [*keys, "fit", "part"]))

    trend = fits.filter("fit = 'trend'").select(*keys, F.col("slope").alias("t_slope"), F.col("middle").alias("t_middle"), F.col("level").alias("t_level"))
    straight = fits.filter("fit IN ('linear', 'linear_naive')").select(*keys, F.col("fit").alias("model_id"), "slope", "middle", "level").join(ends, keys).withColumn("since", F.greatest(day("last_ts"), day("last_peak")))
    late_phase = phase(rows, trough, past, keys, p).select(*keys, "late")
    auto = straight.select(*keys).distinct().join(late_phase, keys, "left").select(*keys, F.when(F.col("late"), "linear_naive").otherwise("linear").alias("model_id"))
    auto = straight.join(auto, [*keys, "model_id"]).withColumn("model_id", F.lit("auto"))
    usual = fits.filter("fit = 'episode'").groupBy(*keys).agg(F.median("slope").alias("slope"), F.count("*").alias("n_episodes")).withColumn("model_id", F.lit("linear_hist"))
    pooled = fits.filter("fit = 'stitched'").select(*keys, "slope").join(usual.select(*keys, "n_episodes"), keys).withColumn("model_id", F.lit("linear_stitched"))
    anchored = usual.select(*keys, "slope", "n_episodes", "model_id").unionByName(pooled.select(*keys, "slope", "n_episodes", "model_id")).filter(F.col("n_episodes") >= p.episodes_least)
    anchored = anchored.join(trough, keys).join(ends, keys).withColumns({"since": F.greatest(day("trough_ts"), day("last_peak")), "middle": day("trough_ts"), "level": F.col("trough_value")})

    columns = [*keys, "model_id", "slope", "middle", "level", "since", "n_peaks"]
    lines = straight.select(*columns).unionByName(auto.select(*columns)).unionByName(anchored.select(*columns)).filter("n_peaks >= 2").join(trend, keys)
    at = lambda slope, middle, level: F.col(level) + F.col(slope) * (F.col("since") - F.col(middle))
    m1, b1, m2, b2 = F.col("slope"), at("slope", "middle", "level"), F.col("t_slope"), at("t_slope", "t_middle", "t_level")
    hit = crossing(m1, b1, m2, b2, F.lit(0.0), F.lit(float(p.horizon_days)), p.value_limit)
    found = lines.select(*keys, "model_id", (hit + F.col("since")).alias("day"), (m2 * hit + b2).alias("value"))
    every = samples.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(m) for m in LINE_MODELS])).alias("model_id"))
    return every.join(found, [*keys, "model_id"], "left").select(*keys, "model_id", from_micros(F.round(F.col("day") * float(DAY)).cast("long")).alias("next_ts"), "value")
