"""Forecasting models of the next peak, run for many series at once.

A model is a function of one series' samples and peaks that returns a ``Forecast``; models are registered by id and run
side by side in one grouped pass per series. None of them raises: what cannot be fitted gives an empty forecast with
the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.robust import curve_crossing, huber_line, line_crossing, power_law, saturation
from strandline.functions.timebuckets import DAY, micros
from strandline.operators.peaks import episodes
from strandline.operators.state import interval_forecast
from strandline.params import DEFAULTS, Params


@dataclass
class Forecast:
    day: float | None = None
    low: float | None = None
    high: float | None = None
    value: float | None = None
    note: str = ""
    numbers: dict[str, float] = field(default_factory=dict)
    #: Lines to draw: (kind, days, values, low, high); low and high are null without draws.
    curves: list[tuple] = field(default_factory=list)


@dataclass
class Series:
    """Samples (day, value) in time order, and peaks in time order."""

    day: np.ndarray
    value: np.ndarray
    peak_day: np.ndarray
    peak_value: np.ndarray
    p: Params = DEFAULTS
    #: The series with samples of later, where it has the same ones up to the last peak: what is known of the past is its.
    later: Series | None = None

    def until(self, day: float) -> Series:
        """The series as it was known on a day, with the same peaks; fits of the past are made once for all such days."""
        n = int(np.searchsorted(self.day, day, "right"))
        whole = not len(self.peak_day) or n >= np.searchsorted(self.day, self.peak_day[-1], "right")
        return Series(self.day[:n], self.value[:n], self.peak_day, self.peak_value, self.p, self if whole else None)

    @cached_property
    def trend(self):
        return self.later.trend if self.later else huber_line(self.peak_day, self.peak_value)

    @cached_property
    def trough(self) -> float | None:
        if not len(self.peak_day):
            return None
        last = self.peak_day[-1]
        at = np.flatnonzero((self.day > last) & (self.day <= last + self.p.trough_search / DAY))
        return float(self.day[at[np.argmin(self.value[at])]]) if len(at) else None

    @cached_property
    def rise(self) -> tuple[np.ndarray, np.ndarray]:
        """Samples from the current trough on."""
        if self.trough is None:
            return np.empty(0), np.empty(0)
        at = self.day >= self.trough
        return self.day[at], self.value[at]

    @cached_property
    def episodes(self) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        """(trough day, peak day, days, values) of the latest complete build-ups."""
        if self.later:
            return self.later.episodes
        found = []
        for prev, cur in zip(self.peak_day[:-1], self.peak_day[1:], strict=True):
            inside = np.flatnonzero((self.day > prev) & (self.day <= cur))
            early = inside[self.day[inside] <= prev + self.p.trough_search / DAY]
            if len(inside) < self.p.episode_rows or not len(early):
                continue
            rows = inside[inside >= early[np.argmin(self.value[early])]]
            if len(rows) >= self.p.episode_rows:
                found.append((float(self.day[rows[0]]), float(cur), self.day[rows], self.value[rows]))
        return found[-self.p.episodes :]

    @cached_property
    def slopes(self) -> list[float]:
        """Slopes of the robust lines through the episodes."""
        return self.later.slopes if self.later else [huber_line(d, v).slope for _, _, d, v in self.episodes]

    @cached_property
    def stitched(self) -> float:
        """Slope of one robust line through all episodes, laid on each other at their troughs."""
        if self.later:
            return self.later.stitched
        pool = [(d - d[0], v - v[0]) for _, _, d, v in self.episodes]
        return huber_line(np.concatenate([d for d, _ in pool]), np.concatenate([v for _, v in pool])).slope

    @cached_property
    def exponents(self) -> list[float]:
        """Exponents of the power laws of the episodes."""
        return self.later.exponents if self.later else [power_law((d - d[0]) * 24, v)[1] for _, _, d, v in self.episodes]

    @cached_property
    def phase(self) -> float | None:
        """Time since the trough as a share of the median build-up."""
        if self.trough is None or len(self.episodes) < self.p.episodes_least:
            return None
        usual = float(np.median([peak - low for low, peak, _, _ in self.episodes]))
        return max(float(self.day[-1]) - self.trough, 0.0) / usual if usual > 0 else None


Model = Callable[[Series], Forecast]
_MODELS: dict[str, Model] = {}


def register(model_id: str) -> Callable[[Model], Model]:
    def add(model: Model) -> Model:
        if model_id in _MODELS:
            raise ValueError(f"model {model_id} is registered already")
        _MODELS[model_id] = model
        return model

    return add


def list_models() -> list[str]:
    return list(_MODELS)


def get_model(model_id: str) -> Model:
    return _MODELS[model_id]


GRID_POINTS = 200


def _outcome(s: Series, hit: tuple | None, curve: Callable, draw_curve: Callable[[np.random.Generator], Callable | None], cross: Callable, since: float, numbers: dict, trend: Callable | None = None) -> Forecast:
    """A forecast with its band and curves from joint draws of the curve and the trend through the peaks.

    The band has 10 % and 90 % of the crossing days, none below ten crossings; the ribbons have the same shares of the
    drawn values at every point of a grid, the curve's from ``since`` and the trend's from the first peak to the
    crossing, or to the horizon without one.
    """
    draw, days = np.random.default_rng(0), []
    end = hit[0] if hit else max(float(s.day[-1]), float(s.peak_day[-1])) + s.p.horizon_days
    grids = [np.linspace(start, max(end, start), GRID_POINTS) for start in (since, float(s.peak_day[0]))]
    drawn: tuple[list, list] = [], []
    for _ in range(s.p.draws):
        sample = draw_curve(draw)
        at = draw.integers(0, len(s.peak_day), len(s.peak_day))
        if sample is None or len(np.unique(s.peak_day[at])) < 2:
            continue
        slope, level = np.polyfit(s.peak_day[at] - s.peak_day[0], s.peak_value[at], 1)
        through = lambda x, m=slope, b=level: m * (np.asarray(x) - s.peak_day[0]) + b
        for lines, f, grid in zip(drawn, (sample, through), grids, strict=True):
            lines.append(np.asarray(f(grid), dtype=float))
        crossing = cross(sample, through)
        if crossing is not None:
            days.append(crossing[0])
    days.sort()
    low, high = (days[int(0.1 * len(days))], days[min(int(0.9 * len(days)), len(days) - 1)]) if len(days) >= 10 else (None, None)
    curves = []
    for kind, f, grid, lines in (("curve", curve, grids[0], drawn[0]), ("trend", trend or s.trend, grids[1], drawn[1])):
        ribbon = np.quantile(np.array(lines), (0.1, 0.9), axis=0) if lines else (None, None)
        curves.append((kind, grid, np.asarray(f(grid), dtype=float), *ribbon))
    day, value = hit if hit else (None, None)
    return Forecast(day, low, high, value, "" if hit else "no crossing", numbers, curves)


def _straight(f: Callable, origin: float) -> tuple[float, float]:
    b = float(np.asarray(f(np.array([origin]))).item())
    return float(np.asarray(f(np.array([origin + 1.0]))).item()) - b, b


def _cross_lines(earliest: float, latest: float, limit: float) -> Callable:
    def cross(curve: Callable, trend: Callable):
        (m1, b1), (m2, b2) = _straight(curve, earliest), _straight(trend, earliest)
        hit = line_crossing(m1, b1, m2, b2, 0.0, latest - earliest, limit)
        return None if hit is None else (hit[0] + earliest, hit[1])

    return cross


def _linear(s: Series, late: bool) -> Forecast:
    day, value = s.rise
    if len(s.peak_day) < 2 or len(day) < s.p.fit_rows:
        return Forecast(note="too few peaks or rows")
    if late:
        hours = (day - day[0]) * 24
        n = min(int(np.ceil(len(day) * s.p.late_share)), int((hours >= hours[-1] - s.p.late_hours).sum()))
        day, value = day[-n:], value[-n:]
        if n < s.p.fit_rows:
            return Forecast(note="too few rows in the late window")
    fit = huber_line(day, value)
    earliest = max(float(s.day[-1]), float(s.peak_day[-1]))
    cross = _cross_lines(earliest, earliest + s.p.horizon_days, s.p.value_limit)
    hit = cross(fit, s.trend)
    noise = value - fit(day)

    def draw_curve(draw: np.random.Generator):
        return huber_line(day, fit(day) + draw.choice(noise, len(noise)), fit.scale)

    return _outcome(s, hit, fit, draw_curve, cross, float(day[0]), {"slope": fit.slope, "rmse": fit.rmse, "downweighted": fit.downweighted, "rows": float(fit.n)})


@register("auto")
def auto(s: Series) -> Forecast:
    late = s.phase is not None and s.phase >= s.p.phase_switch
    out = _linear(s, late=not late)
    return replace(out, numbers=out.numbers | ({} if s.phase is None else {"phase": s.phase}) | {"naive": float(late)})


@register("linear")
def linear(s: Series) -> Forecast:
    return _linear(s, late=True)


@register("linear_naive")
def linear_naive(s: Series) -> Forecast:
    return _linear(s, late=False)


def _anchored(s: Series, slopes: np.ndarray, slope: float) -> Forecast:
    """A line of the past episodes' slope through the current trough."""
    at = float(s.rise[1][0])
    earliest = max(s.trough, float(s.peak_day[-1]))
    cross = _cross_lines(earliest, earliest + s.p.horizon_days, s.p.value_limit)
    line = lambda m: lambda x: at + m * (np.asarray(x) - s.trough)
    hit = cross(line(slope), s.trend)
    draw_curve = lambda draw: line(float(np.median(draw.choice(slopes, len(slopes)))))
    return _outcome(s, hit, line(slope), draw_curve, cross, float(s.trough), {"slope": slope, "episodes": float(len(slopes))})


@register("linear_hist")
def linear_hist(s: Series) -> Forecast:
    if len(s.peak_day) < 2 or s.trough is None or len(s.episodes) < s.p.episodes_least:
        return Forecast(note="too few episodes")
    return _anchored(s, np.array(s.slopes), float(np.median(s.slopes)))


@register("linear_stitched")
def linear_stitched(s: Series) -> Forecast:
    if len(s.peak_day) < 2 or s.trough is None or len(s.episodes) < s.p.episodes_least:
        return Forecast(note="too few episodes")
    return _anchored(s, np.array(s.slopes), s.stitched)


def _power(s: Series, exponent: float | None) -> Forecast:
    day, value = s.rise
    if len(s.peak_day) < 2 or len(day) < s.p.fit_rows:
        return Forecast(note="too few peaks or rows")
    hours = (day - day[0]) * 24
    a, q, c = power_law(hours, value, exponent)
    curve = lambda x, a=a, q=q, c=c: a * np.maximum((np.asarray(x) - day[0]) * 24, 1e-3) ** q + c
    start = max(float(s.day[-1]), float(s.peak_day[-1]))
    cross = lambda f, g: curve_crossing(f, g, start, s.p.horizon_days, s.p.value_limit)
    hit = cross(curve, s.trend)
    noise = value - curve(day)

    def draw_curve(draw: np.random.Generator):
        a2, q2, c2 = power_law(hours, curve(day) + draw.choice(noise, len(noise)), q)
        return lambda x: a2 * np.maximum((np.asarray(x) - day[0]) * 24, 1e-3) ** q2 + c2

    return _outcome(s, hit, curve, draw_curve, cross, float(day[0]), {"a": a, "p": q, "c": c, "rmse": float(np.sqrt(np.mean(noise**2)))})


@register("power_law")
def power(s: Series) -> Forecast:
    return _power(s, None)


@register("power_law_hist_p")
def power_hist(s: Series) -> Forecast:
    if len(s.episodes) < s.p.episodes_least:
        return Forecast(note="too few episodes")
    return _power(s, float(np.median(s.exponents)))


@register("trendline_exp")
def trendline_exp(s: Series) -> Forecast:
    day, value = s.rise
    if len(s.peak_day) < 2 or len(day) < 4:
        return Forecast(note="too few peaks or rows")
    slope, level = np.polyfit(s.peak_day - s.peak_day[0], s.peak_value, 1)
    trend = lambda x: slope * (np.asarray(x) - s.peak_day[0]) + level
    a, k, c = saturation(day, value)
    curve = lambda x, a=a, k=k, c=c: a * (1 - np.exp(-k * (np.asarray(x) - day[0]))) + c
    start = max(float(s.day[-1]), float(s.peak_day[-1]))
    cross = lambda f, g: curve_crossing(f, g, start, s.p.horizon_days, s.p.value_limit)
    hit = cross(curve, trend)
    # Parameter noise from the curvature of the fit, as for any nonlinear least squares.
    x = day - day[0]
    slopes = np.column_stack([1 - np.exp(-k * x), a * x * np.exp(-k * x), np.ones(len(x))])
    spread = np.linalg.pinv(slopes.T @ slopes) * max(float(((value - curve(day)) ** 2).sum()) / max(1, len(x) - 3), 0.0)

    def draw_curve(draw: np.random.Generator):
        a2, k2, c2 = draw.multivariate_normal([a, k, c], spread, check_valid="ignore")
        return None if a2 <= 0 or k2 <= 0 else lambda t: a2 * (1 - np.exp(-k2 * (np.asarray(t) - day[0]))) + c2

    return _outcome(s, hit, curve, draw_curve, cross, float(day[0]), {"A": a, "k": k, "C": c, "trend_slope": float(slope)}, trend)


@register("ffm_voight")
def failure_forecast(s: Series) -> Forecast:
    """Inverse rate falling in a straight line to zero."""
    day, value = s.rise
    day, first = np.unique(day, return_index=True)
    value = value[first]
    if len(day) < 24:
        return Forecast(note="too few rows")
    hours = (day - day[0]) * 24
    raw = np.gradient(value, hours)
    rate = np.array([np.median(raw[max(0, i - 3) : i + 3]) for i in range(len(raw))])
    rising = rate > 0.005
    if rising.sum() < 24:
        return Forecast(note="rate is not reliably positive")
    fit = huber_line(hours[rising], 1 / rate[rising])
    if fit.slope >= 0:
        return Forecast(note="rate is slowing down")
    failure = -fit.intercept / fit.slope
    if failure <= hours[-1] or failure / 24 > s.p.horizon_days:
        return Forecast(note="failure time out of range")
    return Forecast(day=float(day[0] + failure / 24), numbers={"slope": fit.slope})


@register("interval_median")
def interval_median(s: Series) -> Forecast:
    if len(s.peak_day) < 2:
        return Forecast(note="too few peaks")
    gaps, last = np.diff(s.peak_day), float(s.peak_day[-1])
    low, high = (last + float(np.quantile(gaps, q)) for q in (0.25, 0.75)) if len(gaps) >= 3 else (None, None)
    return Forecast(last + float(np.median(gaps)), low, high, numbers={"median_days": float(np.median(gaps)), "mean_days": float(np.mean(gaps)), "intervals": float(len(gaps))})


def _days(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() / DAY


def _stamp(day: float | None) -> pd.Timestamp:
    return pd.NaT if day is None or not np.isfinite(day) else pd.Timestamp(round(day * DAY), unit="us")


#: Models that look at the peaks only.
PEAKS_ONLY = ("interval_median",)


def _complete(samples: DataFrame, peaks: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """keys, prev_ts, done_ts, place of the complete episodes, the latest first."""
    rows = samples.select(*keys, "ts", "value", F.lit(0).cast("long").alias("event_id"))
    return episodes(rows, peaks, keys, p).select(*keys, "prev_ts", F.col("end_ts").alias("done_ts"), "place")


def _in_use(samples: DataFrame, peaks: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """The samples that any model reads: since the peak before the first of the complete episodes in use; all of them without peaks."""
    first = _complete(samples, peaks, keys, p).filter(F.col("place") <= p.episodes).groupBy(*keys).agg(F.min("prev_ts").alias("first"))
    last = peaks.groupBy(*keys).agg(F.max("ts").alias("last"))
    begins = last.join(first, keys, "left").select(*keys, F.coalesce("first", "last").alias("begins"))
    return samples.join(begins, keys, "left").filter(F.col("begins").isNull() | (F.col("ts") >= F.col("begins"))).drop("begins")


def _series(rows: pd.DataFrame, tops: pd.DataFrame, p: Params) -> Series:
    rows, tops = rows.sort_values("ts"), tops.sort_values("ts")
    return Series(_days(rows["ts"]), rows["value"].to_numpy(dtype=float), _days(tops["ts"]), tops["value"].to_numpy(dtype=float), p)


def _made(model_id: str, s: Series) -> Forecast:
    try:
        return get_model(model_id)(s) if len(s.day) or model_id in PEAKS_ONLY else Forecast(note="no rows")
    except (ValueError, np.linalg.LinAlgError, IndexError) as error:
        return Forecast(note=f"failed: {error}")


def _dealt(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Groups for all cores: what fits cost does not show in the bytes by which Spark unites small partitions."""
    spark = frame.sparkSession
    return frame.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _runs(samples: DataFrame, peaks: DataFrame, keys: list[str], wanted: list[str], recent_peaks: int | None, p: Params, rows_of: Callable, schema: str, bounded: bool = False) -> DataFrame:
    """``rows_of`` (key, model, forecast) for every model on every series; one series' samples in use are held by one task."""

    def run(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        s = _series(rows, tops.sort_values("ts").tail(recent_peaks) if recent_peaks else tops, p)
        out = []
        for model_id in wanted:
            out += rows_of(key, model_id, _made(model_id, s))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    # Fresh column identities: both sides may stem from one table.
    left, right = (f.select(*keys, "ts", "value").toDF(*keys, "ts", "value") for f in (samples, peaks))
    if not set(wanted) <= set(PEAKS_ONLY):
        left = left if bounded else _in_use(left, right.toDF(*right.columns), keys, p).select(*keys, "ts", "value")
    else:
        left = left.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    return _dealt(left, keys).groupBy(*keys).cogroup(_dealt(right, keys).groupBy(*keys)).applyInPandas(run, schema)


def _kinds(samples: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)


def forecast(samples: DataFrame, peaks: DataFrame, keys: list[str], models: list[str] | None = None, recent_peaks: int | None = None, p: Params = DEFAULTS, bounded: bool = False) -> DataFrame:
    """One row per series and model: keys, model_id, next_ts, band_low, band_high, value, note, diagnostics.

    Every model gives a row, with a note where it has no forecast. Series run in parallel; only samples since the first
    of the complete episodes in use are read, unless ``bounded`` says that no others are given. ``recent_peaks`` keeps only
    the last peaks.
    """
    row = lambda key, model_id, f: [(*key, model_id, _stamp(f.day), _stamp(f.low), _stamp(f.high), f.value, f.note, {k: float(v) for k, v in f.numbers.items()})]
    schema = f"{_kinds(samples, keys)}, model_id string, next_ts timestamp_ntz, band_low timestamp_ntz, band_high timestamp_ntz, value double, note string, diagnostics map<string,double>"
    return _runs(samples, peaks, keys, models or list_models(), recent_peaks, p, row, schema, bounded)


def forecast_curves(samples: DataFrame, peaks: DataFrame, keys: list[str], models: list[str] | None = None, recent_peaks: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """What is drawn of the models: keys, model_id, kind (curve or trend), ts, value, low and high (10 % and 90 % of the draws)."""

    def rows(key: tuple, model_id: str, f: Forecast) -> list:
        out = []
        for kind, days, values, low, high in f.curves:
            bands = (low, high) if low is not None else ([None] * len(days),) * 2
            out += [(*key, model_id, kind, _stamp(d), float(v), a if a is None else float(a), b if b is None else float(b)) for d, v, a, b in zip(days, values, *bands, strict=True)]
        return out

    schema = f"{_kinds(samples, keys)}, model_id string, kind string, ts timestamp_ntz, value double, low double, high double"
    return _runs(samples, peaks, keys, models or list_models(), recent_peaks, p, rows, schema)


def both_forecasts(forecasts: DataFrame, keys: list[str], model: str = "trendline_exp", plain: str = "interval_median") -> DataFrame:
    """One row per series with a curve model's forecast beside that of the plain intervals, and the diagnostics of both."""
    of = lambda name: forecasts.filter(F.col("model_id") == name)
    curve = of(model).select(*keys, "next_ts", "band_low", "band_high", "value", "note", F.col("diagnostics").alias("d1"))
    intervals = of(plain).select(*keys, *[F.col(c).alias(f"interval_{c}") for c in ("next_ts", "band_low", "band_high")], F.col("diagnostics").alias("d2"))
    joined = curve.join(intervals, keys, "full").withColumn("median_days", F.try_element_at("d2", F.lit("median_days")))
    empty = F.create_map().cast("map<string,double>")
    return joined.withColumn("diagnostics", F.map_concat(F.coalesce("d1", empty), F.coalesce("d2", empty))).drop("d1", "d2")


def backtest(samples: DataFrame, peaks: DataFrame, segments: DataFrame, keys: list[str], models: list[str] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Error in hours of every model at every stage of every past segment: keys, end_ts, fraction, model_id, error_h.

    ``segments`` has keys, end_ts, trough_ts. Each (segment, fraction) sees samples up to its cutoff and the prominent peaks
    before its target. The fractions of a segment are a task, for they share all peaks and the episodes between them: these
    are read and fitted once. Samples from before the episodes in use are not copied.
    """
    by, wanted = [*keys, "end_ts"], models or list_models()
    length = F.timestamp_diff("MICROSECOND", "trough_ts", "end_ts")
    cutoff = lambda f: F.timestamp_add("MICROSECOND", F.round(length * F.lit(f)).cast("long"), F.col("trough_ts"))
    tasks = segments.select(*by, F.array(*[F.struct(F.lit(f).alias("fraction"), cutoff(f).alias("cutoff")) for f in p.fractions]).alias("stages"))
    prominent = peaks.filter(F.col("prominence") > p.backtest_prominence).select(*keys, "ts", "value")
    known = prominent.join(tasks.select(*by), keys).filter("ts < end_ts")
    if wanted == ["interval_median"]:
        hit = interval_forecast(known, by).select(*by, F.col("next_us"))
        error = (F.col("next_us") - micros("end_ts")) / 3.6e9
        return tasks.join(hit, by, "left").select(*by, F.explode("stages.fraction").alias("fraction"), F.lit("interval_median").alias("model_id"), error.alias("error_h"))
    # The lower bound of what a task reads comes first, so that a sample is copied only to tasks that read it: episodes
    # before its target are the same for all tasks of a series.
    past = tasks.select(*by).join(_complete(samples, prominent.drop("value"), keys, p).drop("place"), keys).filter("done_ts < end_ts")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("done_ts")))
    first = past.withColumn("place", place).filter(F.col("place") <= p.episodes).groupBy(*by).agg(F.min("prev_ts").alias("first"))
    begins = known.groupBy(*by).agg(F.max("ts").alias("last")).join(first, by, "left").select(*by, F.coalesce("first", "last").alias("begins"))
    bounded = tasks.select(*by, F.array_max("stages.cutoff").alias("cutoff")).join(begins, by, "left")
    seen = samples.select(*keys, "ts", "value").join(bounded, keys).filter((F.col("ts") <= F.col("cutoff")) & (F.col("begins").isNull() | (F.col("ts") >= F.col("begins")))).select(*by, "ts", "value")
    none = F.lit(None)
    stages = tasks.select(*by, F.explode("stages").alias("stage")).select(*by, F.col("stage.cutoff").alias("ts"), none.cast("double").alias("value"), F.col("stage.fraction").alias("fraction"))
    marks = known.select(*by, "ts", "value", none.cast("double").alias("fraction")).unionByName(stages)

    def run(key: tuple, rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        whole = _series(rows, marks[marks["fraction"].isna()], p)
        stages, target, out = marks[marks["fraction"].notna()], np.datetime64(key[-1], "us").astype("int64"), []
        for fraction, day in zip(stages["fraction"], _days(stages["ts"]), strict=True):
            s = whole.until(day)
            for model_id in wanted:
                hit = _made(model_id, s).day
                out.append((*key, fraction, model_id, None if hit is None or not np.isfinite(hit) else (round(hit * DAY) - target) / 3.6e9))
        return pd.DataFrame(out, columns=[*by, "fraction", "model_id", "error_h"])

    schema = f"{_kinds(samples, keys)}, end_ts timestamp_ntz, fraction double, model_id string, error_h double"
    left, right = (_dealt(f.toDF(*f.columns), by).groupBy(*by) for f in (seen, marks))  # fresh column identities, as in _runs
    return left.cogroup(right).applyInPandas(run, schema)


def backtest_stats(errors: DataFrame) -> DataFrame:
    """Per model and fraction: n_scored, n_tasks, coverage, median and mean of absolute and signed errors."""
    e = F.col("error_h")
    return errors.groupBy("model_id", "fraction").agg(
        F.count(e).alias("n_scored"), F.count("*").alias("n_tasks"), (F.count(e) / F.count("*")).alias("coverage"),
        F.median(F.abs(e)).alias("median_abs"), F.avg(F.abs(e)).alias("mean_abs"), F.median(e).alias("median_signed"), F.avg(e).alias("mean_signed"),
    )


def best_models(stats: DataFrame, order: list[str] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """The model with the least median error per fraction, among those that cover enough; ties go to the first registered."""
    names = order or list_models()
    place = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model_id")), F.lit(len(names) + 1))
    w = Window.partitionBy("fraction").orderBy("median_abs", place, "model_id")
    fit = stats.filter((F.col("coverage") >= p.coverage) & F.col("median_abs").isNotNull())
    return fit.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def models_by_stage(stats: DataFrame, order: list[str] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """The comparison tables: fraction, place, model_id, coverage ('scored/tasks'), median_abs, median_signed, mean_signed, recommended.

    Models stand by their median absolute error, those that cover too little or have none last, ties as registered.
    The first of a fraction is recommended, unless it covers too little.
    """
    names = order or list_models()
    listed = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model_id")), F.lit(len(names) + 1))
    fit = (F.col("coverage") >= p.coverage) & F.col("median_abs").isNotNull()
    place = F.row_number().over(Window.partitionBy("fraction").orderBy(F.desc(fit), F.when(fit, F.col("median_abs")), listed, "model_id"))
    cells = F.concat_ws("/", F.col("n_scored").cast("string"), F.col("n_tasks").cast("string"))
    ranked = stats.withColumns({"place": place, "recommended": fit})
    return ranked.select("fraction", "place", "model_id", cells.alias("coverage"), "median_abs", "median_signed", "mean_signed", (F.col("recommended") & (F.col("place") == 1)).alias("recommended"))


def models_across_stages(stats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A row per model with its median absolute error at every fraction, in columns named by percent (at_25, ...)."""
    at = {f"at_{round(100 * f)}": F.max(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col("median_abs"))) for f in p.fractions}
    return stats.groupBy("model_id").agg(*[c.alias(name) for name, c in at.items()])
