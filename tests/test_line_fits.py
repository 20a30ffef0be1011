"""Robust lines from sums against the fits on arrays, and the models that rest on them against the registered ones."""

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions.robust import huber_line, huber_loss
from strandline.operators import forecast, line_fits, peaks
from strandline.params import DEFAULTS, Params

S = ["series_id"]


def cases():
    draw = np.random.default_rng(6)
    x = np.sort(draw.uniform(20_000, 20_060, 300))
    yield x, 3 + 0.2 * (x - 20_000) + draw.normal(0, 0.3, 300)
    yield x, np.where(draw.random(300) < 0.3, 500.0, 0.1 * (x - 20_000)) + draw.normal(0, 0.1, 300)
    yield x[:40], draw.standard_cauchy(40) * 10
    yield x[:2], np.array([1.0, 2.0])
    yield x[:15], np.full(15, 4.0)
    yield np.full(9, 7.0), draw.normal(0, 1, 9)
    yield x, np.round(draw.normal(0, 1, 300))
    yield x, 1e4 * np.sin(x) + draw.normal(0, 1e-3, 300)


def test_lines_are_those_of_reweighting(spark):
    data = list(cases())
    rows = [(k, float(a), float(b)) for k, (x, y) in enumerate(data) for a, b in zip(x, y, strict=True)]
    points = spark.createDataFrame([*rows, (90, 1.0, 2.0), (91, None, 2.0), (91, 1.0, None)], "series_id int, x double, y double")
    for scale in (None, 1.0):
        got = {r.series_id: r for r in line_fits.huber_lines(points, S, scale).collect()}
        assert set(got) == set(range(len(data)))
        for k, (x, y) in enumerate(data):
            want, r = huber_line(x, y, scale), got[k]
            line = r.level + r.slope * (x - r.middle)
            assert np.isclose(r.scale, want.scale, rtol=1e-9) and r.n == len(x)
            # Reweighting alone stops after 60 rounds, on wild points before the end.
            mine, theirs = huber_loss(y - line, want.scale), huber_loss(y - want(x), want.scale)
            assert mine <= theirs * (1 + 1e-9) + 1e-12, k
            if mine > theirs * (1 - 1e-9):
                assert np.allclose(line, want(x), rtol=1e-4, atol=1e-4 * (1 + np.abs(y).max())), k


def test_medians_are_exact(spark):
    draw = np.random.default_rng(1)
    lists = [draw.normal(0, 1, 1001), draw.normal(0, 1, 1000), draw.integers(0, 3, 500).astype(float), np.array([5.0]), np.array([1.0, 2.0]), np.concatenate([draw.normal(0, 1e-9, 999), [1e12]]), np.full(70, -3.0)]
    rows = spark.createDataFrame([(k, float(v)) for k, values in enumerate(lists) for v in values], "series_id int, v double").repartition(7)
    for cells in (1, 5, 4096):
        got = {r.series_id: r.median for r in line_fits.medians(rows, S, "v", cells).collect()}
        assert got == {k: float(np.median(values)) for k, values in enumerate(lists)}


def sawtooth(spark, days=105, length=13):
    hours = np.arange(days * 24)
    day = hours / 24
    value = 10 * ((day % length) / length) + np.random.default_rng(0).normal(0, 0.05, len(day))
    frame = pd.DataFrame({"ts": pd.Timestamp("2025-01-01") + pd.to_timedelta(hours, unit="h"), "value": value, "event_id": hours, "series_id": 1})
    return spark.createDataFrame(frame).select(F.col("series_id").cast("int").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")


def same(native, registered):
    a = native.set_index("model_id").loc[list(line_fits.LINE_MODELS)]
    b = registered.set_index("model_id").loc[list(line_fits.LINE_MODELS)]
    assert (a.next_ts.isna() == b.next_ts.isna()).all()
    assert ((a.next_ts - b.next_ts).dt.total_seconds().abs().fillna(0) < 1).all() and np.allclose(a.value, b.value, atol=1e-6, equal_nan=True)
    return a


def test_line_models_are_those_on_arrays(spark):
    for until, recent in (("2025-04-03", None), ("2025-04-12", 6), ("2025-02-03", None), ("2025-01-09", None)):
        rows = sawtooth(spark).filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        tops = peaks.detect_peaks(rows, S)
        p = replace(DEFAULTS, draws=0)
        got = same(line_fits.line_forecasts(rows, tops, S, recent, p).toPandas(), forecast.forecast(rows, tops, S, list(line_fits.LINE_MODELS), recent, p).toPandas())
        assert got.next_ts.notna().any() == (until != "2025-01-09")


def test_episodes_behind_many_short_intervals_still_count(spark):
    """Six whole episodes, then ten intervals with too few rows: the forecasts are those of the whole history."""
    start, ts, value = pd.Timestamp("2025-01-01"), [], []
    for length, n in [(120, 7), (20, 10), (60, 1)]:
        for _ in range(n):
            at = ts[-1] + pd.Timedelta("1h") if ts else start
            ts += [at + pd.Timedelta(hours=h) for h in range(length)]
            value += list(np.linspace(0, 9, length))
    rows = spark.createDataFrame(pd.DataFrame({"ts": ts, "value": value, "event_id": range(len(ts)), "series_id": 1})).select(F.col("series_id").cast("int").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    tops = peaks.local_maxima(rows.select("series_id", "ts", "value"), S)
    p = Params(draws=0)
    out = forecast.forecast(rows, tops, S, ["linear_hist", "linear_stitched", "power_law_hist_p"], p=p).toPandas()
    assert out.next_ts.notna().sum() >= 2 and not out.note.str.contains("too few").any(), out.note.tolist()
    whole = forecast._runs(rows, tops, S, ["linear_hist"], None, p, lambda key, m, f: [(*key, f.day)], "series_id int, day double", bounded=True).first()
    assert abs(whole.day - (out.next_ts[out.model_id == "linear_hist"].iloc[0] - pd.Timestamp(0)).total_seconds() / 86400) < 1e-6


def test_curve_crossings_in_the_jvm_are_those_on_arrays(spark):
    from strandline.functions.robust import curve_crossing
    from strandline.operators import state

    draw = np.random.default_rng(12)
    rows = [(k, float(a), float(c), float(m), float(b), float(s)) for k, (a, c, m, b, s) in enumerate(zip(draw.normal(0, 2, 80), draw.normal(0, 5, 80), draw.normal(0, 0.2, 80), draw.normal(3, 5, 80), draw.uniform(0, 50, 80), strict=True))]
    rows += [(80, 1.0, 0.0, 0.0, 3.0, 0.0), (81, 0.0, 1.0, 0.0, 1.0, 4.0), (82, 9.0, 0.0, 0.0, 60.0, 0.0)]  # meets on a step, is the trend, meets too high
    frame = spark.createDataFrame(rows, "k int, a double, c double, m double, b double, s double")
    hit = state.curve_crossing(lambda x: F.col("a") * F.sqrt(x) + F.col("c"), lambda x: F.col("m") * x + F.col("b"), F.col("s"))
    got = {r.k: r.hit for r in frame.withColumn("hit", hit).collect()}
    met = 0
    for k, a, c, m, b, s in rows:
        want = curve_crossing(lambda x: a * np.sqrt(x) + c, lambda x: m * x + b, s)
        assert (got[k] is None) == (want is None), k
        if want:
            met += 1
            assert abs(got[k].day - want[0]) < 1e-9 and abs(got[k].value - want[1]) < 1e-9
    assert met > 12
