"""Stored forms, reports, guards, forecasts' diagnostics and curves, late rows of streams."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions.timebuckets import HOUR
from strandline.operators import archive, forecast, joins, peaks, reconcile, state, text, windows
from strandline.params import Params
from strandline.sources import history
from strandline.streaming import pipelines

SCHEMA = "event_id long, series_id int, source string, ts timestamp_ntz, value double"
S, K = ["series_id"], ["series_id", "source"]


def frame(spark, rows):
    """rows: (source, minutes, value)."""
    start = pd.Timestamp("2025-01-01")
    return spark.createDataFrame([(k, 0, s, (start + pd.Timedelta(minutes=m)).to_pydatetime(), v) for k, (s, m, v) in enumerate(rows)], SCHEMA)


def test_two_axis_recordings(spark, tmp_path):
    for k, shift in enumerate((0.0, 10.0)):
        lines = [" UTCDateTime , Xtilt(microrad),Ytilt(microrad) "] + [f"2025-01-0{k + 1} 00:{m:02d}:00,{shift + m},0" for m in range(0, 60, 10)]
        (tmp_path / f"part_{k}.csv").write_text("\n".join(lines) + "\nbroken,1,1\n")
    got = history.read_two_axes(spark, str(tmp_path / "part_0.csv"), str(tmp_path / "part_1.csv"), degrees=90.0).orderBy("segment", "ts").collect()
    assert [(r.segment, str(r.ts), round(r.value, 6)) for r in got] == [(1, "2025-01-01 00:00:00", 10.0), (1, "2025-01-01 00:30:00", 40.0), (2, "2025-01-02 00:00:00", 20.0), (2, "2025-01-02 00:30:00", 50.0)]
    assert history.read_two_axes(spark, str(tmp_path / "none.csv")).count() == 0


def test_quality_log_of_both_layouts(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "2025-01-01", 0.5, 3)], "source string, run_timestamp_utc string, y_slope double, rows_appended int").withColumns({"frame_offset_microrad": F.lit(1.5), "frame_overlap_buckets": F.lit(9)})
    history.append_quality(rows, log)
    history.append_quality(rows.withColumn("run_timestamp_utc", F.lit("2025-01-02")), log)
    old = [str(k) for k in range(23)]
    (tmp_path / "old.csv").write_text(",".join(history.QUALITY[:12] + history.QUALITY[15:]) + "\n" + ",".join(old) + "\n")
    got = history.read_quality(spark, f"{log}/source=a").orderBy("run_timestamp_utc").collect()
    assert [(r.run_timestamp_utc, r.y_slope, r.rows_appended, r.frame_overlap_buckets) for r in got] == [("2025-01-01", "0.5", "3", "9"), ("2025-01-02", "0.5", "3", "9")]
    row = history.read_quality(spark, str(tmp_path / "old.csv")).first()
    assert row.x_span_hours == "11" and row.x_tick_cross_check_count is None and row.title_psm_used == "12" and row.frame_overlap_buckets == "22"


def test_reports_are_written_kept_and_pruned(spark, tmp_path):
    reports = spark.range(5).select(
        F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2025-01-01 00:00:00.123456").cast("timestamp_ntz")).alias("run_started_at_utc"),
        F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.struct(k.alias("n"), (k * F.pow(F.lit(-1.0), k)).alias("delta"))).alias("failures"),
    )
    out = str(tmp_path / "reports")
    history.write_reports(reports, out, "failures")
    got = spark.read.json(out).orderBy("run_started_at_utc").collect()
    assert len(got) == 5 and got[0].run_started_at_utc == "2025-01-01T00:00:00.123456+00:00" and got[0].failures_total == 30
    assert [f.n for f in got[0].failures] == list(range(30, 10, -1))
    assert history.keep_newest(reports, 2).count() == 2
    back = history.read_reports(spark, out)
    assert sorted(r.run_started_at_utc[:10] for r in back.collect()) == [f"2025-01-0{k}" for k in range(1, 6)]
    assert history.latest_report(back).first().run_started_at_utc.startswith("2025-01-05")
    history.write_reports(reports.limit(1).unionByName(reports.limit(1)).withColumn("run_started_at_utc", F.lit("2025-02-01 00:00:00").cast("timestamp_ntz")), out, "failures")
    assert history.read_reports(spark, out).count() == 6
    assert history.prune_reports(spark, out, 2) == 4
    assert sorted(r.run_started_at_utc[:10] for r in history.read_reports(spark, out).collect()) == ["2025-01-05", "2025-02-01"]
    files = tmp_path / "files"
    files.mkdir()
    for k in range(5):
        (files / f"{k}.json").write_text("{}")
    assert history.prune_reports(spark, str(files), 3) == 2 and sorted(f.name for f in files.iterdir()) == ["2.json", "3.json", "4.json"]


def test_exports(spark, tmp_path):
    s = frame(spark, [("view", 60 * k, float(k)) for k in range(72)])
    history.export_range(s, str(tmp_path / "range"), "2025-01-01", "2025-01-02")
    assert spark.read.option("header", True).csv(str(tmp_path / "range")).count() == 48
    history.export_bundle({"flat": s.select("value"), "nested": s.select(F.array("value").alias("v")).limit(2)}, str(tmp_path / "bundle"))
    assert glob.glob(str(tmp_path / "bundle/flat/*.csv")) and spark.read.json(str(tmp_path / "bundle/nested")).count() == 2


def test_source_table(spark):
    table = spark.createDataFrame([("a", 0.5, True, False), ("b", 0.1, False, False), ("c", None, False, True)], "source string, resolution double, is_anchor boolean, is_archive boolean")
    known = reconcile.Sources.from_table(table)
    assert known == reconcile.Sources({"a": 0.5, "b": 0.1}, "a", "c")
    got = table.select("source", known.resolution_of(F.col("source")).alias("r")).collect()
    assert {r.source: r.r for r in got} == {"a": 0.5, "b": 0.1, "c": float("inf")}
    with pytest.raises(ValueError):
        reconcile.Sources.from_table(table, most=2)


def test_anchor_map_and_overlay(spark):
    s = frame(spark, [("a", 60 * k, float(k)) for k in range(100)] + [("b", 60 * k, 2.0 * k + 30) for k in range(100)] + [("c", 60 * k, k + 0.5) for k in range(100)])
    fits = reconcile.anchor_fits(s, S, "a")
    assert {r.source: r.apply for r in fits.collect()} == {"b": True, "c": False}
    offsets = spark.createDataFrame([(0, "c", 0.5)], "series_id int, source string, b double")
    got = reconcile.overlay(s, fits, offsets, S).groupBy("source").agg(F.max(F.abs(F.col("value") - F.floor(F.timestamp_diff("MINUTE", F.lit("2025-01-01").cast("timestamp_ntz"), "ts") / 60))).alias("off"))
    assert all(r.off < 1e-6 for r in got.collect())


def test_drift_guard_refits_the_intercept(spark):
    axes = spark.createDataFrame([("i", 2.0, 5.0, 9.0)], "image string, slope double, intercept double, max_residual double")
    past = spark.createDataFrame([("i", 1.0)] * 3, "image string, slope double")
    labels = spark.createDataFrame([("i", 0.0, 10.0, 100.0), ("i", 10.0, 20.0, 100.0), ("i", 20.0, 36.0, 50.0)], "image string, px double, value double, conf double")
    row = state.drift_guard(axes, past, ["image"], labels=labels).first()
    assert row.fallback and row.used_slope == 1.0 and abs(row.used_intercept - (10 + 10 + 16 * 0.5**4) / (2 + 0.5**4)) < 1e-9


def test_append_warns(spark):
    known = frame(spark, [("view", 15 * k, float(k % 7)) for k in range(80)] + [("click", 0, 1.0)])
    new = frame(spark, [("view", 15 * k, float(k % 7) + 6.0) for k in range(60, 100)] + [("error", 5000, 1.0)])
    got = {r.source: r for r in archive.append_report(known, new, K).collect()}
    assert got["view"].warnings == ["large offset"] and abs(got["view"].offset - 6) < 1e-9 and got["view"].conflicts == 0 and (got["view"].added, got["view"].updated) == (20, 20)
    assert got["error"].warnings == ["no overlap: appended as it is"] and got["error"].added == 1


def test_neighbours_of_series_with_the_same_ids(spark):
    one = frame(spark, [("view", 0, 1.0), ("view", 20, 2.0)])
    both = one.unionByName(one.withColumns({"series_id": F.lit(1), "value": F.col("value") + 100}))
    assert joins.close_neighbours(both, both, S).count() == 4
    assert archive.frame_offsets(both, both, K).select("n_pairs").distinct().collect() == [(2,)]


def test_age_of_broken_headers(spark):
    now = F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")
    age = lambda *h: text.data_age(spark.createDataFrame([(x,) for x in h], "h string"), "h", now).first().age_seconds
    assert age("Wed, 01 Jan 2025 12:00:00 GMT", "soon", None) == 43200.0 and age("soon", None) == float("inf")


def test_short_recent_slices_are_empty(spark):
    s = frame(spark, [("view", 0, 1.0), ("click", 0, 1.0), ("click", 10, 2.0)])
    assert {r.source for r in windows.recent_slice(s, K).collect()} == {"click"}


def test_prominence_equals_a_plain_search(spark):
    draw = np.random.default_rng(3)
    series = [np.round(draw.normal(0, 3, 200)) for _ in range(20)]
    hours = pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(200), unit="h")
    grid = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "ts": hours, "value": v}) for k, v in enumerate(series)])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = peaks.prominent(grid, S, Params(distance_days=0.0, prominence=0.0, chunk=31 * HOUR), stretch=0).toPandas()
    found["at"] = ((found.ts - hours[0]) / pd.Timedelta("1h")).astype(int)
    assert len(found) > 20 * 20
    for k, v in enumerate(series):
        for t, p in found[found.series_id == k][["at", "prominence"]].itertuples(index=False):
            left, right = np.flatnonzero(v[:t] > v[t]), np.flatnonzero(v[t + 1 :] > v[t])
            a, b = left[-1] if len(left) else 0, t + 1 + right[0] if len(right) else len(v)
            assert p == v[t] - max(v[a : t + 1].min(), v[t:b].min())


def test_flat_tops_are_no_rows_of_peak_prominence(spark, tmp_path):
    import duckdb

    from strandline.plans import queries

    values = [1.0, 9.0, 9.0, 1.0, 12.0, 1.0, 7.5, 7.5, 7.5, 0.0, 20.0, 20.0, 3.0, 9.0, 2.0, 9.0, 9.0]
    hours = [(k, (pd.Timestamp("2025-01-01 00:10") + pd.Timedelta(hours=k)).to_pydatetime(), 0, "view", v, "{}") for k, v in enumerate(values)]
    events = spark.createDataFrame(hours, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = {(r.ts, r.value, r.prominence) for r in queries.peak_prominence(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = duck.execute(queries.oracle_sql()["peak_prominence"]).fetchall()
    assert found == {r[1:] for r in wanted} and sorted(r.ts.hour for r in queries.peak_prominence(spark, str(tmp_path)).collect()) == [4, 13]
    # The operator counts flat tops unless told otherwise.
    grid = events.select(F.lit(0).alias("series_id"), F.col("ts"), "value")
    tops = {flat: sorted(r.ts.hour for r in peaks.local_maxima(grid, S, flat=flat).collect()) for flat in (True, False)}
    assert tops == {True: [1, 4, 7, 10, 13], False: [4, 13]}


def test_diagnostics_curves_and_both_forecasts(spark):
    hours = np.arange(8 * 12 * 24)
    day = hours / 24
    value = 10 * ((day % 12) / 12) + np.random.default_rng(0).normal(0, 0.05, len(day))
    rows = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2025-01-01") + pd.to_timedelta(hours, unit="h"), "value": value, "event_id": hours, "series_id": 0}))
    rows = rows.select(F.col("series_id").cast("int").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_id").filter("ts < '2025-04-03'").cache()
    tops = peaks.detect_peaks(rows, S).cache()
    p = Params(draws=25)
    out = forecast.forecast(rows, tops, S, p=p).cache()
    numbers = {r.model_id: r.diagnostics for r in out.collect()}
    assert {"slope", "rmse", "phase"} <= set(numbers["auto"]) and {"a", "p", "c"} <= set(numbers["power_law"]) and abs(numbers["interval_median"]["median_days"] - 12) < 0.2
    both = forecast.both_forecasts(out, S).first()
    assert both.interval_next_ts is not None and {"A", "k", "C", "median_days"} <= set(both.diagnostics)
    lines = forecast.forecast_curves(rows, tops, S, ["linear", "linear_hist"], p=p).toPandas()
    assert set(lines.kind) == {"curve", "trend"} and (lines.groupby(["model_id", "kind"]).size() == forecast.GRID_POINTS).all()
    assert (lines.low <= lines.high + 1e-9).all() and lines.low.notna().all()


def test_late_rows_reach_the_raw_buckets_but_not_the_archive(spark, tmp_path):
    landed = str(tmp_path / "in")
    first = frame(spark, [("view", 0, 1.0), ("click", 1, 1.2), ("view", 60 * 24 * 9, 2.0)])
    first.write.parquet(landed)
    read = lambda: spark.readStream.schema(first.schema).parquet(landed)

    def run():
        pipelines.upsert_buckets(read(), K, str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination(60)
        pipelines.keep_first_archive(read(), S, str(tmp_path / "ar"), str(tmp_path / "c2")).awaitTermination(60)

    run()
    frame(spark, [("view", 2, 7.0)]).withColumn("event_id", F.lit(50).cast("long")).write.mode("append").parquet(landed)
    run()
    assert 7.0 in {r.value for r in pipelines.current(spark, str(tmp_path / "up")).collect()}
    assert {r.value for r in pipelines.current(spark, str(tmp_path / "ar/archive")).collect()} == {1.2}
    means = pipelines.window_means(read(), K, "15 minutes", late="1 day")
    means.writeStream.format("memory").queryName("late_means").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("late_means").count() >= 1
