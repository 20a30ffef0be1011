"""Edge cases, metamorphic properties, sources and streams of the engine."""

import glob
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions.timebuckets import QUARTER, from_micros, round_us
from strandline.operators import archive, joins, peaks, reconcile, text, windows
from strandline.params import Params
from strandline.sources import history
from strandline.streaming import pipelines

SCHEMA = "event_id long, series_id int, source string, ts timestamp_ntz, value double"
S, K = ["series_id"], ["series_id", "source"]
SOURCES = reconcile.Sources({"purchase": 0.1, "view": 0.2, "click": 0.3}, anchor="purchase", archive="error")


def frame(spark, rows):
    """rows: (source, minutes, value)."""
    start = pd.Timestamp("2025-01-01")
    return spark.createDataFrame([(k, 0, s, (start + pd.Timedelta(minutes=m)).to_pydatetime(), v) for k, (s, m, v) in enumerate(rows)], SCHEMA)


def test_half_buckets_round_to_even(spark):
    us = [0, 450_000_000, 1_350_000_000, 2_250_000_000, 449_999_999, -450_000_000]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u long").select(round_us(F.col("u"), QUARTER)).collect()]
    assert got == [0, 0, 1_800_000_000, 1_800_000_000, 0, 0]


def test_offsets_are_recovered_and_move_with_a_source(spark):
    draw = np.random.default_rng(0)
    truth = [10 * np.sin(k / 24) for k in range(400)]
    plan = {"purchase": (0.0, range(0, 250)), "view": (3.0, range(150, 400)), "click": (-2.0, range(300, 400)), "signup": (5.0, range(395, 400))}
    rows = [(s, 60 * k + int(draw.integers(0, 50)), float(truth[k] + b)) for s, (b, span) in plan.items() for k in span]
    s = frame(spark, rows)

    def solve(d):
        return {r.source: (r.b, r.reachable) for r in reconcile.solve_offsets(d, reconcile.pairwise_offsets(d, S), S, SOURCES).collect()}

    got = solve(s)
    assert abs(got["view"][0] - 3) < 1e-6 and abs(got["click"][0] + 2) < 1e-6 and got["purchase"] == (0.0, True)
    assert got["signup"] == (0.0, False)
    moved = solve(s.withColumn("value", F.col("value") + F.when(F.col("source") == "click", 7.0).otherwise(0.0)).repartition(5))
    assert abs(moved["click"][0] - got["click"][0] - 7) < 1e-6 and abs(moved["view"][0] - 3) < 1e-6
    corrected = reconcile.apply_offsets(s.filter("source <> 'signup'"), reconcile.solve_offsets(s, reconcile.pairwise_offsets(s, S), S, SOURCES), S)
    merged = reconcile.merge(corrected, S, SOURCES).toPandas()
    assert merged.ts.is_unique and set(merged.winner) == {"purchase", "view", "click"} or set(merged.winner) == {"purchase", "view"}


def test_single_spike_is_logged_but_two_sources_never_are(spark):
    rows = [(s, 15 * k, 1.0) for s in ("purchase", "view", "click") for k in range(8)]
    rows[3] = ("purchase", 45, 50.0)
    assert [r.source for r in reconcile.outlier_audit(frame(spark, rows), S).collect()] == ["purchase"]
    assert reconcile.outlier_audit(frame(spark, [r for r in rows if r[0] != "click"]), S).count() == 0


def test_blend_matches_a_plain_fold(spark):
    draw = np.random.default_rng(4)
    n = 120
    f = pd.DataFrame({"series_id": 0, "ts": pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(n) * 15, unit="min"), "value": draw.normal(0, 6, n), "winner": "view", "n_sources": draw.choice([1, 2, 3], n)})
    f["bucket"] = f.ts
    v, k, h = f.value.to_numpy().copy(), f.n_sources.to_numpy(), np.arange(n) / 4
    for t in range(1, n):
        if (k[t - 1] >= 2) == (k[t] >= 2):
            continue
        high, low = (t - 1, t) if k[t - 1] >= 2 else (t, t - 1)
        step = v[low] - v[high]
        if abs(step) <= 4:
            continue
        for i in range(n):
            if abs(h[i] - h[t]) <= 6:
                w = max(0, 1 - abs(h[i] - h[t]) / 6)
                v[i] += -step * w / 2 if k[i] < 2 else step * w / 2
    d = spark.createDataFrame(f).select(F.col("series_id").cast("int").alias("series_id"), F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "winner", "n_sources")
    got = reconcile.blend_handoffs(d, S).orderBy("ts").toPandas()
    assert np.allclose(got.value, v)


@pytest.mark.parametrize("rows", [[], [("view", 3, 1.0)], [("view", 3, 1.0), ("view", 3, 2.0)], [("view", 3, None), ("view", 33, None)]])
def test_operators_take_degenerate_series(spark, rows):
    s = frame(spark, rows)
    for out in (windows.outlier_flags(s, K), windows.rate_flags(s, K), windows.gradient(s, K), windows.around(s, K, 10)):
        assert out.count() == len(rows)
    for out in (reconcile.densify(s, K), reconcile.merge(s, S), peaks.hourly(s, S), peaks.detect_peaks(s, S), reconcile.pairwise_offsets(s, S), joins.nearest_within(s, s, K), archive.append(s, s, K), archive.promote(s, s, s, S)):
        out.count()


def test_nearest_prefers_the_earlier_and_keeps_the_last_of_equal_times(spark):
    base = frame(spark, [("view", 0, 1.0), ("view", 20, 2.0), ("view", 20, 3.0)])
    probe = frame(spark, [("view", 10, 0.0), ("view", 20, 0.0), ("view", 500, 0.0)])
    got = {r.event_id: r.near_value for r in joins.nearest(probe, base, K).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 3.0}
    assert set(joins.nearest_within(probe, base, K).toPandas().event_id) == {0, 1}


def test_append_is_idempotent_and_aligns(spark):
    known = frame(spark, [("view", 15 * k, float(np.sin(k / 9))) for k in range(80)])
    new = frame(spark, [("view", 15 * k, float(np.sin(k / 9)) + 6.0) for k in range(60, 100)])
    out = archive.append(known, new, K).toPandas()
    assert len(out) == 100 and np.allclose(out.sort_values("ts").value, np.sin(np.arange(100) / 9), atol=1e-9)
    again = archive.append(known, known, K)
    assert again.count() == 80


def test_archive_keeps_first_and_asks_for_quorum(spark):
    live = frame(spark, [("view", 0, 1.0), ("click", 1, 1.1), ("view", 300, 9.0)])
    held = frame(spark, [("error", 0, 7.0)])
    cand = frame(spark, [("view", 2, 5.0), ("view", 301, 9.0), ("view", 16, 1.0)])
    assert archive.promote(cand, live, held, S).count() == 0  # archived, alone, alone
    assert [r.value for r in archive.promote(cand, live, held.limit(0), S).collect()] == [5.0]


def test_plateaus_and_peaks(spark):
    v = [0, 1, 3, 3, 3, 1, 0, 5, 0, 0, 2, 2, 0]
    s = frame(spark, [("view", 60 * k, float(x)) for k, x in enumerate(v)])
    tops = peaks.local_maxima(peaks.hourly(s, S), S).orderBy("ts").toPandas()
    assert [t.hour for t in tops.ts] == [3, 7, 10]
    found = [peaks.detect_peaks(s, S, Params(distance_days=d / 24, prominence=0.0)).orderBy("ts").toPandas() for d in (1, 5)]
    assert [t.hour for t in found[0].ts] == [3, 7, 10] and found[0].prominence.tolist() == [3, 5, 2]
    assert [t.hour for t in found[1].ts] == [7]


def test_contamination_flags_what_disagrees(spark):
    old = frame(spark, [("error", 15 * k, 1.0) for k in range(40)] + [("error", 15 * 20 + 1, 30.0), ("error", 3000, 1.0)])
    merged = frame(spark, [("view", 0, 9.0)]).select("series_id", from_micros(round_us(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts"), QUARTER)).alias("bucket"), "value")
    got = {r.event_id: r.flag for r in archive.contamination_rounds(old, merged, S).collect()}
    assert got == {0: 1, 40: 2}


def test_text_parsers(spark):
    one = spark.range(1)
    ref = F.lit("2026-01-05 12:00:00").cast("timestamp_ntz")
    show = lambda c: str(one.select(c.alias("x")).first()[0])
    assert show(text.lenient_timestamp(F.lit("2026-04-14 23:60:09"))) == "2026-04-15 10:00:09"
    assert show(text.lenient_timestamp(F.lit("no time"))) == "None"
    assert show(text.tick_time(F.lit("12/30"), ref)) == "2025-12-30 10:00:00"
    assert show(text.tick_time(F.lit("Dec-2025"), ref)) == "2025-12-01 00:00:00"  # a month begins at its own midnight
    assert show(text.tick_time(F.lit("dec 2025"), ref)) == "2025-12-01 00:00:00" and show(text.tick_time(F.lit("Dec-1999"), ref)) == "None"
    assert show(text.tick_time(F.lit("12-30"), ref)) == "2025-12-30 10:00:00" and show(text.tick_time(F.lit("23.30"), ref)) == "2026-01-05 09:30:00"
    assert show(text.tick_time(F.lit("23:30"), ref)) == "2026-01-05 09:30:00"
    assert show(text.tick_time(F.lit("??"), ref)) == "None"
    raw = spark.createDataFrame([('{"features":[{"properties":{"event":" ","severity":"severe","sent":"2026-01-01T00:00:00Z","geocode":{"UGC":["A"]},"instruction":"stay in"}},{"properties":{"event":"Ash","headline":"h"}}]}',), ("broken",)], "body string")
    rows = text.alert_records(raw).collect()
    assert [r.instruction for r in rows] == ["stay in", ""]
    assert [(r.event, r.headline, r.severity, r.zones) for r in rows] == [("Alert", "Alert", "SEVERE", ["A"]), ("Ash", "h", "UNKNOWN", [])]


def test_histories_are_read_in_mixed_formats(spark, tmp_path):
    path = tmp_path / "two_day.csv"
    path.write_text("Date,Tilt (microradians)\n2026-04-20 22:06:29.013315579,1.5\n4/21/2026 1:02:03,2\n,3\nbad,4\n2026-04-22,\n")
    got = history.read_history(spark, str(path), str(tmp_path / "absent.csv")).orderBy("ts").collect()
    assert [(str(r.ts), r.value, r.source) for r in got] == [("2026-04-20 22:06:29.013315", 1.5, "two_day"), ("2026-04-21 01:02:03", 2.0, "two_day")]
    assert history.read_history(spark, str(tmp_path / "absent.csv")).count() == 0
    out = str(tmp_path / "out")
    history.export_csv(history.read_history(spark, str(path)), out)
    assert "Date,Value" in open(glob.glob(f"{out}/part*")[0]).read()


def test_reports_of_both_versions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_started_at_utc": "2026-01-01", "per_source": [{"source_name": "x", "rows_appended": 3}]}')
    (tmp_path / "b.json").write_text('{"schema_version": 2, "run_started_at_utc": "2026-01-02", "per_source": [{"source_name": "x", "error": "e"}], "more": 1}')
    reports = history.read_reports(spark, str(tmp_path))
    assert history.latest_report(reports).first().schema_version == 2
    assert history.source_rollup(reports).collect() == [("x", 2, 1, 3)]


def test_streams(spark, tmp_path):
    landed = str(tmp_path / "in")
    rows = frame(spark, [("view", 0, 1.0), ("click", 1, 1.2), ("view", 16, 2.0)])
    rows.write.parquet(landed)
    read = lambda: spark.readStream.schema(rows.schema).parquet(landed)
    pipelines.upsert_buckets(read(), K, str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination(60)
    pipelines.keep_first_archive(read(), S, str(tmp_path / "ar"), str(tmp_path / "c2")).awaitTermination(60)
    assert {r.value for r in pipelines.current(spark, str(tmp_path / "up")).collect()} == {1.0, 1.2, 2.0}
    assert {r.value for r in pipelines.current(spark, str(tmp_path / "ar/archive")).collect()} == {1.2}
    late = frame(spark, [("view", 3, 5.0), ("click", 17, 2.2)]).withColumn("event_id", F.col("event_id") + 100)
    late.write.mode("append").parquet(landed)
    pipelines.upsert_buckets(read(), K, str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination(60)
    pipelines.keep_first_archive(read(), S, str(tmp_path / "ar"), str(tmp_path / "c2")).awaitTermination(60)
    assert {r.value for r in pipelines.current(spark, str(tmp_path / "up")).collect()} == {5.0, 1.2, 2.0, 2.2}
    assert {r.value for r in pipelines.current(spark, str(tmp_path / "ar/archive")).collect()} == {1.2, 2.2}  # the first stays, the second found its quorum
    means = pipelines.window_means(read(), K, "15 minutes")
    q = means.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("means").count() == 4


def test_no_plan_has_a_cartesian_product(spark):
    from strandline.plans import queries

    for name in ("merge_best_resolution", "nearest_asof_tolerance", "pairwise_offset", "quorum_gate", "densify_interpolate"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan), name
