"""Cleaning of sources and archive: what is found, the rewrite and the report."""

import glob

import pandas as pd
from pyspark.sql import functions as F

from strandline.operators import archive, cleaning, forecast, reconcile
from strandline.operators.windows import keep_last

SCHEMA = "event_id long, series_id int, source string, ts timestamp_ntz, value double"
S = ["series_id"]
SOURCES = reconcile.Sources({"fine": 0.1, "coarse": 1.0}, anchor="own", archive="old")


def merged(live):
    return keep_last(archive.bucketed(live).select(*S, "bucket", "ts", "event_id", "value"), [*S, "bucket"], F.col("ts"), F.col("event_id"))


def samples(spark):
    start, rows = pd.Timestamp("2025-01-01"), []
    add = lambda source, minutes, value: rows.append((len(rows), 1, source, (start + pd.Timedelta(minutes=minutes)).to_pydatetime(), value))
    for k in range(24):
        add("fine", 15 * k, 30.0 if k == 12 else 1.0)  # one spike
        add("coarse", 60 * k + 5000, 2.0)
        add("own", 15 * k + 20_000, 90.0 if k == 5 else 3.0)  # the anchor keeps its spike
    for k in range(8):
        add("old", 15 * k, 9.0 if k == 3 else 1.0)  # beside the live value
    for k in range(12):
        add("old", 240 * k + 10_000, 40.0 if k == 6 else 2.0)  # no live row, nothing near in time
    return spark.createDataFrame(rows, SCHEMA)


def test_what_is_found(spark):
    s = samples(spark)
    found = {(r.source, r.value, r.reference, r.delta, r.reason) for r in cleaning.scan(s, S, SOURCES, merged).collect()}
    assert found == {("fine", 30.0, 1.0, 29.0, "outlier"), ("old", 9.0, 1.0, 8.0, "truth"), ("old", 40.0, 2.0, 38.0, "orphan-isolated")}
    assert cleaning.scan(s.limit(0), S, SOURCES, merged).collect() == []


def test_rewrite_replaces_only_what_is_touched(spark, tmp_path):
    path, s = str(tmp_path / "table"), samples(spark)
    cleaning.store(s, path)
    before = {name: set(glob.glob(f"{path}/source={name}/part*")) for name in ("fine", "coarse", "own", "old")}
    found = cleaning.scan(spark.read.parquet(path), S, SOURCES, merged)
    assert cleaning.rewrite(spark, path, found, S, SOURCES, archive_only=True) == ["old"]
    left = {name: set(glob.glob(f"{path}/source={name}/part*")) for name in before}
    assert [n for n in before if left[n] == before[n]] == ["fine", "coarse", "own"]
    again = cleaning.scan(spark.read.parquet(path), S, SOURCES, merged)
    assert cleaning.rewrite(spark, path, again, S, SOURCES) == ["fine"]
    assert spark.read.parquet(path).count() == s.count() - 3 and cleaning.scan(spark.read.parquet(path), S, SOURCES, merged).count() == 0
    assert cleaning.rewrite(spark, path, cleaning.scan(spark.read.parquet(path), S, SOURCES, merged), S, SOURCES) == []
    everything = s.filter("source = 'coarse'").select(*S, "source", "event_id", "ts", "value").withColumns({"reference": F.lit(0.0), "delta": F.lit(0.0), "reason": F.lit("outlier")})
    assert cleaning.rewrite(spark, path, everything, S, SOURCES) == ["coarse"]
    assert spark.read.parquet(path).filter("source = 'coarse'").count() == 0


def test_the_report_reads_in_order(spark, tmp_path):
    s = samples(spark)
    cleaning.write_report(s, cleaning.scan(s, S, SOURCES, merged), SOURCES, str(tmp_path / "report"))
    text = [line for f in sorted(glob.glob(f"{tmp_path}/report/part*")) for line in open(f).read().splitlines()]
    assert [line for line in text if line.startswith("##")] == [h[0] for h in cleaning.HEADINGS.values()]
    assert text[5:8] == ["| coarse | 24 | 0 |", "| fine | 24 | 1 |", "| own | 24 | 0 |"] and "| old | 20 | 2 |" in text
    assert text[-2:] == ["| old | 2025-01-01 00:45:00 | +9.00 | +1.00 | +8.00 | truth |", "| old | 2025-01-08 22:40:00 | +40.00 | +2.00 | +38.00 | orphan-isolated |"]
    assert "| fine | 2025-01-01 03:00:00 | +30.00 | +1.00 | +29.00 | outlier |" in text


def test_models_by_stage_and_across(spark):
    rows = [(0.25, "linear", 4.0), (0.25, "linear", 6.0), (0.25, "auto", -1.0), (0.25, "auto", None), (0.25, "auto", None), (0.5, "linear", None), (0.5, "auto", 5.0), (0.5, "interval_median", -5.0)]
    stats = forecast.backtest_stats(spark.createDataFrame(rows, "fraction double, model_id string, error_h double"))
    table = [(r.fraction, r.place, r.model_id, r.coverage, r.median_abs, r.recommended) for r in forecast.models_by_stage(stats, ["linear", "interval_median", "auto"]).orderBy("fraction", "place").collect()]
    assert table == [
        (0.25, 1, "linear", "2/2", 5.0, True), (0.25, 2, "auto", "1/3", 1.0, False),
        (0.5, 1, "interval_median", "1/1", 5.0, True), (0.5, 2, "auto", "1/1", 5.0, False), (0.5, 3, "linear", "0/1", None, False),
    ]
    assert {r.model_id: (r.at_25, r.at_50, r.at_75) for r in forecast.models_across_stages(stats).collect()} == {"linear": (5.0, None, None), "auto": (1.0, 5.0, None), "interval_median": (None, 5.0, None)}
