"""Run reports through their data source: whole writes, newest runs, replaced and broken ones."""

import pytest
from pyspark.sql import functions as F

from strandline.sources.run_source import STAGED, append_runs, read_runs


def reports(spark, days, note="a"):
    stamp = F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2025-01-01 10:20:30").cast("timestamp_ntz"))
    return spark.range(days.start, days.stop).select(stamp.alias("run_started_at_utc"), F.lit(2).alias("schema_version"), F.array(F.struct(F.lit(note).alias("source_name"))).alias("per_source"))


def files(path):
    return sorted(f.name for f in path.iterdir() if f.is_file())


def test_runs_are_appended_replaced_and_read_from_the_newest(spark, tmp_path):
    path = tmp_path / "runs"
    path.mkdir()
    append_runs(reports(spark, range(0, 4)), str(path))
    append_runs(reports(spark, range(3, 6), "b"), str(path))  # the fourth run again
    assert len(files(path)) == 6 and not list((path / STAGED).iterdir())
    got = {r.run[:10]: r.per_source[0].source_name for r in read_runs(spark, str(path)).collect()}
    assert got == {f"2025-01-0{k}": "a" if k < 4 else "b" for k in range(1, 7)}
    for name in files(path)[:4]:
        (path / name).unlink()
        (path / name).mkdir()  # cannot be read, and need not be
    assert sorted(r.run[:10] for r in read_runs(spark, str(path), newest=2).collect()) == ["2025-01-05", "2025-01-06"]
    assert read_runs(spark, str(path), newest=0).collect() == []


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = tmp_path / "runs"
    path.mkdir()
    append_runs(reports(spark, range(0, 1)), f"file:{path}")
    before = files(path)
    bad = reports(spark, range(0, 8)).repartition(4).withColumn("run_started_at_utc", F.when(F.dayofmonth("run_started_at_utc") != 5, F.col("run_started_at_utc")))
    with pytest.raises(Exception, match="needs its start"):
        append_runs(bad, str(path))
    assert files(path) == before and not list((path / STAGED).iterdir())


def test_broken_reports_and_no_reports(spark, tmp_path):
    assert read_runs(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "2025-01-01.json").write_text("{broken")
    assert [(r.run, r.per_source) for r in read_runs(spark, str(tmp_path)).collect()] == [("2025-01-01", None)]
    append_runs(reports(spark, range(0, 3)).limit(0), str(tmp_path))
    assert files(tmp_path) == ["2025-01-01.json"]
