"""Medians over ranges of time, in chunks, against plain Python."""

import statistics

import numpy as np
import pandas as pd
import pytest

from strandline.functions.timebuckets import HOUR
from strandline.operators import windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, series_id int, ts timestamp_ntz, value double, near string"
START = pd.Timestamp("1969-12-20")


def rows_of(seed, n=300):
    """Two series and one of null key, times that repeat, a gap of weeks, null values and times."""
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        hours = float(draw.integers(0, 400)) / 2 + (900 if draw.random() < 0.3 else 0)
        ts = None if draw.random() < 0.05 else (START + pd.Timedelta(hours=hours)).to_pydatetime()
        rows.append((k, (1, 2, None)[int(draw.integers(0, 3))], ts, None if draw.random() < 0.1 else float(draw.integers(-5, 6)), "x"))
    return rows


def plain(rows, span):
    out = {}
    for k, s, ts, *_ in rows:
        near = [] if ts is None else [r for r in rows if r[1] == s and r[2] is not None and abs((r[2] - ts).total_seconds()) * 1e6 <= span]
        values = [r[3] for r in near if r[3] is not None]
        out[k] = None if ts is None else (len(near), len(values), statistics.median(values) if values else None)
    return out


@pytest.mark.parametrize("chunk", [HOUR, 50 * HOUR, 10_000 * HOUR])
def test_ranges_are_those_of_plain_frames(spark, chunk):
    rows, spans = rows_of(1), [HOUR // 2, 7 * HOUR]
    frame = spark.createDataFrame(rows, SCHEMA).drop("near").withColumn("own", F.lit("a column more"))
    got = windows.ranges(frame, ["series_id"], F.col("value"), spans, chunk).collect()
    assert len(got) == len(rows) and {r.own for r in got} == {"a column more"}
    for k, span in enumerate(spans):
        assert {r.event_id: None if r.near is None else tuple(r.near[k]) for r in got} == plain(rows, span)


def test_no_rows_no_values_and_numbers_that_are_none(spark):
    frame = spark.createDataFrame(rows_of(2), SCHEMA).drop("near")
    assert windows.around(frame.limit(0), ["series_id"], HOUR).collect() == []
    assert {r.near_median for r in windows.around(frame.withColumn("value", F.lit(None).cast("double")), ["series_id"], HOUR).collect()} == {None}
    nan = spark.createDataFrame([(1, 1, START.to_pydatetime(), v, "") for v in (1.0, float("nan"), 2.0)], SCHEMA).drop("near")
    assert {r.near_median for r in windows.around(nan, ["series_id"], HOUR).collect()} == {2.0}


def test_a_dense_series_is_scanned_once(spark):
    """200 000 rows of which every frame holds all: no frame is built anew."""
    rows = spark.range(200_000).select(F.lit(1).alias("k"), F.expr("timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 1000)").alias("ts"), F.pmod(F.col("id") * 7919, F.lit(1001)).cast("double").alias("value"))
    got = windows.around(rows, ["k"], HOUR).agg(F.min("near_rows"), F.max("near_rows"), F.min("near_median"), F.max("near_median")).first()
    want = statistics.median(float(i * 7919 % 1001) for i in range(200_000))
    assert tuple(got) == (200_000, 200_000, want, want)
