"""Chunked scans give the same rows whatever the chunk, and those of plain loops."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, micros
from strandline.operators import joins, peaks, prominence, reconcile, scans
from strandline.params import Params

S, K = ["series_id"], ["series_id", "source"]
SCHEMA = "event_id long, series_id int, source string, ts timestamp_ntz, value double"
CHUNKS = (2000 * DAY, 7 * HOUR)


def samples(spark, seed, n=400, days=40):
    draw = np.random.default_rng(seed)
    start = pd.Timestamp("2025-01-01")
    minutes = np.sort(draw.integers(0, days * 96, n)) * 15 + draw.integers(0, 2, n)
    rows = [(k, (None, 0, 1)[int(draw.integers(0, 3))], ("view", "click")[int(draw.integers(0, 2))], (start + pd.Timedelta(minutes=int(m))).to_pydatetime(), float(np.round(draw.normal(0, 5)))) for k, m in enumerate(minutes)]
    return spark.createDataFrame(rows, SCHEMA)


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


OPERATORS = {
    "nearest": lambda s, p: joins.nearest(s.filter("source = 'view'"), s.filter("source = 'click'"), S, p.chunk),
    "in_intervals": lambda s, p: joins.in_intervals(s, s.filter("event_id % 9 = 0").select("series_id", "ts").distinct(), S, p.chunk),
    "densify": lambda s, p: reconcile.densify(s, K, p),
    "hourly": lambda s, p: peaks.hourly(s, S, HOUR, p.chunk),
    "strides": lambda s, p: scans.strides(s, K, p.chunk),
    "local_maxima": lambda s, p: peaks.local_maxima(peaks.hourly(s, S, HOUR, p.chunk), S, p.chunk),
    "peaks": lambda s, p: peaks.prominent(peaks.hourly(s, S), S, p, stretch=0),
    "peaks_close": lambda s, p: peaks.prominent(peaks.hourly(s, S), S, replace(p, distance_days=0.5, prominence=1.0), height=-1.0, stretch=0),
    "blend": lambda s, p: reconcile.blend_handoffs(reconcile.merge(s, S), S, p),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(spark, name):
    s = samples(spark, 3)
    one, many = (sorted_rows(OPERATORS[name](s, Params(chunk=c))) for c in CHUNKS)
    assert one == many and one


def test_neighbours_are_those_of_a_plain_scan(spark):
    rows = samples(spark, 5).withColumns({"us": micros("ts"), "hit": F.when(F.col("value") > 3, F.col("event_id"))})
    for strict in (False, True):
        got = {r.event_id: (r.b, r.a) for r in scans.neighbours(rows, S, F.col("hit"), ["event_id"], 11 * HOUR, strict).collect()}
        frame = rows.toPandas().sort_values(["us", "event_id"])
        for _, g in frame.groupby("series_id", dropna=False):
            hits = g["hit"].tolist()
            for k, event in enumerate(g["event_id"].tolist()):
                b = next((h for h in reversed(hits[: k if strict else k + 1]) if h == h), None)
                a = next((h for h in hits[k + 1 if strict else k :] if h == h), None)
                assert got[event] == (b, a)


def test_no_task_has_a_long_series_to_itself(spark):
    long = spark.range(400_000).select(F.lit(1).alias("series_id"), (F.col("id") * 60_000_000).alias("us"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scans.neighbours(long, S, F.when(F.col("id") % 1000 == 0, F.col("id")), [], 10 * DAY, keep=["id"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 400_000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 200_000
    assert out.filter("b <> id - id % 1000").count() == 0


SERIES = st.lists(st.integers(0, 6), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(SERIES, st.integers(1, 9))
def test_summaries_of_chunks_see_what_the_whole_series_shows(values, size):
    v = np.array(values, dtype=float)
    line, whole = prominence.Skyline(), prominence.lowest_since_higher(v)
    for k in range(0, len(v), size):
        part = v[k : k + size]
        own = prominence.lowest_since_higher(part)
        for i, x in enumerate(part):
            low = own[i] if (part[:i] > x).any() else min(own[i], line.low_from(x))
            assert low == whole[k + i]
        line.add(part.max(), part.min(), *prominence.looking_back(part))


def plain_apart(us, value, distance):
    kept = []
    for k in sorted(range(len(us)), key=lambda k: (value[k], us[k]), reverse=True):
        if all(abs(us[k] - us[j]) >= distance for j in kept):
            kept.append(k)
    return sorted(us[k] for k in kept)


@pytest.mark.parametrize("shape", ["noise", "ramp", "flat"])
def test_distance_is_that_of_a_plain_loop(spark, shape):
    draw = np.random.default_rng(8)
    us = np.unique(draw.integers(0, 4000, 700)).tolist()
    value = {"noise": draw.integers(0, 9, len(us)).astype(float), "ramp": np.arange(len(us), dtype=float), "flat": np.zeros(len(us))}[shape].tolist()
    tops = spark.createDataFrame([(None, u, v) for u, v in zip(us, value, strict=True)], "series_id int, us long, value double")
    for distance in (2, 17, 90):
        got = sorted(r.us for r in prominence.apart(tops, S, distance, 50).collect())
        assert got == plain_apart(us, value, distance), distance
