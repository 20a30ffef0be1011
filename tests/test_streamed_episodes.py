"""Episodes of a stream are those of the finished table, however its rows arrive."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions.timebuckets import HOUR
from strandline.operators import peaks
from strandline.params import DEFAULTS
from strandline.streaming.episodes import Machine, closed_episodes

SCHEMA = "event_id long, series_id int, ts timestamp_ntz, value double"
K = ["series_id"]
SHORT = replace(DEFAULTS, episode_rows=5, trough_search=24 * HOUR)
EPOCH = datetime(1970, 1, 1)


def rows_of(seed, n=400, hours=300):
    """Few distinct values, so that means tie and stretches are level; times that repeat and stand on bucket starts; gaps."""
    draw = np.random.default_rng(seed)
    at = np.sort(np.where(draw.random(n) < 0.3, draw.integers(0, hours // 2, n) * 2.0, np.round(draw.random(n) * hours, 2)))
    at = at[(at < hours / 2) | (at > hours / 2 + 30)]
    start = pd.Timestamp("2025-01-01")
    return [(k, int(draw.integers(0, 2)), (start + pd.Timedelta(hours=float(h))).to_pydatetime(), float(draw.integers(0, 3))) for k, h in enumerate(at)]


def whole(spark, rows, width, p):
    s = spark.createDataFrame(rows, SCHEMA)
    found = peaks.episodes(s, peaks.local_maxima(peaks.hourly(s, K, width), K), K, p)
    return {tuple(r) for r in found.select("series_id", "prev_ts", "end_ts", "trough_ts", "trough_value", "n_rows").collect()}


def test_a_machine_that_is_stored_after_every_row(spark):
    rows, width = rows_of(1), 2 * HOUR
    us = lambda t: round((t - EPOCH).total_seconds() * 1e6)
    stamp = lambda u: (pd.Timestamp(u, unit="us")).to_pydatetime()
    found = set()
    for series in (0, 1):
        machine = Machine(width, SHORT)
        for k, _, ts, value in [r for r in rows if r[1] == series]:
            found |= {(series, stamp(a), stamp(b), stamp(c), v, n) for a, b, c, v, n in machine.row(us(ts), value, k)}
            machine = Machine(width, SHORT, machine.fields())
        machine.seen = us(datetime(2100, 1, 1))
        found |= {(series, stamp(a), stamp(b), stamp(c), v, n) for a, b, c, v, n in machine.close()}
    want = whole(spark, rows, width, SHORT)
    assert found == want and len(want) > 10


@pytest.mark.parametrize("shuffled", [False, True])
def test_batches_give_the_episodes_of_the_whole(spark, tmp_path, shuffled):
    rows, width = rows_of(2), 2 * HOUR
    parts = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    if shuffled:  # within the lateness that is allowed
        order = np.random.default_rng(0).permutation(len(rows))
        parts = [[rows[i] for i in order[k::2]] for k in (0, 1)]
    nothing = [(10_000, 1, None, 1.0), (10_001, 1, datetime(2025, 1, 2), None)]
    for part in (parts[0] + nothing, parts[1], [(10_002, -1, datetime(2100, 1, 1), 0.0)], [(10_003, 1, datetime(2025, 1, 3), 9.0)]):  # the last one is too late
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        closed = closed_episodes(stream, K, "400 hours" if shuffled else "1 hour", width, SHORT)
        closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("series_id", "prev_ts", "end_ts", "trough_ts", "trough_value", "n_rows").collect()]
    assert len(got) == len(set(got)) and set(got) == whole(spark, rows, width, SHORT)


def test_a_width_that_does_not_divide_the_search_is_refused(spark):
    with pytest.raises(ValueError):
        closed_episodes(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1)), K, width=5 * HOUR)
