"""Tables that streams keep by day: the rows of one delivery, whatever the batches, and files that stay where nothing changes."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import archive
from strandline.operators.windows import keep_last
from strandline.streaming import pipelines

SCHEMA = "event_id long, series_id int, source string, ts timestamp_ntz, value double"
S, K = ["series_id"], ["series_id", "source"]


def deliveries(seed, parts):
    draw = np.random.default_rng(seed)
    start = pd.Timestamp("2025-01-01 23:00")
    rows = [(k, int(draw.integers(0, 2)), ("view", "click")[int(draw.integers(0, 2))], (start + pd.Timedelta(minutes=int(draw.integers(0, 1600)))).to_pydatetime(), float(np.round(draw.normal(0, 2), 1))) for k in range(240)]
    order = draw.permutation(len(rows))
    return [[rows[i] for i in order[k::parts]] for k in range(parts)]


def run(spark, tmp_path, batches, start):
    """A stream over files that land one after the other, a batch each."""
    landed = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(landed))
        start(spark.readStream.schema(SCHEMA).parquet(str(landed))).awaitTermination(120)


def as_set(frame):
    return sorted(map(str, (tuple(r) for r in frame.collect())))


@pytest.mark.parametrize("parts", [1, 4])
def test_upserts_in_any_batches_are_those_of_the_whole(spark, tmp_path, parts):
    batches = deliveries(3, parts)
    batches.append(batches[0])  # delivered again
    run(spark, tmp_path, batches, lambda s: pipelines.upsert_buckets(s, K, str(tmp_path / "t"), str(tmp_path / "c")))
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    columns = [*K, "bucket", "ts", "value"]
    want = keep_last(archive.bucketed(whole.select(*K, "ts", "value", "event_id")), [*K, "bucket"], F.col("ts"), F.col("event_id"))
    assert as_set(pipelines.current(spark, str(tmp_path / "t")).select(columns)) == as_set(want.select(columns))


def test_a_batch_leaves_other_days_alone_and_a_repeated_one_all(spark, tmp_path):
    path = str(tmp_path / "t")
    table = pipelines.DayTable(spark, path)
    row = lambda day, v: spark.createDataFrame([(1, v, day)], "k int, value double, day string")
    table.put(row("2025-01-01", 1.0).union(row("2025-01-02", 2.0)), F.col("day"), {"2025-01-01", "2025-01-02"}, "s", 0)
    before = set(glob.glob(f"{path}/d=2025-01-01/v=*/part*"))
    table.put(row("2025-01-02", 3.0), F.col("day"), {"2025-01-02"}, "s", 1)
    table.put(row("2025-01-02", 9.0), F.col("day"), {"2025-01-02"}, "s", 1)  # the same batch again
    assert set(glob.glob(f"{path}/d=2025-01-01/v=*/part*")) == before
    assert sorted(r.value for r in table.read().collect()) == [1.0, 3.0]
    row("2025-01-01", 7.0).withColumns({"d": F.lit("2025-01-01"), "v": F.lit("broken")}).write.mode("append").partitionBy("d", "v").parquet(path)  # a batch that broke off
    table.put(row("2025-01-02", 4.0).limit(0), F.col("day"), {"2025-01-02"}, "other", 0)
    assert [r.value for r in table.read().collect()] == [1.0] and table.read({"2025-01-02"}) is None
    for k in range(8):
        table.put(row("2025-01-02", float(k)), F.col("day"), {"2025-01-02"}, "s", 2 + k)
    assert len(glob.glob(f"{path}/d=2025-01-02/v=*")) <= 3 and len(glob.glob(f"{path}/_manifest/*.json")) <= 6
    assert sorted(r.value for r in table.read().collect()) == [1.0, 7.0]


def test_archive_grows_by_what_finds_its_quorum(spark, tmp_path):
    batches = deliveries(5, 3)
    archived, known = [], None
    for k, rows in enumerate(batches):
        run(spark, tmp_path, [rows], lambda s: pipelines.keep_first_archive(s, S, str(tmp_path / "a"), str(tmp_path / "c")))
        now = {tuple(r) for r in pipelines.current(spark, str(tmp_path / "a/archive")).select("event_id", "series_id", "source", "ts", "value").collect()}
        archived.append(now)
    assert archived[0] <= archived[1] <= archived[2] and len(archived[2]) > len(archived[0]) > 0
    # The same in memory: all that waits is asked again with every batch.
    empty = spark.createDataFrame([], SCHEMA)
    known, waiting = empty, empty
    for k, rows in enumerate(batches):
        waiting = waiting.unionByName(spark.createDataFrame(rows, SCHEMA))
        passed = archive.promote(waiting, waiting, known, S).select("series_id", "event_id")
        known = spark.createDataFrame(known.unionByName(waiting.join(passed, ["series_id", "event_id"], "left_semi").select(*known.columns)).collect(), SCHEMA)
        buckets = archive.bucketed(known).select("series_id", "bucket").distinct()
        waiting = spark.createDataFrame(archive.bucketed(waiting).join(buckets, ["series_id", "bucket"], "left_anti").select(*known.columns).collect(), SCHEMA)
        assert {tuple(r) for r in known.collect()} == archived[k]
