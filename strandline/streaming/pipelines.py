"""Streaming forms of appending, archiving and trailing windows."""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.archive import bucketed, promote
from strandline.operators.windows import keep_last


def event_time(stream: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP; times are UTC throughout."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_means(stream: DataFrame, keys: list[str], width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding means with bounded state; rows later than ``late`` are left out."""
    timed = event_time(stream).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    means = timed.groupBy(window.alias("w"), *keys).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_rows"))
    return means.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "mean_value", "n_rows")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Exact re-deliveries dropped within the watermark."""
    once = event_time(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "event_id"])
    return once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


class DayTable:
    """A table in folders of days, of which a batch rewrites only those that it touches.

    A day's rows lie in a folder named by the version that wrote them. The newest manifest says which version of each day
    counts and which batch of each stream was the last one put in: a batch that is repeated changes nothing, one that broke
    off left nothing that counts. Days not touched keep their files. Old versions go once they are two versions old.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._at(f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def state(self) -> dict:
        """days: {day: version folders, the newest last}, done: {stream: last batch}."""
        names = self._manifests()
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/_manifest/{names[-1]}").first()[0]) if names else {"days": {}, "done": {}}

    def read(self, days: set[str] | None = None) -> DataFrame | None:
        """The rows of the given days, or of all; None where there are none."""
        known = self.state()["days"]
        paths = [f"{self.path}/d={d}/v={known[d][-1]}" for d in sorted(known if days is None else set(known) & days) if known[d][-1]]
        return self.spark.read.parquet(*paths) if paths else None

    def put(self, rows: DataFrame, day: Column, days: set[str], stream: str, batch: int) -> None:
        """Replace ``days`` by ``rows``, all of which are of these days."""
        state = self.state()
        if state["done"].get(stream, -1) >= batch:
            return
        version = uuid.uuid4().hex
        rows.withColumns({"d": day, "v": F.lit(version)}).write.mode("append").partitionBy("d", "v").parquet(self.path)
        for d in days:
            written = self._fs.exists(self._at(f"{self.path}/d={d}/v={version}"))
            *old, before = state["days"].get(d, [None])
            for name in old:
                self._fs.delete(self._at(f"{self.path}/d={d}/v={name}"), True)
            state["days"][d] = [x for x in (before,) if x] + [version if written else None]
        state["done"][stream] = batch
        names = self._manifests()
        number = int(names[-1][:12]) + 1 if names else 0
        draft = self._at(f"{self.path}/_manifest/{number:012d}.draft")
        out = self._fs.create(draft, True)
        out.writeBytes(json.dumps(state))
        out.close()
        self._fs.rename(draft, self._at(f"{self.path}/_manifest/{number:012d}.json"))
        for name in names[:-4]:
            self._fs.delete(self._at(f"{self.path}/_manifest/{name}"), False)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table kept by a stream below."""
    return DayTable(spark, path).read()


def _day(bucket: Column) -> Column:
    return F.coalesce(F.date_format(bucket, "yyyy-MM-dd"), F.lit("none"))


def _days(rows: DataFrame, around: int = 0) -> set[str]:
    """The days of a batch's buckets, and so many on either side."""
    days = {r[0] for r in rows.select(_day(F.col("bucket"))).distinct().collect()}
    near = {str(date.fromisoformat(d) + timedelta(days=k)) for d in days - {"none"} for k in range(-around, around + 1)}
    return days | near


def upsert_buckets(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest sample of each merge bucket across overlapping deliveries; a batch rewrites the days that it touches."""

    def put(batch: DataFrame, number: int) -> None:
        table, new = DayTable(batch.sparkSession, path), bucketed(batch.select(*keys, "ts", "value", "event_id"))
        days = _days(new)
        old = table.read(days)
        both = new if old is None else old.unionByName(new)
        table.put(keep_last(both, [*keys, "bucket"], F.col("ts"), F.col("event_id")), _day(F.col("bucket")), days, checkpoint, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first_archive(stream: DataFrame, series: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append what passes the quorum and is not archived; what waits for a second source is asked again with its bucket.

    The pending rows are kept beside the archive, so that a later batch can complete a quorum; the archive only grows.
    A batch reads the days of its buckets and those around them, since neighbours lie within minutes, and writes these.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [*series, "source", "ts", "value", "event_id"]
        rows = batch.select(*columns)
        archive, pending, empty = DayTable(spark, f"{path}/archive"), DayTable(spark, f"{path}/pending"), spark.createDataFrame([], rows.schema)
        touched, around = _days(bucketed(rows), 1), _days(bucketed(rows), 2)
        held = lambda table, days: (lambda found: empty if found is None else found.select(*columns))(table.read(days))
        old, waiting = held(archive, around), held(pending, touched).unionByName(rows)
        passed = promote(waiting, waiting, old, series).select(*series, "event_id")
        fresh = bucketed(waiting.join(passed, [*series, "event_id"], "left_semi").select(*columns))
        grown = {r[0] for r in fresh.select(_day(F.col("bucket"))).distinct().collect()}
        kept = bucketed(old).filter(_day(F.col("bucket")).isin(*sorted(grown))) if grown else bucketed(old).limit(0)
        archive.put(kept.unionByName(fresh), _day(F.col("bucket")), grown, checkpoint, number)
        done = bucketed(held(archive, touched)).select(*series, "bucket").distinct()
        left = bucketed(waiting).join(done, [*series, "bucket"], "left_anti")
        pending.put(left, _day(F.col("bucket")), touched, checkpoint, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
