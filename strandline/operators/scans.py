"""Scans along long series, dealt out by time.

A series is cut into chunks of time. What a row must know of the rows before and after its chunk, the last and the first
known value there, is carried along a table of the chunks' ends and joined to the chunk. So a scan of one long series is
shared by all tasks, and a window holds a chunk at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import floor_us, micros
from strandline.params import DEFAULTS


def neighbours(rows: DataFrame, keys: list[str], hit: Column, order: list[str], chunk: int = DEFAULTS.chunk, strict: bool = False, keep: list[str] = ()) -> DataFrame:
    """keys, us, ``order`` and ``keep`` of ``rows`` with ``b``, the last known ``hit`` at or before each row, and ``a``, the first at or after it.

    Rows stand in the order of ``us`` (microseconds, never null) and ``order``; a row's own hit counts unless ``strict``.
    What is not there is null. Null keys are a key of their own. The rows are dealt out once: what is known at a chunk's
    ends is read from the same shuffle, as long as all columns that are kept are used.
    """
    columns = [*dict.fromkeys(["us", *order, *keep])]
    marked = rows.select(F.struct(*keys).alias("key_"), floor_us(F.col("us"), chunk).alias("chunk_"), hit.alias("hit_"), *columns)
    dealt = marked.repartition("key_", "chunk_")
    known = F.when(F.col("hit_").isNotNull(), F.struct("us", *order))
    row = F.struct("hit_", *columns)  # both readers of the shuffle ask for all columns
    ends = dealt.groupBy("key_", "chunk_").agg(F.max_by(row, known).alias("last_"), F.min_by(row, known).alias("first_"))
    chunks, chunks_back = Window.partitionBy("key_").orderBy("chunk_"), Window.partitionBy("key_").orderBy(F.desc("chunk_"))
    outside = Window.unboundedPreceding, -1
    ends = ends.select("key_", "chunk_", F.last("last_.hit_", True).over(chunks.rowsBetween(*outside)).alias("before_"), F.last("first_.hit_", True).over(chunks_back.rowsBetween(*outside)).alias("after_"))
    inside = Window.partitionBy("key_", "chunk_")
    forth, back = inside.orderBy("us", *order), inside.orderBy(F.desc("us"), *[F.desc(c) for c in order])
    frame = Window.unboundedPreceding, -1 if strict else 0
    found = dealt.withColumns({"b_": F.last("hit_", True).over(forth.rowsBetween(*frame)), "a_": F.last("hit_", True).over(back.rowsBetween(*frame))})
    return found.join(ends, ["key_", "chunk_"], "left").select("key_.*", *columns, F.coalesce("b_", "before_").alias("b"), F.coalesce("a_", "after_").alias("a"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one for a local master without it, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master.startswith("local[") or context.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there: a plan that asks for them again and again stays short."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def strides(samples: DataFrame, keys: list[str], chunk: int = DEFAULTS.chunk) -> DataFrame:
    """Median step between neighbours in whole microseconds, and the number of steps, per key."""
    timed = samples.select(*keys, micros("ts").alias("us")).filter("us IS NOT NULL")
    step = neighbours(timed, keys, F.col("us"), [], chunk, strict=True).filter("b IS NOT NULL").withColumn("step_us", F.col("us") - F.col("b"))
    return step.groupBy(*keys).agg(F.median("step_us").alias("median_us"), F.count("*").alias("n_steps"))
