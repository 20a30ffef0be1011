"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text and falls into fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def ids_and_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of text."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


#: Rows whose Python objects a task holds at once.
PART_ROWS = 512


def parts_of(batches):
    """Arrow batches in slices of PART_ROWS rows, which share their memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(k, PART_ROWS)


def map_texts(rows: DataFrame, added: str, compute: Callable[[list], list], column: str = "text") -> DataFrame:
    """``rows`` with ``column`` replaced by the ``added`` columns (DDL) that ``compute`` makes of a batch of its values.

    ``compute`` gives one list or numpy array per added column. All other columns pass as Arrow arrays, untouched: ids stay
    exact beside nulls and above 2^53, whatever their type.
    """
    kept = [c for c in rows.columns if c != column]
    made = T.StructType.fromDDL(added).fields
    schema = T.StructType([*(rows.schema[c] for c in kept), *made])
    names = schema.names

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made]
        for part in parts_of(batches):
            values = compute(part.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names)

    return rows.mapInArrow(run, schema)


def keep_rows(rows: DataFrame, good: Callable[[list], list], column: str = "text") -> DataFrame:
    """The rows for whose ``column`` values ``good`` says true, with all their columns as they are."""

    def run(batches):
        import pyarrow as pa

        for part in parts_of(batches):
            yield part.filter(pa.array(good(part.column(column).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves a local master; on a cluster that is an error, since executors would
    write to disks of their own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master.startswith("local[") or context.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return context.getCheckpointDir()


#: Folders of the tables written since the outermost settle() began.
_WRITTEN: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: like a checkpoint, but compressed and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _WRITTEN:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written(). Only when all that is read from them is written itself: lost work could not be redone."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in folder:
                remove(df.sparkSession, folder)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Write the rows of ``build()`` and delete every table that was written on the way."""
    made: list[str] = []
    _WRITTEN.append(made)
    try:
        done = written(build())
    finally:
        _WRITTEN.remove(made)
    for path in made[:-1]:
        remove(spark, path)
    return done
