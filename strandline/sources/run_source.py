"""Run reports as a data source: a file per run, of which a write shows all or none, and the newest are read alone.

Rows are (run, body): the run's start as text that sorts by time, and its report as JSON. Paths are what pyarrow opens: local
and mounted folders, HDFS and object stores by their URI.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from strandline.sources.history import REPORT, report_lines, stamp_text

NAME = "run_reports"
STAGED = "_staged"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def _names(fs: arrow_fs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json"))


#: Files that a task reads, one after the other.
FILES = 32


@dataclass
class Runs(InputPartition):
    files: list


class RunReader(DataSourceReader):
    """A few files per partition; with ``newest`` only so many files are opened, chosen by their names."""

    def __init__(self, options: dict):
        self.path, self.newest = options["path"], options.get("newest")

    def partitions(self) -> list[Runs]:
        names = _names(*_open(self.path))
        names = names if self.newest is None else names[max(0, len(names) - int(self.newest)) :]
        return [Runs(names[k : k + FILES]) for k in range(0, len(names), FILES)]

    def read(self, partition: Runs | None) -> Iterator[tuple]:
        fs, root = _open(self.path)
        for name in partition.files if partition else ():  # no partitions are one that is None
            with fs.open_input_stream(posixpath.join(root, name)) as file:
                yield name[: -len(".json")], file.read().decode("utf-8", "replace")


@dataclass
class Written(WriterCommitMessage):
    files: list


class RunWriter(DataSourceWriter):
    """Tasks write beside the table; the commit moves their files into it, an abort deletes them.

    A run that is there already is replaced. Of one run's rows in one write any one stays.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _open(self.path)
        folder = posixpath.join(root, STAGED, self.job, uuid.uuid4().hex)  # each attempt its own
        files = []
        for row in iterator:
            if row.run is None or row.body is None:
                raise ValueError("a run report needs its start and a body")
            name = f"{row.run.replace(':', '-')}.json"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(posixpath.join(folder, name)) as file:
                file.write(row.body.encode())
            files.append(posixpath.join(folder, name))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        files = {posixpath.basename(f): f for m in messages if m for f in m.files}
        before = _names(fs, root) if self.overwrite else []
        for name, file in sorted(files.items()):
            fs.move(file, posixpath.join(root, name))
        for name in set(before) - set(files):
            fs.delete_file(posixpath.join(root, name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        folder = posixpath.join(root, STAGED, self.job)
        if fs.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(folder)


class RunReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "run string, body string"

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        return RunWriter(self.options, overwrite)


def append_runs(reports: DataFrame, path: str, failures: str | None = None) -> None:
    """Append reports (``run_started_at_utc``, a time or a text, and what else they hold), a file for each run."""
    reports.sparkSession.dataSource.register(RunReports)
    start = F.col("run_started_at_utc")
    run = stamp_text(start) if dict(reports.dtypes)["run_started_at_utc"].startswith("timestamp") else start
    lines = report_lines(reports.withColumn("run", run), failures, beside=("run",))
    once = lines.groupBy("run").agg(F.max("value").alias("body"))
    once.write.format(NAME).mode("append").save(path)


def read_runs(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """The fields of the stored reports, of all runs or of the ``newest``, with ``run``; what does not parse is null."""
    spark.dataSource.register(RunReports)
    reader = spark.read.format(NAME)
    raw = (reader if newest is None else reader.option("newest", newest)).load(path)
    return raw.select("run", F.from_json("body", REPORT).alias("r")).select("run", "r.*")
