"""CSV histories, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import MINUTE, floor_bucket
from strandline.operators.text import stamp_text

#: Date formats of stored histories, month first.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")
EMPTY = "ts timestamp_ntz, value double"
#: Times are written to the microsecond.
WRITTEN = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "header": True}


def parsed_time(text: Column) -> Column:
    """A stored time; digits below a microsecond are cut, what no format fits is null."""
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    micro = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), r"(Z|[+]00:?00)$", ""))
    whole = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.coalesce(F.when(fraction != "", micro.cast("long")), F.lit(0).cast("long")), whole)


def read_history(spark: SparkSession, *paths: str, time_column: str = "Date", value_column: str = "Tilt (microradians)") -> DataFrame:
    """ts, value, source (the file's stem) of CSV histories; rows without a time or a value are dropped, a missing path is empty."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{EMPTY}, source string")
    raw = spark.read.option("header", True).csv(there)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return raw.select(parsed_time(F.col(f"`{time_column}`")).alias("ts"), F.col(f"`{value_column}`").try_cast("double").alias("value"), stem.alias("source")).dropna(subset=["ts", "value"])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_history(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    samples.write.mode(mode).parquet(path)


def export_range(samples: DataFrame, path: str, first_day: str, last_day: str) -> None:
    """CSV of the days from ``first_day`` to ``last_day``, both included whole: date_utc, value."""
    day = lambda d: F.to_timestamp_ntz(F.lit(d), F.lit("yyyy-MM-dd"))
    inside = (F.col("ts") >= day(first_day)) & (F.col("ts") < day(last_day) + F.expr("INTERVAL 1 DAY"))
    samples.filter(inside).select(F.col("ts").alias("date_utc"), "value").write.mode("overwrite").options(**WRITTEN).csv(path)


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One folder with a folder for each table: CSV where all columns are flat, JSON lines otherwise."""
    for name, table in tables.items():
        nested = any(kind.startswith(("array", "map", "struct")) for _, kind in table.dtypes)
        writer = table.write.mode("overwrite").options(**WRITTEN)
        writer.json(f"{path}/{name}") if nested else writer.csv(f"{path}/{name}")


def export_csv(samples: DataFrame, path: str) -> None:
    """Export with the stored column names."""
    samples.select(F.col("ts").alias("Date"), F.col("value").alias("Value")).write.mode("overwrite").options(**WRITTEN).csv(path)


def project_azimuth(x: Column, y: Column, degrees: float = 300.0) -> Column:
    """Component of a two-axis reading along an azimuth."""
    a = F.radians(F.lit(degrees))
    return x * F.sin(a) + y * F.cos(a)


def read_two_axes(spark: SparkSession, *paths: str, degrees: float = 300.0, minutes: int = 30) -> DataFrame:
    """ts, value, segment of raw two-axis recordings (UTCDateTime, Xtilt(microrad), Ytilt(microrad)): means along an azimuth.

    Blanks around column names are ignored. Segments are numbered by file name; every ``minutes`` of a segment with a
    reading give one row at their start.
    """
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{EMPTY}, segment int")
    raw = spark.read.option("header", True).csv(there)
    named = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("file", F.input_file_name())
    numbers = named.select("file").distinct().withColumn("segment", F.row_number().over(Window.orderBy("file")))
    x, y = (F.col(f"`{c}`").try_cast("double") for c in ("Xtilt(microrad)", "Ytilt(microrad)"))
    read = named.select("file", parsed_time(F.col("UTCDateTime")).alias("ts"), project_azimuth(x, y, degrees).alias("value")).dropna(subset=["ts", "value"])
    means = read.groupBy("file", floor_bucket("ts", minutes * MINUTE).alias("ts")).agg(F.avg("value").alias("value"))
    return means.join(numbers, "file").select("ts", "value", "segment")


# The columns of a quality log, in the order of its file.
QUALITY = (
    "run_timestamp_utc", "y_slope", "y_intercept", "y_max_residual_microrad", "y_max_residual_pixels", "y_std_residual_microrad", "y_labels_used", "y_slope_fallback_used",
    "y_slope_history_median", "x_start_utc", "x_end_utc", "x_span_hours", "x_tick_cross_check_count", "x_tick_cross_check_median_err_px", "x_tick_cross_check_max_err_px",
    "title_psm_used", "plot_bbox", "column_coverage", "rows_raw", "rows_after_outlier_filter", "rows_dropped_outlier", "rows_dropped_rate", "columns_dropped_width",
    "rows_appended", "frame_offset_microrad", "frame_overlap_buckets",
)
#: The columns that older logs lack; their rows are three fields shorter.
QUALITY_ADDED = QUALITY[12:15]


def append_quality(rows: DataFrame, path: str) -> None:
    """Append to a quality log, one folder per source; columns that ``rows`` lacks are empty."""
    given = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in QUALITY]
    rows.select("source", *given).write.mode("append").partitionBy("source").option("header", True).csv(path)


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """A quality log, all columns as text; rows of the older layout have nulls in the columns that they lack."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in QUALITY)).csv(path).filter(F.col(QUALITY[0]) != QUALITY[0])
    short = F.col(QUALITY[-1]).isNull() & F.col(QUALITY[-2]).isNull() & F.col(QUALITY[-3]).isNull()
    moved = {c: F.when(short, F.lit(None) if c in QUALITY_ADDED else F.col(QUALITY[k - 3])).otherwise(F.col(c)) for k, c in enumerate(QUALITY) if k >= 12}
    return raw.select(*[moved.get(c, F.col(c)).alias(c) for c in QUALITY])


# The fields of a stored run report.
REPORT = """schema_version int, run_started_at_utc string, run_finished_at_utc string,
per_source array<struct<source_name:string,fetched:boolean,rows_raw:int,rows_traced:int,rows_appended:int,frame_offset_microrad:double,error:string,warnings:array<string>>>,
reconcile struct<rows_out:int,pairs:array<struct<source_i:string,source_j:string,beta:double,overlap_buckets:int,residual_std_microrad:double>>,winner_counts:map<string,int>,warnings:array<string>>"""


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports of either version, one a file in ``path`` or its folders, with the file's name; what does not parse becomes null."""
    raw = spark.read.schema(REPORT).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("file", F.input_file_name())


def report_lines(reports: DataFrame, failures: str | None = None, most: int = 20, beside: tuple = ()) -> DataFrame:
    """Reports as JSON text, one ``value`` per run; of the array ``failures`` only the largest by absolute delta stay.

    Columns ``beside`` stand beside the text and not in it.
    """
    if failures:
        largest = F.slice(F.array_sort(failures, lambda a, b: F.when(F.abs(a["delta"]) > F.abs(b["delta"]), -1).when(F.abs(a["delta"]) < F.abs(b["delta"]), 1).otherwise(0)), 1, most)
        reports = reports.withColumns({f"{failures}_total": F.size(failures), failures: largest})
    inside = [c for c in reports.columns if c not in beside]
    times = {c: stamp_text(F.col(c)) for c, kind in reports.dtypes if kind.startswith("timestamp") and c in inside}
    return reports.withColumns(times).select(F.to_json(F.struct(*inside)).alias("value"), *beside)


def write_reports(reports: DataFrame, path: str, failures: str | None = None) -> None:
    """One file per run, in a folder named by the run's start (``run_started_at_utc``, which every report has).

    Of reports of one start in ``reports`` the one that ends last is written; a start that is there already gets a file more.
    """
    start = F.col("run_started_at_utc")
    stamp = F.regexp_replace(stamp_text(start) if dict(reports.dtypes)["run_started_at_utc"].startswith("timestamp") else start, ":", "-")
    ended = F.col("run_finished_at_utc").cast("string") if "run_finished_at_utc" in reports.columns else F.lit(None).cast("string")
    lines = report_lines(reports.withColumns({"run": stamp, "ended_": F.coalesce(ended, F.lit(""))}), failures, beside=("run", "ended_"))
    last = lines.groupBy("run").agg(F.max_by("value", F.struct("ended_", "value")).alias("value"))
    last.repartition("run").write.mode("append").partitionBy("run").text(path)


def keep_newest(reports: DataFrame, keep: int = 365) -> DataFrame:
    """The newest ``keep`` reports; the others may be deleted. Only their start times are put in order."""
    starts = reports.select("run_started_at_utc").orderBy(F.desc("run_started_at_utc")).limit(keep).agg(F.min("run_started_at_utc").alias("oldest"))
    return reports.join(F.broadcast(starts), F.col("run_started_at_utc") >= F.col("oldest")).drop("oldest")


def prune_reports(spark: SparkSession, path: str, keep: int = 365) -> int:
    """Delete the oldest runs beyond ``keep``, by name: folders of write_reports() and plain files; how many were deleted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("run="):
            found.append((name[4:], status.getPath().toString()))
        elif status.isFile() and name.endswith(".json"):
            found.append((name[:-5], status.getPath().toString()))
    old = sorted(found)[: max(0, len(found) - keep)]
    for _, name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), True)
    return len(old)


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.groupBy().agg(F.max_by(F.struct(*reports.columns), F.col("run_started_at_utc")).alias("r")).filter("r IS NOT NULL").select("r.*")


def source_rollup(reports: DataFrame) -> DataFrame:
    """Per source over all reports: runs, failures, rows appended."""
    rows = reports.select(F.explode("per_source").alias("s")).select("s.*")
    return rows.groupBy("source_name").agg(F.count("*").alias("runs"), F.count("error").alias("failures"), F.coalesce(F.sum("rows_appended"), F.lit(0)).alias("rows_appended"))
