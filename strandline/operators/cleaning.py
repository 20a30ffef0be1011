"""Cleaning of stored sources and of the archive: what is to go and why, a report, and the rewrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.archive import contamination_rounds
from strandline.operators.reconcile import Sources
from strandline.operators.scans import cut
from strandline.operators.windows import outlier_flags
from strandline.params import DEFAULTS, Params

FOUND = ("event_id", "ts", "value", "reference", "delta", "reason")


def scan(samples: DataFrame, series: list[str], sources: Sources, merged: Callable[[DataFrame], DataFrame], limit: float = 3.0, p: Params = DEFAULTS) -> DataFrame:
    """Rows to remove: series, source, event_id, ts, value, reference, delta (value less reference), reason.

    Sources lose their rolling-median outliers ('outlier'); the anchor is an instrument's own record and loses none.
    ``merged`` makes one series (series, bucket, value) of the cleaned sources, against which the archive is held:
    'truth' where it has the bucket, else 'orphan-isolated' or 'orphan' by the archived rows around.
    """
    old = samples.filter(F.col("source") == sources.archive)
    rolled = outlier_flags(samples.filter(F.col("source") != sources.archive), [*series, "source"], p)
    rolled = rolled.withColumn("dropped", F.col("dropped") & ~F.col("source").eqNullSafe(F.lit(sources.anchor)))
    outliers = rolled.filter("dropped").select(*series, "source", "event_id", "ts", "value", F.col("local_median").alias("reference"), F.lit("outlier").alias("reason"))
    live = rolled.filter("NOT dropped").select(*samples.columns)
    reason = F.when(F.col("flag") == 1, "truth").when(F.col("alone"), "orphan-isolated").otherwise("orphan")
    flagged = contamination_rounds(old, merged(live), series, limit).select(*series, F.lit(sources.archive).alias("source"), "event_id", "ts", "value", "reference", reason.alias("reason"))
    return outliers.unionByName(flagged).withColumn("delta", F.col("value") - F.col("reference")).select(*series, "source", *FOUND)


def cleaned(samples: DataFrame, found: DataFrame, series: list[str], sources: Sources, archive_only: bool = False) -> DataFrame:
    """``samples`` without the rows ``found``; with ``archive_only`` the sources keep theirs. Rows of null keys stay."""
    gone = found.filter(F.col("source") == sources.archive) if archive_only else found
    return samples.join(gone.select(*series, "source", "event_id"), [*series, "source", "event_id"], "left_anti").select(*samples.columns)


def report_lines(samples: DataFrame, found: DataFrame, sources: Sources, numbers: tuple[str, ...] = ("value", "reference", "delta")) -> DataFrame:
    """Table rows of a Markdown report: section, source, ts, event_id, line, to be sorted by these in this order.

    Sections 1 and 2 count the rows and the findings of the sources and of the archive; 3 and 4 list the findings.
    """
    is_old = F.col("source") == sources.archive
    bar = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    counts = samples.groupBy("source").agg(F.count("*").alias("n")).join(found.groupBy("source").agg(F.count("*").alias("gone")), "source", "left")
    heads = counts.select(F.when(is_old, 2).otherwise(1).alias("section"), "source", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"), bar("source", F.col("n").cast("string"), F.coalesce("gone", F.lit(0)).cast("string")))
    shown = [F.format_string("%+.2f", c) for c in numbers]
    rows = found.select(F.when(is_old, 4).otherwise(3).alias("section"), "source", "ts", "event_id", bar("source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *shown, F.col("reason")))
    return heads.unionByName(rows)


# Headings of the report's sections.
HEADINGS = {
    1: ("## Sources: rows far from their rolling median", "| Source | Rows | Removed |", "|---|---:|---:|"),
    2: ("## Archive", "| Source | Rows | Removed |", "|---|---:|---:|"),
    3: ("## Removed from sources", "| Source | Time (UTC) | Value | Reference | Difference | Reason |", "|---|---|---:|---:|---:|---|"),
    4: ("## Removed from the archive", "| Source | Time (UTC) | Value | Reference | Difference | Reason |", "|---|---|---:|---:|---:|---|"),
}


def write_report(samples: DataFrame, found: DataFrame, sources: Sources, path: str) -> None:
    """The report as Markdown in a folder of parts whose names sort as the text does."""
    spark = samples.sparkSession
    texts = [(k, n, text) for k, (title, *table) in HEADINGS.items() for n, text in enumerate(("", title, "", *table))]
    heads = spark.createDataFrame(texts, "section int, place int, line string").select("section", "place", F.lit(None).cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"), "line")
    lines = heads.unionByName(report_lines(samples, found, sources).withColumn("place", F.lit(9)))
    lines.orderBy("section", "place", "source", "ts", "event_id").select("line").write.mode("overwrite").text(path)


def store(samples: DataFrame, path: str) -> None:
    """A table with a folder for each source, as rewrite() keeps it."""
    samples.write.mode("overwrite").partitionBy("source").parquet(path)


def rewrite(spark: SparkSession, path: str, found: DataFrame, series: list[str], sources: Sources, archive_only: bool = False) -> list[str]:
    """Take the rows ``found`` out of a table of store(); the sources rewritten, which are few. The others keep their files.

    What stays is written to the shared folder first, then each touched source's folder is replaced as a whole.
    """
    found = cut(found.filter(F.col("source") == sources.archive) if archive_only else found)
    touched = sorted(r[0] for r in found.select("source").distinct().collect())
    if not touched:
        return []
    table = spark.read.parquet(path)
    kept = cut(cleaned(table.filter(F.col("source").isin(touched)), found, series, sources))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    left = {r[0] for r in kept.select("source").distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in set(touched) - left:  # no row is left to replace the folder
        folder = hadoop(f"{path}/source={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
