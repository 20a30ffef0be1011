"""Queries that write files or run streams over the driver tables and give what is read back, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, micros
from strandline.operators import cleaning, reconcile
from strandline.operators.scans import shared_dir
from strandline.plans.queries import EPISODES, KEYS, SERIES, SOURCES, S, samples, sql_floor, sql_round
from strandline.plans.report_queries import FOUND
from strandline.sources import history
from strandline.sources.run_source import append_runs, read_runs
from strandline.streaming import pipelines
from strandline.streaming.episodes import closed_episodes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, at_once: int = 1) -> DataFrame:
    """The events as a stream of samples, so many files a batch."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(known).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", "*.parquet")
    part = f"{sf_dir}/events.parquet*"
    n_series = 4
    events = raw.parquet(part)
    return events.select("event_id", F.pmod("user_id", F.lit(n_series)).cast("int").alias("series_id"), F.col("event_type").alias("source"), "ts", "value")


STREAMED = "e AS (SELECT event_id, CAST(user_id % 4 AS INTEGER) AS series_id, event_type AS source, ts, value, epoch_us(ts) AS us FROM events)"


@query(f"WITH {S} SELECT ts, value, count(*) AS n FROM s GROUP BY ALL")
def history_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples exported with the stored column names and read as a history."""
    path = _folder(spark, "history")
    history.export_csv(samples(spark, sf_dir), path)
    return history.read_history(spark, path, value_column="Value").groupBy("ts", "value").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT series_id, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def merged_sink_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as a table, twice: the second writing replaces the first."""
    path, s = _folder(spark, "sink"), samples(spark, sf_dir)
    history.write_history(s.filter("event_id % 2 = 0"), path)
    history.write_history(s, path)
    back = spark.read.parquet(path).withColumn("us", micros("ts"))
    return back.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {S} SELECT ts AS date_utc, value, count(*) AS n FROM s WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY ALL")
def range_export_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week exported as CSV, its last day whole."""
    path = _folder(spark, "range")
    history.export_range(samples(spark, sf_dir), path, "2024-01-05", "2024-01-11")
    back = history.read_history(spark, path, time_column="date_utc", value_column="value")
    return back.groupBy(F.col("ts").alias("date_utc"), "value").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT source, make_timestamp({sql_floor('us', DAY)}) AS day, count(*)::VARCHAR AS rows_raw, printf('%.6f', round(avg(value), 6)) AS frame_offset_microrad, CAST(NULL AS VARCHAR) AS plot_bbox FROM s GROUP BY ALL")
def quality_log_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality row per source and day, appended in two halves and read as text."""
    path = _folder(spark, "quality")
    daily = samples(spark, sf_dir).groupBy("source", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_timestamp_utc")).agg(F.count("*").alias("rows_raw"), F.format_string("%.6f", F.round(F.avg("value"), 6)).alias("frame_offset_microrad"))
    for rest in (0, 1):
        history.append_quality(daily.filter(F.pmod(F.dayofmonth("run_timestamp_utc"), F.lit(2)) == rest), path)
    parts = [history.read_quality(spark, f"{path}/source={name}").withColumn("source", F.lit(name)) for name in ("click", "error", "purchase", "signup", "view")]
    back = parts[0]
    for part in parts[1:]:
        back = back.unionByName(part)
    return back.select("source", F.to_timestamp_ntz("run_timestamp_utc").alias("day"), "rows_raw", "frame_offset_microrad", "plot_bbox")


@query(f"""WITH {S}, d AS (SELECT {sql_floor('us', DAY)} AS day, source, count(*)::INTEGER AS n FROM s GROUP BY ALL), r AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM d))
SELECT strftime(make_timestamp(day), '%Y-%m-%d') AS run, source AS source_name, n AS rows_raw FROM d JOIN r USING (day) WHERE k <= 5""")
def reports_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run report per day, written, pruned to the newest five, and read."""
    path = _folder(spark, "reports")
    daily = samples(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_started_at_utc"), "source").agg(F.count("*").cast("int").alias("n"))
    per_source = F.collect_list(F.struct(F.col("source").alias("source_name"), F.lit(True).alias("fetched"), F.col("n").alias("rows_raw")))
    history.write_reports(daily.groupBy("run_started_at_utc").agg(F.lit(2).alias("schema_version"), per_source.alias("per_source")), path)
    history.prune_reports(spark, path, 5)
    rows = history.read_reports(spark, path).select(F.substring("run_started_at_utc", 1, 10).alias("run"), F.explode("per_source").alias("s"))
    return rows.select("run", "s.source_name", "s.rows_raw")


@query(f"WITH {STREAMED}, b AS (SELECT *, {sql_round('us')} AS b_us FROM e) SELECT series_id, source, make_timestamp(b_us) AS bucket, arg_max(ts, (us, event_id)) AS ts, arg_max(value, (us, event_id)) AS value FROM b GROUP BY series_id, source, b_us")
def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sample of each bucket, kept by a stream that reads the events twice: the second delivery changes nothing."""
    path = _folder(spark, "upsert")
    for checkpoint in ("first", "again"):
        pipelines.upsert_buckets(event_stream(spark, sf_dir), KEYS, f"{path}/table", f"{path}/{checkpoint}").awaitTermination()
    return pipelines.current(spark, f"{path}/table").select(*KEYS, "bucket", "ts", "value")


@query(f"WITH {STREAMED} SELECT series_id, make_timestamp({sql_floor('us', DAY)}) AS bucket, round(avg(value), 9) AS mean_value, count(*) AS n_rows FROM e GROUP BY ALL")
def streamed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means from a stream, each window's last state."""
    path = _folder(spark, "means")
    means = pipelines.window_means(event_stream(spark, sf_dir), SERIES, "1 day", late="4000 days")
    name = f"means_{uuid.uuid4().hex}"
    means.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("mean_value", F.round("mean_value", 9))




@query(f"WITH {FOUND} SELECT r.series_id, r.source, count(*) AS n_rows, round(sum(r.value), 4) AS total FROM raw r ANTI JOIN found f ON r.series_id = f.series_id AND r.source = f.source AND r.event_id = f.event_id GROUP BY ALL")
def cleaned_sources_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples stored by source, scanned, and rewritten without what was found."""
    path = _folder(spark, "cleaned")
    cleaning.store(samples(spark, sf_dir), path)
    found = cleaning.scan(spark.read.parquet(path), SERIES, SOURCES, lambda live: reconcile.merge(live, SERIES, SOURCES))
    cleaning.rewrite(spark, path, found, SERIES, SOURCES)
    return spark.read.parquet(path).groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {EPISODES} SELECT series_id, make_timestamp(prev) AS prev_ts, make_timestamp(cur) AS end_ts, make_timestamp(t_us) AS trough_ts, t_v AS trough_value, n_rows FROM epi")
def streamed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that a stream closes while the first and then the second half of the days arrives; a row of 2100 ends all days."""
    path, s = _folder(spark, "episodes"), samples(spark, sf_dir)
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    end = s.limit(1).withColumns({"series_id": F.lit(-1), "ts": F.lit("2100-01-01").cast("timestamp_ntz"), "value": F.lit(0.0)})
    for rows in (s.filter(half), s.filter(~half), end):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(s.schema).parquet(f"{path}/in")
        closed = closed_episodes(stream, SERIES)
        closed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"""WITH {S}, d AS (SELECT {sql_floor('us', DAY)} AS day, source, count(*)::INTEGER AS n FROM s GROUP BY ALL), r AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM d))
SELECT strftime(make_timestamp(day), '%Y-%m-%d') AS run, source AS source_name, n AS rows_raw FROM d JOIN r USING (day) WHERE k <= 3""")
def newest_runs_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per day through the data source of run reports, in two appends; only the newest three files are opened."""
    path = _folder(spark, "runs")
    daily = samples(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_started_at_utc"), "source").agg(F.count("*").cast("int").alias("n"))
    per_source = F.collect_list(F.struct(F.col("source").alias("source_name"), F.lit(True).alias("fetched"), F.col("n").alias("rows_raw")))
    reports = daily.groupBy("run_started_at_utc").agg(F.lit(2).alias("schema_version"), per_source.alias("per_source"))
    for rest in (0, 1):
        append_runs(reports.filter(F.pmod(F.dayofmonth("run_started_at_utc"), F.lit(2)) == rest), path)
    rows = read_runs(spark, path, newest=3).select(F.substring("run", 1, 10).alias("run"), F.explode("per_source").alias("s"))
    return rows.select("run", "s.source_name", "s.rows_raw")
