"""Queries on stored text, records and calibrations, each beside the SQL that gives the same rows.

Stored forms (dates in mixed formats, JSON lists, HTTP dates, labels) are written from the given tables and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, from_micros, micros
from strandline.operators import archive, reconcile, state, text, trace, windows
from strandline.plans.queries import KEYS, SERIES, B, S, live_and_archive, r6, samples
from strandline.sources import history
from strandline.streaming import pipelines

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


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN NULL END AS read_ts FROM events")
def stored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as histories hold them: ISO with a fraction, with a Z, month first, and what is no time."""
    s = samples(spark, sf_dir)
    kind = F.pmod("event_id", F.lit(4))
    shown = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 2, F.date_format("ts", "M/d/yyyy H:mm:ss"))
        .otherwise(F.lit("not a time"))
    )
    return s.select("event_id", history.parsed_time(shown).alias("read_ts"))


@query("SELECT event_type AS source, CASE WHEN event_type = 'error' THEN 'infinity'::DOUBLE ELSE round((1706745600000000 - max(epoch_us(date_trunc('second', ts)))) / 1e6, 3) END AS age_seconds FROM events GROUP BY event_type")
def header_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the newest HTTP date of each source; the headers of one source are broken."""
    broken = F.when(F.col("source") == "error", F.lit("soon"))
    headers = samples(spark, sf_dir).select("source", F.coalesce(broken, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("header"))
    newest = headers.groupBy("source").agg(F.max(text.http_time(F.col("header"))).alias("newest"))
    age = F.round((1706745600000000 - micros("newest")) / 1e6, 3)
    return newest.select("source", F.coalesce(age, F.lit(float("inf"))).alias("age_seconds"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stored, ts AS read_ts FROM events")
def report_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = samples(spark, sf_dir).select("event_id", text.stamp_text(F.col("ts")).alias("stored"))
    return stored.withColumn("read_ts", text.stamp_time(F.col("stored")))


NEAR = ("es", "fr")


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN trim(source) = '' THEN NULL ELSE source END AS event, lang, substr(text, 1, 200) AS head, substr(text, 201) AS body, doc_id % 5 AS k FROM documents),
r AS (SELECT coalesce(event, 'Alert') AS event, coalesce(CASE WHEN trim(head) = '' THEN NULL ELSE trim(head) END, event, 'Alert') AS headline, upper(CASE WHEN k = 0 THEN 'unknown' ELSE 'minor' END) AS severity,
  CASE WHEN k = 1 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id END AS sent, [lang] AS zones, lower(concat_ws(' ', event, head, body)) AS t FROM f)
SELECT event, md5(headline) AS headline_md5, severity, sent, array_to_string(zones, ',') AS zones,
  CASE WHEN contains(t, 'license') OR contains(t, 'token') THEN 1 WHEN contains(t, 'quell') AND zones[1] IN ('es', 'fr') THEN 2 WHEN event IN ('src1', 'src2') AND zones[1] IN ('es', 'fr') THEN 3 END AS tier FROM r"""
)
def alert_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as alert features in JSON, normalised, and their relevance by all their texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k, sent = F.pmod("doc_id", F.lit(5)), F.date_format(F.timestamp_add("SECOND", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    properties = F.struct(
        F.col("source").alias("event"), F.substring("text", 1, 200).alias("headline"), F.expr("substring(text, 201)").alias("description"), F.when(k == 0, None).otherwise("minor").alias("severity"),
        F.when(k != 1, sent).alias("sent"), F.struct(F.array("lang").alias("UGC")).alias("geocode"),
    )
    bodies = docs.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(1000)).alias("feed"), F.floor(F.col("doc_id") / 100).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(properties.alias("properties"))).alias("features"))).alias("body"))
    rows = text.alert_records(bodies)
    tier = text.relevance([F.col(c) for c in ("event", "headline", "description", "instruction")], F.col("zones"), F.col("event"), ["license", "token"], ["quell"], list(NEAR), ["src1", "src2"])
    return rows.select("event", F.md5(F.trim("headline")).alias("headline_md5"), "severity", "sent", F.array_join("zones", ",").alias("zones"), tier.alias("tier"))


@query("WITH l AS (SELECT event_id // 10 AS list, event_id, event_type, ts FROM events), h AS (SELECT list, arg_min(event_type, event_id) AS n, min(event_id) AS e, arg_min(ts, event_id) AS t FROM l WHERE event_type IN ('click', 'error') GROUP BY list) SELECT n AS name, CASE WHEN e % 2 = 0 THEN 'Unknown' ELSE 'obs' END AS observatory, 'ORANGE' AS colour, 'UNSPECIFIED' AS level, date_trunc('second', t) AS sent FROM h")
def status_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of status records in JSON; of each the first whose name contains the target (here the letter k or a doubled r)."""
    s = samples(spark, sf_dir)
    record = F.struct(
        F.col("event_id"), F.when(F.col("source").isin("click", "error"), F.concat(F.lit("Peak "), F.upper("source"))).otherwise(F.col("source")).alias("volcano_name"),
        F.when(F.pmod("event_id", F.lit(2)) == 1, "obs").alias("obs_abbr"), F.lit("orange").alias("color_code"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sent_utc"),
    )
    bodies = s.groupBy(F.floor(F.col("event_id") / 10).alias("list")).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("body"))
    rows = text.status_records(bodies, "peak ")
    return rows.select(F.lower(F.substring("name", 6, 20)).alias("name"), "observatory", "colour", "level", "sent")


@query("SELECT event_id, CASE WHEN abs(value) / 100 < 0.05 THEN 'flat' WHEN abs(value) / 100 < 0.3 THEN 'trending' WHEN abs(value) / 100 < 1.0 THEN 'strong' ELSE 'extreme' END AS slope, CASE WHEN event_id % 20 < 4 THEN 'too few' WHEN event_id % 20 < 12 THEN 'undersampled' ELSE 'typical' END AS n, CASE WHEN value / 100 <= 0 THEN 'invalid' WHEN value / 100 BETWEEN 0.02 AND 0.3 THEN 'typical' WHEN value / 100 < 0.02 THEN 'slow' ELSE 'rapid' END AS rate, CASE WHEN value <= 0 THEN 'invalid' WHEN value < 5 THEN 'small' WHEN value <= 50 THEN 'typical' ELSE 'large' END AS rise FROM events")
def fit_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return samples(spark, sf_dir).select(
        "event_id", text.slope_tint(v / 100).alias("slope"), text.sample_tint(F.pmod("event_id", F.lit(20))).alias("n"), text.rate_tint(v / 100).alias("rate"), text.amplitude_tint(v).alias("rise"),
    )


@query("""WITH x AS (SELECT event_id, ts, ['active', 'calm', 'imminent', 'overdue'][1 + event_id % 4] AS st, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 3 DAY END AS nx, CASE WHEN event_id % 3 > 0 THEN ts - INTERVAL 50 HOUR END AS lo, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 95 HOUR END AS hi FROM events),
b AS (SELECT *, CASE WHEN lo IS NOT NULL THEN '±' || CAST(round_even((epoch_us(hi) - epoch_us(lo)) / 2 / 8.64e10, 0) AS BIGINT) || ' days, ' || strftime(lo, '%b %-d') || ' to ' || strftime(hi, '%b %-d') END AS band FROM x)
SELECT event_id, CASE WHEN st = 'active' THEN 'status' WHEN st = 'overdue' AND (nx IS NOT NULL OR lo IS NOT NULL) THEN 'overdue by' ELSE 'next' END AS title,
CASE WHEN st = 'active' THEN 'under way' WHEN nx IS NULL AND lo IS NULL THEN 'unknown' WHEN st = 'overdue' THEN CASE WHEN hi IS NOT NULL THEN '-4 days' ELSE '-3 days' END WHEN st = 'imminent' THEN 'any time now' WHEN nx IS NOT NULL THEN 'in 3 days' ELSE band END AS headline,
CASE WHEN st = 'active' THEN '' WHEN nx IS NULL AND lo IS NULL THEN 'too few peaks for a forecast' WHEN st = 'overdue' THEN 'expected until ' || strftime(coalesce(hi, nx), '%b %-d') WHEN st = 'imminent' OR nx IS NOT NULL THEN coalesce(band, strftime(nx, '%b %-d')) ELSE 'no single date' END AS detail FROM b""")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = samples(spark, sf_dir), F.col("event_id")
    shift = lambda i: F.col("ts") + F.expr(f"INTERVAL {i}")
    low, high = F.when(F.pmod(e, F.lit(3)) > 0, shift("-50 HOURS")), F.when(F.pmod(e, F.lit(3)) > 0, shift("95 HOURS"))
    kind = F.get(F.array(*map(F.lit, ("active", "calm", "imminent", "overdue"))), F.pmod(e, F.lit(4)).cast("int"))
    line = text.status_line(kind, F.col("ts"), F.when(F.pmod(e, F.lit(5)) > 0, shift("3 DAYS")), low, high)
    return s.select("event_id", line.alias("line")).select("event_id", "line.*")


@query(f"WITH {S}, w AS (SELECT series_id, source, us - us % {DAY} AS d, min(us) AS a, max(us) AS b FROM s GROUP BY ALL) SELECT series_id, source, make_timestamp(d) AS day, CASE WHEN source = 'click' AND abs((b - a) / 3.6e9 - 20.0) > 2.0 THEN 'span' WHEN source = 'view' THEN 'growing span' WHEN abs(b - 1706745600000000) / 3.6e9 > 72.0 THEN 'end' END AS fault FROM w")
def window_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = from_micros(micros("ts") - F.pmod(micros("ts"), F.lit(DAY)))
    spans = samples(spark, sf_dir).groupBy(*KEYS, day.alias("day")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return state.window_faults(spans, {"click": 20.0}, ("view",), now).select(*KEYS, "day", "fault")


@query(f"WITH {S}, ax AS (SELECT series_id, source, -median(value) / 100 AS slope, max(value) AS intercept, min(us) AS a, max(us) AS b FROM s GROUP BY ALL) SELECT event_id, make_timestamp(round(a + (event_id % 800 - 40) / 700.0 * (b - a))::BIGINT) AS pixel_ts, round(slope * (event_id % 300) + intercept, 6) AS pixel_value, round(abs(slope), 6) AS per_pixel FROM s JOIN ax USING (series_id, source)")
def pixel_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    axes = s.groupBy(*KEYS).agg((-F.median("value") / 100).alias("slope"), F.max("value").alias("intercept"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    axes = axes.withColumns({"x0": F.lit(40.0), "x1": F.lit(740.0), "y0": F.lit(20), "y1": F.lit(320)})
    points = s.select(*KEYS, "event_id", F.pmod("event_id", F.lit(800)).cast("double").alias("px"), F.pmod("event_id", F.lit(300)).cast("double").alias("py"))
    out = state.pixels_to_data(points, axes, KEYS)
    return out.select("event_id", F.col("ts").alias("pixel_ts"), r6("value").alias("pixel_value"), r6("per_pixel").alias("per_pixel"))


@query(f"WITH {S}, f AS (SELECT series_id, source, 1 + median(value) / 1000 AS a, median(value) / 10 AS b, avg(value) / 20 AS o, series_id % 2 = 0 AS apply FROM s GROUP BY ALL) SELECT event_id, round(CASE WHEN apply THEN a * value + b ELSE value END - o, 6) AS corrected FROM s JOIN f USING (series_id, source)")
def corrected_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mapped to the anchor in every other series, then freed of their offsets."""
    s = samples(spark, sf_dir)
    mid = F.median("value")
    fits = s.groupBy(*KEYS).agg((1 + mid / 1000).alias("a"), (mid / 10).alias("b")).withColumn("apply", F.pmod("series_id", F.lit(2)) == 0)
    offsets = s.groupBy(*KEYS).agg((F.avg("value") / 20).alias("b"))
    return reconcile.overlay(s, fits, offsets, SERIES).select("event_id", r6("value").alias("corrected"))


@query(f"WITH {S}, m AS (SELECT *, max(us) OVER (PARTITION BY series_id, source) AS mx FROM s), k AS (SELECT *, count(*) OVER (PARTITION BY series_id, source) AS n FROM m WHERE us >= mx - {2 * DAY}) SELECT event_id FROM k WHERE n >= 2")
def sparkline_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recent_slice(samples(spark, sf_dir), KEYS, days=2).select("event_id")


@query(f"WITH {S} SELECT series_id, source, make_timestamp(us - us % {HOUR}) AS bucket, round(avg(value), 9) AS mean_value, count(*) AS n_rows FROM s GROUP BY ALL")
def tumbling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window operator on a table that is complete."""
    return pipelines.window_means(samples(spark, sf_dir), KEYS, "1 hour").withColumn("mean_value", F.round("mean_value", 9))


@query(f"WITH {S} SELECT series_id, source, make_timestamp(us - us % {HOUR} - h * {HOUR}) AS bucket, round(avg(value), 9) AS mean_value, count(*) AS n_rows FROM s, (SELECT unnest(range(6)) AS h) GROUP BY ALL")
def sliding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.window_means(samples(spark, sf_dir), KEYS, "6 hours", "1 hour").withColumn("mean_value", F.round("mean_value", 9))


PROMOTED = f"""WITH {S}, {B}, c AS (SELECT series_id, b_us, arg_max(us, (us, event_id)) AS us, arg_max(value, (us, event_id)) AS value, arg_max(event_id, (us, event_id)) AS event_id FROM b WHERE source = 'click' GROUP BY ALL),
held AS (SELECT DISTINCT series_id, b_us FROM b WHERE source = 'error'),
fresh AS (SELECT c.* FROM c ANTI JOIN held ON c.series_id = held.series_id AND c.b_us = held.b_us),
q AS (SELECT series_id, b_us, count(DISTINCT source) AS n_sources FROM b WHERE source <> 'error' GROUP BY ALL),
k AS (SELECT series_id, us, arg_max(value, event_id) AS value FROM s WHERE source = 'error' GROUP BY ALL),
bef AS (SELECT fresh.*, k.us AS bu, k.value AS bv FROM fresh ASOF LEFT JOIN k ON fresh.series_id = k.series_id AND fresh.us >= k.us),
aft AS (SELECT bef.*, k.us AS au, k.value AS av FROM bef ASOF LEFT JOIN k ON bef.series_id = k.series_id AND bef.us <= k.us),
nr AS (SELECT *, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bu ELSE au END AS nu, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bv ELSE av END AS nv FROM aft),
pr AS (SELECT nr.series_id, nr.b_us, event_id, value FROM nr JOIN q USING (series_id, b_us) WHERE n_sources >= 2 OR (abs(us - nu) <= 1800000000 AND abs(value - nv) <= 3.0))"""


@query(f"{PROMOTED} SELECT series_id, event_id, value FROM pr")
def archive_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, old = live_and_archive(samples(spark, sf_dir))
    return archive.promote(live.filter("source = 'click'"), live, old, SERIES).select("series_id", "event_id", "value")


@query(f"{PROMOTED}, o AS (SELECT c.series_id, count(*) AS offered, count(held.b_us) AS already FROM c LEFT JOIN held ON c.series_id = held.series_id AND c.b_us = held.b_us GROUP BY ALL), n AS (SELECT series_id, count(*) AS promoted FROM pr GROUP BY ALL), f AS (SELECT series_id, count(*) AS before FROM s WHERE source = 'error' GROUP BY ALL) SELECT series_id, before AS rows_before, coalesce(promoted, 0) AS rows_promoted, already AS rows_archived_already, offered - already - coalesce(promoted, 0) AS rows_deferred, before + coalesce(promoted, 0) AS rows_after FROM o LEFT JOIN n USING (series_id) LEFT JOIN f USING (series_id)")
def promotion_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, old = live_and_archive(samples(spark, sf_dir))
    return archive.promotion_report(live.filter("source = 'click'"), live, old, SERIES)


# Plots made of the events: a plot per series and source, 120 columns wide (errors 1 000, too many to be covered) and 300
# rows high, of 30 days; a saw of two rows a column, up to nine rows thick, with a stray dot for every 97th event.
FROM_US = 1704067200000000
SPAN_US = 30 * DAY
LIT = f"""{S}, pl AS (SELECT DISTINCT series_id, source, CASE WHEN source = 'error' THEN 1000 ELSE 120 END AS w, CASE WHEN source = 'click' THEN -1.0::DOUBLE ELSE -0.125::DOUBLE END AS slope FROM s),
placed AS (SELECT s.*, w, slope, ((us - {FROM_US}) * w) // {SPAN_US} AS x FROM s JOIN pl USING (series_id, source)),
px AS (SELECT series_id, source, w, slope, x, (x * 2) % 200 + floor(value * 10)::BIGINT % 9 + CASE WHEN event_id % 97 = 0 THEN 90 ELSE 0 END AS y FROM placed WHERE event_id % 36 <= 30 AND event_id % 17 > 0 AND us >= {FROM_US}),
lit AS (SELECT DISTINCT * FROM px WHERE x < w AND y BETWEEN 0 AND 299 AND NOT (x >= 6 AND x < 164 AND y >= 6 AND y < 44)),
cols AS (SELECT series_id, source, w, slope, x, count(*) AS n, median(y)::DOUBLE AS mid, min(y)::DOUBLE AS top, max(y)::DOUBLE AS bot FROM lit GROUP BY ALL),
cov AS (SELECT *, count(*) OVER (PARTITION BY series_id, source) / w AS coverage FROM cols),
early AS (SELECT *, CASE WHEN coverage < 0.5 THEN 'uncovered' WHEN n > 8 THEN 'wide' END AS early FROM cov),
ok AS (SELECT *, row_number() OVER (PARTITION BY series_id, source ORDER BY x) AS k FROM early WHERE early IS NULL),
tr AS (SELECT series_id, source, k, mid AS r FROM ok WHERE k = 1
  UNION ALL SELECT ok.series_id, ok.source, ok.k, CASE WHEN n <= 3 THEN mid WHEN abs(top - r) > abs(bot - r) THEN top ELSE bot END FROM tr JOIN ok ON ok.series_id = tr.series_id AND ok.source = tr.source AND ok.k = tr.k + 1),
dat AS (SELECT ok.*, r, round({FROM_US} + x::DOUBLE / w * {SPAN_US})::BIGINT AS us, slope * (20 + r) + 60 AS value FROM ok JOIN tr USING (series_id, source, k)),
gap AS (SELECT *, floor((us - lag(us) OVER o) / 1e6) AS sec, abs(value - lag(value) OVER o) AS step FROM dat WINDOW o AS (PARTITION BY series_id, source ORDER BY us)),
st AS (SELECT *, coalesce(step / (CASE WHEN sec <= 0 THEN 60.0 ELSE sec END / 3600.0) > 15.0, FALSE) AS steep FROM gap),
mk AS (SELECT *, steep OR coalesce(lead(steep) OVER (PARTITION BY series_id, source ORDER BY us), FALSE) AS marked FROM st),
rt AS (SELECT *, marked AND avg(marked::INT) OVER (PARTITION BY series_id, source) <= 0.2 AS rate FROM mk),
md AS (SELECT *, median(value) OVER f AS m, count(*) OVER f AS near, count(*) OVER (PARTITION BY series_id, source, rate) AS many FROM rt WINDOW f AS (PARTITION BY series_id, source, rate ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
tv AS (SELECT series_id, source, x, r, us, value, CASE WHEN rate THEN 'rate' WHEN many >= 10 AND near >= 3 AND abs(value - m) > 4.0 THEN 'outlier' ELSE 'kept' END AS late FROM md),
traced AS (SELECT early.series_id, early.source, early.x, n, coverage, r, us, value, coalesce(early, late) AS verdict FROM early LEFT JOIN tv USING (series_id, source, x))"""


def plotted(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels and plots as above."""
    width = F.when(F.col("source") == "error", 1000).otherwise(120)
    pixels = s.withColumns({"us": micros("ts"), "w": width}).withColumn("x", F.floor((F.col("us") - FROM_US) * F.col("w") / F.lit(SPAN_US)).cast("long"))
    stray = F.when(F.pmod("event_id", F.lit(97)) == 0, 90).otherwise(0)
    pixels = pixels.select(
        *KEYS, (F.col("x") + 75).alias("px"), (20 + F.pmod(F.col("x") * 2, F.lit(200)) + F.pmod(F.floor(F.col("value") * 10), F.lit(9)) + stray).alias("py"),
        (100 + F.pmod("event_id", F.lit(36))).alias("hue"), F.when(F.pmod("event_id", F.lit(17)) == 0, 90).otherwise(200).alias("saturation"), F.lit(180).alias("brightness"),
    )
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    plots = s.select(*KEYS).distinct().select(
        *KEYS, F.lit(75).alias("x0"), F.lit(20).alias("y0"), (75 + width).alias("x1"), F.lit(320).alias("y1"),
        F.when(F.col("source") == "click", -1.0).otherwise(-0.125).alias("slope"), F.lit(60.0).alias("intercept"),
        start.alias("start_ts"), (start + F.expr("INTERVAL 30 DAYS")).alias("end_ts"),
    )
    return pixels, plots


@query(f'WITH RECURSIVE {LIT} SELECT series_id, source, x, n::INTEGER AS n_lit, r AS "row", make_timestamp(us) AS ts, value, verdict FROM traced')
def curve_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lit column of every plot with the row that the curve takes there and what becomes of it."""
    out = trace.trace(*plotted(samples(spark, sf_dir)), KEYS)
    return out.select(*KEYS, "x", "n_lit", "row", F.when(F.col("row").isNotNull(), F.col("ts")).alias("ts"), "value", "verdict")


@query(f"WITH RECURSIVE {LIT} SELECT series_id, source, round(max(coverage), 6) AS coverage, count(*) FILTER (verdict IN ('rate', 'outlier', 'kept')) AS rows_raw, count(*) FILTER (verdict = 'wide') AS columns_dropped_width, count(*) FILTER (verdict = 'rate') AS rows_dropped_rate, count(*) FILTER (verdict = 'outlier') AS rows_dropped_outlier, count(*) FILTER (verdict = 'kept') AS rows_kept, count(*) FILTER (verdict IN ('rate', 'outlier', 'kept')) = 0 AS rejected FROM traced GROUP BY ALL")
def trace_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, plots = plotted(samples(spark, sf_dir))
    return trace.report(trace.trace(pixels, plots, KEYS), plots, KEYS).withColumn("coverage", r6("coverage"))
