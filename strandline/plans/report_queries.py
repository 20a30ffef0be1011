"""Further queries: slices, display, reports, calibration guards, and what dashboards show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, epoch_days, from_micros, local_time, micros
from strandline.operators import archive, cleaning, forecast, joins, peaks, reconcile, state, text, windows
from strandline.plans.queries import BACK, BACK_PARAMS, BETWEEN, KEYS, SERIES, SOURCES, TAGGED, TOPS, B, S, half_day_peaks, live_and_archive, prominent_half_days, r6, samples, sql_floor, sql_round
from strandline.params import DEFAULTS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
Q = 900000000


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


@query(f"WITH {S} SELECT event_id FROM s WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    return samples(spark, sf_dir).filter((F.col("ts") > day(10)) & (F.col("ts") <= day(20))).select("event_id")


@query(f"WITH {S} SELECT event_id FROM (SELECT *, max(us) OVER (PARTITION BY series_id, source) AS m FROM s) WHERE us >= m - {6 * HOUR}")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing(samples(spark, sf_dir), KEYS, 6 * HOUR).select("event_id")


@query(f"WITH {S} SELECT event_id, round(us / 8.64e10, 8) AS day, ts - INTERVAL 10 HOUR AS local_ts FROM s")
def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", F.round(epoch_days("ts"), 8).alias("day"), local_time("ts").alias("local_ts"))


@query(f"WITH {S} SELECT source, round((1706745600000000 - max(us)) / 1e6, 3) AS age_seconds FROM s GROUP BY ALL")
def source_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("source").agg(F.round((1706745600000000 - F.max(micros("ts"))) / 1e6, 3).alias("age_seconds"))


@query(f"WITH {S} SELECT source, string_agg(printf('%.2f', value), ',' ORDER BY us, event_id) AS last20 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY us DESC, event_id DESC) AS k FROM s) WHERE k <= 20 GROUP BY ALL")
def history_of_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = windows.newest(samples(spark, sf_dir), ["source"], 20, F.desc("ts"), F.desc("event_id"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.format_string("%.2f", "value").alias("v"))))
    return last.groupBy("source").agg(F.array_join(F.transform(rows, lambda x: x["v"]), ",").alias("last20"))


@query(f"""WITH RECURSIVE {S}, hm AS (SELECT series_id, source, {sql_floor('us', HOUR)} AS h, avg(value) AS v FROM s GROUP BY ALL),
en AS (SELECT series_id, min(us) AS lo, max(us) AS hi FROM s WHERE source = 'purchase' GROUP BY ALL),
tr AS (SELECT hm.series_id, h, v AS truth FROM hm JOIN en USING (series_id) WHERE source = 'purchase' AND h BETWEEN lo + {6 * HOUR} AND hi - {6 * HOUR}),
pt AS (SELECT *, x0 - mid AS x FROM (SELECT hm.series_id, hm.source, hm.v AS x0, truth AS y, avg(hm.v) OVER o AS mid, count(*) OVER o AS n FROM hm JOIN tr ON hm.series_id = tr.series_id AND hm.h = tr.h WHERE hm.source <> 'purchase' WINDOW o AS (PARTITION BY hm.series_id, hm.source))),
it(k, series_id, source, m, b) AS (SELECT 0, series_id, source, regr_slope(y, x), regr_intercept(y, x) FROM pt WHERE n >= 50 GROUP BY series_id, source
  UNION ALL SELECT k, series_id, source, m, (swy - m * swx) / sw FROM (SELECT k + 1 AS k, series_id, source, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS m
    FROM (SELECT it.k, it.series_id, it.source, x, y, least(1.0, 1.0 / greatest(abs(y - (m * x + b)), 1e-300)) AS w FROM it JOIN pt ON it.series_id = pt.series_id AND it.source = pt.source WHERE k < 60) GROUP BY k, series_id, source)),
ln AS (SELECT pt.series_id, pt.source, any_value(m) AS a, any_value(b - m * mid) AS b, stddev_pop(y - (m * x + it.b)) AS sd FROM it JOIN pt ON it.series_id = pt.series_id AND it.source = pt.source WHERE k = 60 GROUP BY pt.series_id, pt.source)
SELECT c.series_id, c.source, overlap, round(a, 4) AS a, round(b, 4) AS b, round(sd, 4) AS residual_std, coalesce(abs(a - 1) > 0.03 OR abs(b) > 5.0, FALSE) AS apply FROM (SELECT series_id, source, count(*) AS overlap FROM pt GROUP BY ALL) c LEFT JOIN ln USING (series_id, source)""")
def anchor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = reconcile.anchor_fits(samples(spark, sf_dir), SERIES, SOURCES.anchor)
    return fits.withColumns({c: F.round(c, 4) for c in ("a", "b", "residual_std")})


@query(f"WITH {S}, c AS (SELECT series_id, source, (us - 1704067200000000) / 8.64e10 - avg((us - 1704067200000000) / 8.64e10) OVER (PARTITION BY series_id, source) AS x, value AS y FROM s), f AS (SELECT series_id, source, regr_slope(y, x) AS m, regr_intercept(y, x) AS b, regr_slope(x * x, x) AS m2, regr_intercept(x * x, x) AS b2 FROM c GROUP BY ALL), r AS (SELECT series_id, source, y - (m * x + b) AS ry, x * x - (m2 * x + b2) AS rx FROM c JOIN f USING (series_id, source)), z AS (SELECT series_id, source, sum(ry * ry) AS yy, sum(rx * ry) AS xy, sum(rx * rx) AS xx, count(*) AS n FROM r GROUP BY ALL) SELECT series_id, source, round(sqrt(yy / n), 4) AS std_line, round(sqrt(greatest(yy - xy * xy / xx, 0) / n), 4) AS std_bent, sqrt(greatest(yy - xy * xy / xx, 0) / n) < 0.6 * sqrt(yy / n) AS bent FROM z")
def linear_or_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = samples(spark, sf_dir).select(*KEYS, ((micros("ts") - 1704067200000000) / float(DAY)).alias("x"), F.col("value").alias("y"))
    return reconcile.straight_or_bent(points, KEYS).withColumns({c: F.round(c, 4) for c in ("std_line", "std_bent")})


@query("""WITH p AS (SELECT event_id // 8 AS image, event_id AS label_id, (event_id * 37) % 101 + value / 50 AS px, (event_id * 37) % 101 / 4.0 + CASE WHEN event_id % 5 = 0 THEN 9 ELSE 0 END AS value, 70 + event_id % 30 AS conf FROM events),
l AS (SELECT a.image, a.label_id AS i, b.label_id AS j, (b.px - a.px) / (b.value - a.value) AS m, a.px - (b.px - a.px) / (b.value - a.value) * a.value AS c FROM p a JOIN p b ON a.image = b.image AND a.label_id < b.label_id AND a.value <> b.value),
n AS (SELECT l.image, i, j, m, c, count(*) AS inliers, sum(conf) AS conf FROM l JOIN p ON p.image = l.image AND abs(p.px - m * p.value - c) <= 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY inliers DESC, conf DESC, i, j) AS place FROM n)
SELECT image, round(m, 10) AS m, round(c, 10) AS c, inliers, conf::BIGINT AS conf FROM k WHERE place = 1 AND inliers >= 3""")
def ransac_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.pmod(F.col("event_id") * 37, F.lit(101))
    points = e.select(
        F.floor(F.col("event_id") / 8).alias("image"), F.col("event_id").alias("label_id"), (at + F.col("value") / 50).alias("px"),
        (at / 4.0 + F.when(F.pmod("event_id", F.lit(5)) == 0, 9).otherwise(0)).alias("value"), (70 + F.pmod("event_id", F.lit(30))).alias("conf"),
    )
    return state.ransac_line(points, ["image"]).withColumns({"m": F.round("m", 10), "c": F.round("c", 10)})


@query(f"WITH {S}, ax AS (SELECT series_id, source, median(value) AS slope, max(value) AS max_residual FROM s WHERE event_id % 7 = 0 GROUP BY ALL), h AS (SELECT series_id, source, median(value) AS usual FROM s GROUP BY ALL), d AS (SELECT *, abs(slope - usual) / nullif(abs(usual), 0) > 0.03 AND max_residual / nullif(abs(slope), 0) > 1 AS back FROM ax JOIN h USING (series_id, source)) SELECT series_id, source, coalesce(back, FALSE) AS fallback, round(CASE WHEN coalesce(back, FALSE) THEN usual ELSE slope END, 6) AS used_slope FROM d")
def slope_drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    axes = s.filter("event_id % 7 = 0").groupBy(*KEYS).agg(F.median("value").alias("slope"), F.max("value").alias("max_residual"))
    return state.drift_guard(axes, s.withColumn("slope", F.col("value")), KEYS).select(*KEYS, "fallback", r6("used_slope").alias("used_slope"))


@query(f"WITH {S}, d AS (SELECT series_id, {sql_floor('us', DAY)} AS day, max(us) - min(us) AS span FROM s GROUP BY ALL) SELECT series_id, make_timestamp(day) AS day, abs(span - {DAY}) <= {2 * HOUR} AS whole FROM d")
def window_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = from_micros(micros("ts") - F.pmod(micros("ts"), F.lit(DAY)))
    spans = samples(spark, sf_dir).groupBy("series_id", day.alias("day")).agg((F.max(micros("ts")) - F.min(micros("ts"))).alias("span"))
    return spans.select("series_id", "day", (F.abs(F.col("span") - DAY) <= 2 * HOUR).alias("whole"))


@query(f"WITH {BETWEEN} SELECT series_id, make_timestamp(prev) AS prev_ts, make_timestamp(cur) AS end_ts, count(*) AS n_rows FROM rows_in GROUP BY series_id, prev, cur")
def samples_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return joins.in_intervals(s, half_day_peaks(s), SERIES).groupBy("series_id", "prev_ts", "end_ts").agg(F.count("*").alias("n_rows"))


@query(f"WITH {BACK} SELECT series_id, make_timestamp(cur) AS end_ts, make_timestamp(t_us) AS trough_ts, CAST(place AS INTEGER) AS place FROM seg WHERE place <= 7")
def backtest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return peaks.backtest_segments(s, prominent_half_days(s), SERIES, BACK_PARAMS).select("series_id", "end_ts", "trough_ts", "place")


@query(f"WITH {TOPS} SELECT series_id, make_timestamp(us) AS start_ts, make_timestamp(nx) AS end_ts FROM (SELECT *, lead(us) OVER w AS nx, row_number() OVER w AS k FROM tops WINDOW w AS (PARTITION BY series_id ORDER BY us)) WHERE k % 2 = 1 AND nx IS NOT NULL")
def alternating_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("ts")
    spans = half_day_peaks(samples(spark, sf_dir)).withColumns({"end_ts": F.lead("ts").over(w), "k": F.row_number().over(w)})
    return spans.filter("k % 2 = 1 AND end_ts IS NOT NULL").select("series_id", F.col("ts").alias("start_ts"), "end_ts")


@query(f"WITH {TOPS} SELECT series_id, make_timestamp(us) AS ts, row_number() OVER (PARTITION BY series_id ORDER BY us DESC) <= 6 AS used FROM tops")
def peaks_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = half_day_peaks(samples(spark, sf_dir))
    return tops.select("series_id", "ts", (F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts"))) <= 6).alias("used"))


@query(f"WITH {TAGGED}, a AS (SELECT series_id, b_us, event_id, value FROM b WHERE source = 'error') SELECT event_id, round(a.value - m.value, 6) AS delta FROM a JOIN merged m USING (series_id, b_us) WHERE abs(a.value - m.value) > 3.0")
def archive_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    truth = reconcile.merge(s, SERIES, SOURCES).select("series_id", "bucket", F.col("value").alias("truth"))
    _, old = live_and_archive(s)
    delta = F.col("value") - F.col("truth")
    return archive.bucketed(old).join(truth, ["series_id", "bucket"]).filter(F.abs(delta) > 3.0).select("event_id", r6(delta).alias("delta"))


def _round(before: str, name: str, flag: int) -> str:
    near = lambda f, hours: f"{f} OVER (PARTITION BY series_id ORDER BY us RANGE BETWEEN {int(hours * HOUR)} PRECEDING AND {int(hours * HOUR)} FOLLOWING)"
    far = "truth IS NULL AND flag = 0 AND CASE WHEN n_close = 0 THEN n6 >= 3 AND abs(value - m6) > 2.5 ELSE n24 >= 3 AND abs(value - m24) > 3.0 END"
    return f"""{name}w AS (SELECT *, {near("count(act)", 0.5)} - (act IS NOT NULL)::INT AS n_close, {near("count(act)", 6)} AS n6, {near("median(act)", 6)} AS m6, {near("count(act)", 24)} AS n24, {near("median(act)", 24)} AS m24
  FROM (SELECT *, CASE WHEN flag = 0 THEN value END AS act FROM {before})),
{name} AS (SELECT series_id, ts, us, event_id, value, truth, CASE WHEN {far} THEN {flag} ELSE flag END AS flag, CASE WHEN {far} THEN CASE WHEN n_close = 0 THEN m6 ELSE m24 END ELSE ref END AS ref, CASE WHEN {far} THEN n_close = 0 ELSE alone END AS alone FROM {name}w)"""


ARCHIVE_ROUNDS = f"""ar AS (SELECT e.*, {sql_round('us')} AS b_us FROM ({S[6:-1]}) e WHERE source = 'error'),
r0 AS (SELECT ar.series_id, ts, ar.us, event_id, ar.value, m.value AS truth, CASE WHEN abs(ar.value - m.value) > 3.0 THEN 1 ELSE 0 END AS flag, CASE WHEN abs(ar.value - m.value) > 3.0 THEN m.value END AS ref, FALSE AS alone FROM ar LEFT JOIN merged m USING (series_id, b_us)),
{_round('r0', 'r1', 2)}, {_round('r1', 'r2', 3)}"""
LIVE = TAGGED.replace("AS us FROM events)", "AS us FROM events WHERE event_type <> 'error')", 1)


@query(f"WITH {LIVE}, {ARCHIVE_ROUNDS} SELECT series_id, ts, event_id, value, flag FROM r2 WHERE flag > 0")
def contamination_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, old = live_and_archive(samples(spark, sf_dir))
    return archive.contamination_rounds(old, reconcile.merge(live, SERIES, SOURCES), SERIES).drop("reference", "alone")


#: Sources but the anchor freed of outliers; what they merge to judges the archive.
CLEAN = TAGGED.replace(S, f"""raw AS ({S[6:-1]}),
roll AS (SELECT *, median(value) OVER f AS med, count(*) OVER f AS k, count(*) OVER (PARTITION BY series_id, source) AS n FROM raw WINDOW f AS (PARTITION BY series_id, source ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
flt AS (SELECT *, source NOT IN ('error', 'purchase') AND n >= 10 AND k >= 3 AND abs(value - med) > 4.0 AS dropped FROM roll),
s AS (SELECT event_id, series_id, source, ts, value, us FROM flt WHERE source <> 'error' AND NOT dropped)""", 1)
FOUND = f"""{CLEAN}, {ARCHIVE_ROUNDS},
found AS (SELECT series_id, source, event_id, ts, value, med AS ref, 'outlier' AS reason FROM flt WHERE dropped
  UNION ALL SELECT series_id, 'error', event_id, ts, value, ref, CASE WHEN flag = 1 THEN 'truth' WHEN alone THEN 'orphan-isolated' ELSE 'orphan' END FROM r2 WHERE flag > 0)"""


def _found(s: DataFrame) -> DataFrame:
    return cleaning.scan(s, SERIES, SOURCES, lambda live: reconcile.merge(live, SERIES, SOURCES))


@query(f"WITH {FOUND} SELECT series_id, source, event_id, ts, value, round(ref, 6) AS reference, round(value - ref, 6) AS delta, reason FROM found")
def cleaning_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(samples(spark, sf_dir)).withColumns({"reference": r6("reference"), "delta": r6("delta")})


@query(f"""WITH {FOUND}, had AS (SELECT source, count(*) AS n_before FROM raw GROUP BY ALL), gone AS (SELECT source, count(*) AS n FROM found GROUP BY ALL)
SELECT CASE WHEN source = 'error' THEN 2 ELSE 1 END::INTEGER AS section, source, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, '| ' || source || ' | ' || n_before || ' | ' || coalesce(n, 0) || ' |' AS line FROM had LEFT JOIN gone USING (source)
UNION ALL SELECT CASE WHEN source = 'error' THEN 4 ELSE 3 END, source, ts, event_id, '| ' || source || ' | ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || printf('%+.2f', value) || ' | ' || reason || ' |' FROM found""")
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report with what they are sorted by; of a finding's numbers the value, which is stored in hundredths."""
    s = samples(spark, sf_dir)
    return cleaning.report_lines(s, _found(s), SOURCES, numbers=("value",))


@query(f"WITH {S}, w AS (SELECT *, median(value) OVER f AS med, count(*) OVER f AS k, count(*) OVER (PARTITION BY series_id, source) AS n FROM s WINDOW f AS (PARTITION BY series_id, source ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT series_id, source, count(*) AS n_before, count(*) FILTER (NOT (n >= 10 AND k >= 3 AND abs(value - med) > 4.0)) AS n_after FROM w GROUP BY ALL")
def source_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = windows.outlier_flags(samples(spark, sf_dir), KEYS)
    return flags.groupBy(*KEYS).agg(F.count("*").alias("n_before"), F.count(F.when(~F.col("dropped"), 1)).alias("n_after"))


@query(f"WITH {S}, m AS (SELECT series_id, source, {sql_floor('us', Q)} AS q, median(value) AS v FROM s GROUP BY ALL) SELECT a.series_id, round(median(a.v - b.v), 6) AS \"offset\", count(*) AS n_common FROM m a JOIN m b ON a.series_id = b.series_id AND a.q = b.q AND a.source = 'view' AND b.source = 'purchase' GROUP BY a.series_id HAVING count(*) >= 3")
def inspector_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.median_offset(samples(spark, sf_dir), SERIES, "view", "purchase").withColumn("offset", r6("offset"))


@query(f"WITH {TOPS}, x AS (SELECT series_id, max(us) AS hi, max(value) AS mv, min(value) AS nv FROM s GROUP BY ALL), p AS (SELECT series_id, min(us) AS first_us FROM tops GROUP BY ALL) SELECT series_id, make_timestamp(least(hi - {90 * DAY}, first_us - {7 * DAY})) AS zoom_from, make_timestamp(hi + {14 * DAY}) AS zoom_to, round(mv + 0.1 * (mv - nv), 6) AS marker FROM x JOIN p USING (series_id)")
def zoom_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return state.shown_range(s, half_day_peaks(s), SERIES).withColumn("marker", r6("marker"))


@query("SELECT event_id, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n = -1 THEN 'yesterday' WHEN n > 1 THEN 'in ' || n || ' days' ELSE (-n) || ' days ago' END AS phrase FROM (SELECT event_id, CAST(round_even((epoch_us(ts) - 1705276800000000) / 8.64e10, 0) AS INTEGER) AS n FROM events)")
def day_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (micros("ts") - 1705276800000000) / float(DAY)
    return samples(spark, sf_dir).select("event_id", text.day_phrase(days).alias("phrase"))


@query("SELECT event_id, date_trunc('day', ts - INTERVAL 10 HOUR) + INTERVAL 10 HOUR AS day_tick, date_trunc('minute', ts) AS minute_tick FROM events")
def tick_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    local = F.col("ts") - F.expr("INTERVAL 10 HOURS")
    ticks = {name: text.tick_time(F.date_format(local, f), F.col("ts")) for name, f in (("day_tick", "MM/dd"), ("minute_tick", "HH:mm"))}
    return s.select("event_id", *[c.alias(n) for n, c in ticks.items()])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) END AS start_ts, date_trunc('second', ts) + INTERVAL 1 DAY AS end_ts FROM events")
def title_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a day's range, of which every third has a wrong year at its start."""
    s = samples(spark, sf_dir)
    show = lambda c, f="yyyy": F.date_format(c, f"{f}-MM-dd HH:mm:ss")
    start = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("2014"), F.date_format("ts", "-MM-dd HH:mm:ss"))).otherwise(show(F.col("ts")))
    title = F.concat(F.lit("Tilt ("), start, F.lit(" t0 "), show(F.col("ts") + F.expr("INTERVAL 1 DAY")), F.lit(") UTC"))
    low, high = text.repaired_years(title)
    return s.select("event_id", low.alias("start_ts"), high.alias("end_ts"))


@query(f"WITH {S} SELECT source, count(*) AS runs, count(*) FILTER (event_id % 10 = 0) AS failures, sum(event_id % 100)::BIGINT AS rows_appended FROM s GROUP BY ALL")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON per run, read back, and rolled up by source."""
    from strandline.sources.history import REPORT, source_rollup

    one = F.struct(F.col("source").alias("source_name"), F.pmod("event_id", F.lit(100)).cast("int").alias("rows_appended"), F.when(F.pmod("event_id", F.lit(10)) == 0, "failed").alias("error"))
    runs = samples(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 5).alias("run")).agg(F.to_json(F.struct(F.collect_list(one).alias("per_source"))).alias("body"))
    return source_rollup(runs.select(F.from_json("body", REPORT)["per_source"].alias("per_source"))).withColumnRenamed("source_name", "source")


@query(f"WITH {BACK}, st AS (SELECT fraction, round(median(abs(error_h)), 4) AS m FROM err GROUP BY fraction) SELECT 'interval_median' AS model_id, max(m) FILTER (fraction = 0.25) AS at_25, max(m) FILTER (fraction = 0.5) AS at_50, max(m) FILTER (fraction = 0.75) AS at_75, max(m) FILTER (fraction = 1.0) AS at_100 FROM st")
def backtest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    tops = prominent_half_days(s)
    errors = forecast.backtest(s, tops, peaks.backtest_segments(s, tops, SERIES, BACK_PARAMS), SERIES, ["interval_median"], BACK_PARAMS)
    wide = forecast.models_across_stages(forecast.backtest_stats(errors))
    return wide.select("model_id", *[F.round(c, 4).alias(c) for c in wide.columns[1:]])


@query(f"""WITH {BACK}, st AS (SELECT fraction, count(error_h) AS n_scored, count(*) AS n_tasks, median(abs(error_h)) AS m, median(error_h) AS s, avg(error_h) AS a FROM err GROUP BY fraction)
SELECT CAST(fraction AS DOUBLE) AS fraction, 1 AS place, 'interval_median' AS model_id, n_scored || '/' || n_tasks AS coverage, round(m, 4) AS median_abs, round(s, 4) AS median_signed, round(a, 4) AS mean_signed, n_scored >= 0.5 * n_tasks AND m IS NOT NULL AS recommended FROM st""")
def backtest_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of each stage, the most exact first, and which one is recommended there."""
    s = samples(spark, sf_dir)
    tops = prominent_half_days(s)
    errors = forecast.backtest(s, tops, peaks.backtest_segments(s, tops, SERIES, BACK_PARAMS), SERIES, ["interval_median"], BACK_PARAMS)
    table = forecast.models_by_stage(forecast.backtest_stats(errors))
    return table.withColumns({c: F.round(c, 4) for c in ("median_abs", "median_signed", "mean_signed")})


@query(f"WITH {S}, f AS (SELECT event_id, (us % {DAY}) / {float(DAY)} AS x FROM s) SELECT event_id, CASE WHEN x <= 0.375 THEN 0.25 WHEN x <= 0.625 THEN 0.5 WHEN x <= 0.875 THEN 0.75 ELSE 1.0 END::DOUBLE AS fraction FROM f")
def nearest_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.pmod(micros("ts"), F.lit(DAY)) / float(DAY)
    return samples(spark, sf_dir).select("event_id", state.nearest_of(x, DEFAULTS.fractions).alias("fraction"))
