"""The engine's queries over the driver tables, each beside the SQL that gives the same rows.

Events are the samples: event_type is the source, purchase the anchor, error the archive; users are dealt to series of
a few thousand events. Deliveries for the append queries are the even and odd event ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timebuckets import DAY, HOUR, from_micros, micros
from strandline.operators import archive, forecast, joins, line_fits, peaks, reconcile, scans, state, text, windows
from strandline.params import Params

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SERIES = ["series_id"]
KEYS = ["series_id", "source"]
HALF_DAY = 12 * HOUR


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


#: The events' sources as a signal's: purchases are finest and anchor the rest, errors are the archive.
SOURCES = reconcile.Sources({"purchase": 0.01, "view": 0.05, "click": 0.2, "signup": 0.5}, anchor="purchase", archive="error")
#: Users are dealt to so many events a series, so that series grow in number and not in length.
SERIES_EVENTS = 2500


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n_series = max(4, events.count() // SERIES_EVENTS)
    return events.select("event_id", F.pmod("user_id", F.lit(n_series)).cast("int").alias("series_id"), F.col("event_type").alias("source"), "ts", "value")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r9(c: Column | str) -> Column:
    """For means: finer than the ties that sums of hundredths over small powers of two make."""
    return F.round(c, 9)


# SQL building blocks ---------------------------------------------------------------------------------------------------

S = "s AS (SELECT event_id, CAST(user_id % (SELECT greatest(4, count(*) // 2500) FROM events) AS INTEGER) AS series_id, event_type AS source, ts, value, epoch_us(ts) AS us FROM events)"
Q = 900000000


def sql_round(us: str, width: int = Q) -> str:
    return f"({us} - {us} % {width} + CASE WHEN 2 * ({us} % {width}) > {width} THEN {width} WHEN 2 * ({us} % {width}) = {width} THEN (({us} // {width}) % 2) * {width} ELSE 0 END)"


def sql_floor(us: str, width: int) -> str:
    return f"({us} - {us} % {width})"


B = f"b AS (SELECT *, {sql_round('us')} AS b_us FROM s)"
LAST = "last AS (SELECT series_id, b_us, source, arg_max(us, (us, event_id)) AS us, arg_max(value, (us, event_id)) AS value FROM b GROUP BY ALL)"
STRIDE = """st AS (SELECT series_id, source, median(step) AS med FROM (SELECT series_id, source, us - lag(us) OVER (PARTITION BY series_id, source ORDER BY us) AS step FROM d) WHERE step IS NOT NULL GROUP BY ALL)"""
DENSE = f"""d AS (SELECT series_id, source, us, arg_max(value, event_id) AS value FROM s GROUP BY ALL),
{STRIDE},
span AS (SELECT series_id, source, ((min(us) + {Q - 1}) // {Q}) * {Q} AS lo, (max(us) // {Q}) * {Q} AS hi FROM d GROUP BY ALL),
grid AS (SELECT series_id, source, unnest(range(lo, hi + 1, {Q})) AS g FROM span),
before AS (SELECT grid.*, d.us AS b_us, d.value AS b_v FROM grid ASOF JOIN d ON grid.series_id = d.series_id AND grid.source = d.source AND grid.g >= d.us),
around AS (SELECT before.*, d.us AS a_us, d.value AS a_v FROM before ASOF JOIN d ON before.series_id = d.series_id AND before.source = d.source AND before.g <= d.us),
dense AS (SELECT series_id, source, g, b_v + (a_v - b_v) * (CASE WHEN a_us > b_us THEN (g - b_us)::DOUBLE / (a_us - b_us) ELSE 0 END) AS value
  FROM around JOIN st USING (series_id, source) WHERE least(g - b_us, a_us - g) <= greatest(3 * med, {Q}))"""
TAGGED = f"""{S}, {B}, {LAST}, {DENSE},
tag AS (SELECT series_id, b_us, source, us, value, TRUE AS actual FROM last
  UNION ALL SELECT series_id, g, source, g, value, FALSE FROM dense WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.series_id = dense.series_id AND last.source = dense.source AND last.b_us = dense.g)),
res AS (SELECT *, CASE source WHEN 'purchase' THEN 0.01 WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.5 WHEN 'error' THEN 'infinity'::DOUBLE ELSE 1.0 END AS r FROM tag),
win AS (SELECT series_id, b_us, arg_min({{'source': source, 'us': us, 'value': value, 'actual': actual}}, (r, us, source)) AS w, min(us) FILTER (actual) AS first_us, count(*) AS k FROM res GROUP BY ALL),
merged AS (SELECT series_id, b_us, CASE WHEN w.actual THEN w.us ELSE coalesce(first_us, b_us) END AS us, w.value AS value, w.source AS winner, k FROM win)"""


def hourly_sql(width: int) -> str:
    return f"""{S}, c AS (SELECT series_id, us, arg_max(value, event_id) AS value FROM s GROUP BY ALL),
c2 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM c),
m AS (SELECT series_id, {sql_floor("us", width)} AS us, avg(value) AS mean FROM c2 WHERE n >= 2 GROUP BY ALL),
g AS (SELECT series_id, unnest(range(min(us), max(us) + 1, {width})) AS us FROM m GROUP BY series_id),
j AS (SELECT g.series_id, g.us, m.mean, last_value(CASE WHEN mean IS NOT NULL THEN g.us END IGNORE NULLS) OVER w1 AS bu, last_value(mean IGNORE NULLS) OVER w1 AS bv,
  first_value(CASE WHEN mean IS NOT NULL THEN g.us END IGNORE NULLS) OVER w2 AS au, first_value(mean IGNORE NULLS) OVER w2 AS av
  FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.us = m.us
  WINDOW w1 AS (PARTITION BY g.series_id ORDER BY g.us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY g.series_id ORDER BY g.us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT series_id, us, coalesce(mean, bv + (av - bv) * ((us - bu)::DOUBLE / (au - bu))) AS value, mean IS NULL AS filled FROM j)"""


# Values of a half-day grid are means of many samples, so that flat tops do not occur and lag and lead suffice here.
TOPS = f"""{hourly_sql(HALF_DAY)},
tops AS (SELECT series_id, us, value FROM (SELECT *, lag(value) OVER w AS lv, lead(value) OVER w AS nv FROM h WINDOW w AS (PARTITION BY series_id ORDER BY us)) WHERE value > lv AND value > nv)"""
BETWEEN = f"""{TOPS},
e AS (SELECT series_id, lag(us) OVER (PARTITION BY series_id ORDER BY us) AS prev, us AS cur FROM tops),
rows_in AS (SELECT e.series_id, prev, cur, s.us, s.value, s.event_id FROM e JOIN s ON s.series_id = e.series_id AND s.us > prev AND s.us <= cur WHERE prev IS NOT NULL)"""
EPISODES = f"""{BETWEEN},
low AS (SELECT series_id, prev, cur, arg_min(us, (value, us, event_id)) FILTER (us <= prev + {14 * DAY}) AS t_us, arg_min(value, (value, us, event_id)) FILTER (us <= prev + {14 * DAY}) AS t_v FROM rows_in GROUP BY ALL HAVING count(*) >= 50 AND count(*) FILTER (us <= prev + {14 * DAY}) > 0),
ep AS (SELECT series_id, prev, cur, t_us, t_v, count(*) AS n_rows FROM low JOIN rows_in USING (series_id, prev, cur) WHERE us >= t_us GROUP BY ALL HAVING count(*) >= 50),
epi AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cur DESC) AS place FROM ep)"""
TROUGH = f"""lastp AS (SELECT series_id, max(us) AS p_us FROM tops GROUP BY ALL),
tr AS (SELECT s.series_id, p_us, arg_min(us, (value, us, event_id)) AS t_us, arg_min(value, (value, us, event_id)) AS t_v FROM s JOIN lastp USING (series_id) WHERE us > p_us AND us <= p_us + {14 * DAY} GROUP BY ALL)"""


def half_day_peaks(s: DataFrame) -> DataFrame:
    return scans.cut(peaks.local_maxima(peaks.hourly(s, SERIES, HALF_DAY), SERIES))


def known_and_new(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1")


def live_and_archive(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.filter(F.col("source") != SOURCES.archive), s.filter(F.col("source") == SOURCES.archive)


# Aggregations --------------------------------------------------------------------------------------------------------------


@query(f"WITH {S} SELECT series_id, source, make_timestamp({sql_floor('us', HOUR)}) AS bucket, round(avg(value), 9) AS mean_value, count(*) AS n_rows FROM s GROUP BY ALL")
def bucket_mean_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.bucket_means(samples(spark, sf_dir), KEYS, HOUR).withColumn("mean_value", r9("mean_value"))


@query(f"WITH {S} SELECT series_id, make_timestamp({sql_floor('us', Q)}) AS bucket, round(median(value), 6) AS mid FROM s GROUP BY ALL")
def bucket_median_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("series_id", from_micros(micros("ts") - F.pmod(micros("ts"), F.lit(Q))).alias("bucket")).agg(r6(F.median("value")).alias("mid"))


PAIRS = f"""{S}, m AS (SELECT series_id, source, {sql_floor('us', HOUR)} AS h, avg(value) AS v FROM s GROUP BY ALL),
fit AS (SELECT a.series_id, a.source AS source_i, b.source AS source_j, count(*) AS overlap, median(a.v - b.v) AS beta, stddev_pop(a.v - b.v) AS sd
  FROM m a JOIN m b ON a.series_id = b.series_id AND a.h = b.h AND a.source < b.source GROUP BY ALL HAVING count(*) >= 20)"""


@query(f"WITH {PAIRS} SELECT series_id, source_i, source_j, overlap, round(beta, 6) AS beta, round(sd, 6) AS residual_std FROM fit")
def pairwise_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = reconcile.pairwise_offsets(samples(spark, sf_dir), SERIES)
    return fits.withColumns({"beta": r6("beta"), "residual_std": r6("residual_std")})


@query(
    f"""WITH RECURSIVE {PAIRS}, links AS (SELECT series_id, source_i AS a, source_j AS b FROM fit UNION SELECT series_id, source_j, source_i FROM fit),
pin AS (SELECT series_id, CASE WHEN bool_or(source = 'purchase') THEN 'purchase' ELSE min(source) END AS source FROM s GROUP BY ALL),
reach AS (SELECT series_id, source FROM pin UNION SELECT r.series_id, l.b FROM reach r JOIN links l ON l.series_id = r.series_id AND l.a = r.source)
SELECT x.series_id, x.source, reach.source IS NOT NULL AS reachable FROM (SELECT DISTINCT series_id, source FROM s) x LEFT JOIN reach USING (series_id, source)"""
)
def pair_graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return reconcile.solve_offsets(s, reconcile.pairwise_offsets(s, SERIES), SERIES, SOURCES).select("series_id", "source", "reachable")


@query(
    f"""WITH RECURSIVE {PAIRS}, links AS (SELECT series_id, source_i AS a, source_j AS b, beta AS d FROM fit UNION ALL SELECT series_id, source_j, source_i, -beta FROM fit),
pin AS (SELECT series_id, CASE WHEN bool_or(source = 'purchase') THEN 'purchase' ELSE min(source) END AS source FROM s GROUP BY ALL),
reach AS (SELECT series_id, source FROM pin UNION SELECT r.series_id, l.b FROM reach r JOIN links l ON l.series_id = r.series_id AND l.a = r.source),
free AS (SELECT r.series_id, r.source FROM reach r JOIN pin USING (series_id) WHERE r.source <> pin.source),
sweep(k, series_id, source, b) AS (SELECT 0, series_id, source, 0.0::DOUBLE FROM reach
  UNION ALL SELECT * FROM (SELECT w.k + 1, w.series_id, l.a, CASE WHEN any_value(f.source) IS NULL THEN 0.0 ELSE avg(w.b + l.d) END FROM sweep w JOIN links l ON l.series_id = w.series_id AND l.b = w.source LEFT JOIN free f ON f.series_id = l.series_id AND f.source = l.a WHERE w.k < 400 GROUP BY w.k, w.series_id, l.a)),
done AS (SELECT series_id, source, b FROM sweep WHERE k = 400)
SELECT x.series_id, x.source, round(coalesce(done.b, 0.0), 4) AS b, reach.source IS NOT NULL AS reachable, (SELECT count(*) FROM links l WHERE l.series_id = x.series_id AND l.a = x.source AND reach.source IS NOT NULL)::INTEGER AS pairs_used
FROM (SELECT DISTINCT series_id, source FROM s) x LEFT JOIN reach USING (series_id, source) LEFT JOIN done USING (series_id, source)"""
)
def solved_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return reconcile.solve_offsets(s, reconcile.pairwise_offsets(s, SERIES), SERIES, SOURCES).withColumn("b", F.round("b", 4))


@query(f"WITH {S}, {B} SELECT series_id, make_timestamp(b_us) AS bucket, count(DISTINCT source) AS n_sources FROM b GROUP BY ALL")
def sources_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.bucketed(samples(spark, sf_dir)).groupBy("series_id", "bucket").agg(F.countDistinct("source").alias("n_sources"))


@query(f"WITH {S} SELECT series_id, source, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS q90 FROM s GROUP BY ALL")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {f"q{int(x * 100)}": r6(F.percentile("value", F.lit(x))) for x in (0.1, 0.25, 0.75, 0.9)}
    return samples(spark, sf_dir).groupBy(*KEYS).agg(*[c.alias(n) for n, c in q.items()])


@query(f"WITH {S}, m AS (SELECT series_id, source, median(value) AS med FROM s GROUP BY ALL) SELECT series_id, source, round(med, 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS sigma FROM s JOIN m USING (series_id, source) GROUP BY ALL")
def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    mid = s.groupBy(*KEYS).agg(F.median("value").alias("med"))
    return s.join(mid, KEYS).groupBy(*KEYS, r6("med").alias("med")).agg(r6(1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("sigma"))


@query(f"WITH {S}, p AS (SELECT k.series_id, k.event_id, k.us, k.value FROM s k WHERE event_id % 2 = 1), d AS (SELECT p.series_id, round(p.value - n.value, 2) AS delta FROM p ASOF JOIN (SELECT * FROM s WHERE event_id % 2 = 0) n ON p.series_id = n.series_id AND p.us >= n.us), sp AS (SELECT series_id, count(*) AS n_pairs, min(delta) AS lo, max(delta) AS hi, median(delta) AS mid FROM d GROUP BY ALL), bins AS (SELECT d.series_id, delta, n_pairs, lo, hi, mid, floor((delta - lo + 0.2) / 0.2) AS bin FROM d JOIN sp USING (series_id)), top AS (SELECT series_id, arg_max(bin, (n, -bin)) AS top FROM (SELECT series_id, bin, count(*) AS n FROM bins GROUP BY ALL) GROUP BY ALL), c AS (SELECT *, lo - 0.2 + (top + 0.5) * 0.2 AS centre FROM bins JOIN top USING (series_id)), f AS (SELECT series_id, n_pairs, lo, hi, mid, centre, median(CASE WHEN abs(delta - centre) <= 0.2 THEN delta END) AS nm, count(CASE WHEN abs(delta - centre) <= 0.2 THEN delta END) AS nn FROM c GROUP BY ALL) SELECT series_id, round(CASE WHEN n_pairs < 5 OR hi - lo < 0.5 THEN mid WHEN nn >= 3 THEN nm ELSE centre END, 6) AS \"offset\", n_pairs FROM f")
def offset_mode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = known_and_new(samples(spark, sf_dir))
    both = known.select("series_id", micros("ts").alias("us"), F.col("value").alias("old"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("value")).unionByName(
        new.select("series_id", micros("ts").alias("us"), F.lit(None).cast("double").alias("old"), F.lit(1).alias("side"), "value")
    )
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("us", "side").rowsBetween(Window.unboundedPreceding, 0)
    deltas = both.withColumn("old", F.last("old", ignorenulls=True).over(w)).filter("side = 1 AND old IS NOT NULL").select("series_id", F.round(F.col("value") - F.col("old"), 2).alias("delta"))
    return archive.mode_offset(deltas, SERIES).withColumn("offset", r6("offset"))


# Windows -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S}, w AS (SELECT *, median(value) OVER f AS med, count(*) OVER f AS k, count(*) OVER (PARTITION BY series_id, source) AS n FROM s WINDOW f AS (PARTITION BY series_id, source ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, round(CASE WHEN k >= 3 THEN med END, 6) AS local_median, coalesce(n >= 10 AND k >= 3 AND abs(value - med) > 4.0, FALSE) AS dropped FROM w")
def rolling_median_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.outlier_flags(samples(spark, sf_dir), KEYS).select("event_id", r6("local_median").alias("local_median"), "dropped")


@query(f"WITH {S}, w AS (SELECT *, us - lag(us) OVER f AS du, value - lag(value) OVER f AS dv FROM s WINDOW f AS (PARTITION BY series_id, source ORDER BY us)), x AS (SELECT *, coalesce(abs(dv) / (CASE WHEN floor(du / 1e6) <= 0 THEN 60 ELSE floor(du / 1e6) END / 3600.0) > 15.0, FALSE) AS steep FROM w), y AS (SELECT *, steep OR coalesce(lead(steep) OVER (PARTITION BY series_id, source ORDER BY us), FALSE) AS marked FROM x) SELECT event_id, marked, marked AND avg(marked::INT) OVER (PARTITION BY series_id, source) <= 0.2 AS dropped FROM y")
def rate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_flags(samples(spark, sf_dir), KEYS).select("event_id", "marked", "dropped")


@query(f"WITH {S}, w AS (SELECT series_id, source, lag(ts) OVER f AS before_ts, ts, lag(value) OVER f AS before_value, value FROM s WINDOW f AS (PARTITION BY series_id, source ORDER BY us)) SELECT *, round(abs(value - before_value), 6) AS delta FROM w WHERE abs(value - before_value) > 4.0")
def continuity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.steps_between(samples(spark, sf_dir), KEYS).withColumn("delta", r6("delta"))


@query(f"WITH {S}, d AS (SELECT * FROM s), {STRIDE} SELECT series_id, source, med AS median_us FROM st")
def median_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.strides(samples(spark, sf_dir), KEYS).select(*KEYS, "median_us")


@query(f"WITH {S} SELECT event_id, round(median(value) OVER (PARTITION BY series_id, source ORDER BY us ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS local_median FROM s")
def rolling_median_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_median(samples(spark, sf_dir), KEYS, 3, 2, 1).select("event_id", r6("local_median").alias("local_median"))


@query(f"WITH {S}, w AS (SELECT event_id, value AS f0, us / 3.6e9 - lag(us / 3.6e9) OVER o AS hb, lead(us / 3.6e9) OVER o - us / 3.6e9 AS ha, lag(value) OVER o AS fb, lead(value) OVER o AS fa FROM s WINDOW o AS (PARTITION BY series_id, source ORDER BY us)) SELECT event_id, round(CASE WHEN hb IS NOT NULL AND ha IS NOT NULL THEN (hb ** 2 * fa + (ha ** 2 - hb ** 2) * f0 - ha ** 2 * fb) / (hb * ha * (ha + hb)) WHEN hb IS NOT NULL THEN (f0 - fb) / hb ELSE (fa - f0) / ha END, 2) AS gradient FROM w")
def gradient_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gradient(samples(spark, sf_dir), KEYS).select("event_id", F.round("gradient", 2).alias("gradient"))


@query(f"WITH {S} SELECT event_id, count(*) OVER f AS near_rows, round(median(value) OVER f, 6) AS near_median FROM s WINDOW f AS (PARTITION BY series_id, source ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING)")
def six_hours_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.around(samples(spark, sf_dir), KEYS, 6 * HOUR).select("event_id", "near_rows", r6("near_median").alias("near_median"))


@query(f"WITH {S}, {B} SELECT series_id, source, make_timestamp(b_us) AS bucket, arg_max(event_id, (us, event_id)) AS event_id, arg_max(value, (us, event_id)) AS value FROM b GROUP BY series_id, source, b_us")
def dedupe_keep_last_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.bucketed(samples(spark, sf_dir)).select(*KEYS, "bucket", "ts", "event_id", "value")
    return windows.keep_last(rows, [*KEYS, "bucket"], F.col("ts"), F.col("event_id")).drop("ts")


@query(f"WITH {S} SELECT series_id, event_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, event_id) AS INTEGER) AS place FROM s) WHERE place <= 20")
def largest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest(samples(spark, sf_dir), SERIES, 20, F.desc(F.abs("value")), F.col("event_id")).select("series_id", "event_id", "place")


@query(f"WITH {S}, c AS (SELECT *, count(*) OVER p AS n, max(us) OVER p AS m FROM s WINDOW p AS (PARTITION BY series_id, source)), k AS (SELECT *, sum((us >= m - {168 * HOUR})::INT) OVER (PARTITION BY series_id, source) AS recent, row_number() OVER (PARTITION BY series_id, source ORDER BY us DESC, event_id DESC) AS back FROM c) SELECT series_id, source, count(*) AS n_rows, round(regr_slope(value, (us - m) / 3.6e9), 6) AS slope FROM k WHERE back <= least(ceil(n * 0.5), recent) GROUP BY ALL")
def late_window_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = windows.late_window(samples(spark, sf_dir), KEYS)
    from pyspark.sql import Window

    hours = (micros("ts") - F.max(micros("ts")).over(Window.partitionBy(*KEYS))) / 3.6e9
    return late.withColumn("hours", hours).groupBy(*KEYS).agg(F.count("*").alias("n_rows"), r6(F.regr_slope("value", "hours")).alias("slope"))


@query(f"WITH {S}, m AS (SELECT *, max(us) OVER (PARTITION BY series_id, source) AS mx FROM s) SELECT series_id, source, count(*) AS n_rows, round(CASE WHEN count(*) >= 3 AND count(DISTINCT us) >= 2 THEN regr_slope(value, (us - mx) / 3.6e9) END, 6) AS slope FROM m WHERE us >= mx - {24 * HOUR} GROUP BY ALL")
def trailing_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_slope(samples(spark, sf_dir), KEYS, 24 * HOUR).withColumn("slope", r6("slope"))


@query(f"WITH {S}, m AS (SELECT *, max(us) OVER (PARTITION BY series_id, source) AS mx FROM s) SELECT series_id, source, max(value) AS recent_max, arg_max(value, (us, event_id)) AS last_value, round(max(value) - arg_max(value, (us, event_id)), 6) AS \"drop\" FROM m WHERE us >= mx - {24 * HOUR} GROUP BY ALL")
def drop_from_recent_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drop_from_recent_max(samples(spark, sf_dir), KEYS).withColumn("drop", r6("drop"))


# Joins and appends -----------------------------------------------------------------------------------------------------------

KN = "k AS (SELECT series_id, source, us, arg_max(value, event_id) AS value FROM s WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT * FROM s WHERE event_id % 2 = 1)"
NEAR = """bef AS (SELECT n.series_id, n.source, n.event_id, n.us, k.us AS bu, k.value AS bv FROM n ASOF LEFT JOIN k ON n.series_id = k.series_id AND n.source = k.source AND n.us >= k.us),
aft AS (SELECT bef.*, k.us AS au, k.value AS av FROM bef ASOF LEFT JOIN k ON bef.series_id = k.series_id AND bef.source = k.source AND bef.us <= k.us),
nr AS (SELECT series_id, source, event_id, us, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bu ELSE au END AS nu, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bv ELSE av END AS nv FROM aft)"""
TOL = f"""d AS (SELECT series_id, source, us FROM s WHERE event_id % 2 = 0), {STRIDE},
lim AS (SELECT d.series_id, d.source, min(us) AS lo, max(us) AS hi, any_value(med) AS med FROM d LEFT JOIN st USING (series_id, source) GROUP BY ALL),
tol AS (SELECT *, coalesce(least(greatest(3 * med, {Q}), {6 * HOUR}), {HOUR}) AS t FROM lim)"""


@query(f"WITH {S}, {KN}, {NEAR}, {TOL} SELECT series_id, source, event_id, make_timestamp(nu) AS near_ts, nv AS near_value FROM nr JOIN tol USING (series_id, source) WHERE abs(us - nu) <= t AND us >= lo - coalesce(med / 2, t) AND us <= hi + coalesce(med / 2, t)")
def nearest_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = known_and_new(samples(spark, sf_dir))
    return joins.nearest_within(new, known, KEYS)


@query(f"WITH {S}, {B}, o AS (SELECT series_id, source, b_us, arg_max(value, (us, event_id)) AS known_value FROM b WHERE event_id % 2 = 0 GROUP BY ALL), w AS (SELECT series_id, source, b_us, arg_max(value, (us, event_id)) AS new_value FROM b WHERE event_id % 2 = 1 GROUP BY ALL) SELECT series_id, source, make_timestamp(b_us) AS bucket, known_value, new_value FROM o JOIN w USING (series_id, source, b_us) WHERE abs(new_value - known_value) > 1.0")
def append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.append_conflicts(*known_and_new(samples(spark, sf_dir)), KEYS)


@query(f"WITH {S}, {B}, o AS (SELECT DISTINCT series_id, source, b_us, 1 AS old FROM b WHERE event_id % 2 = 0), w AS (SELECT DISTINCT series_id, source, b_us FROM b WHERE event_id % 2 = 1) SELECT series_id, source, count(*) FILTER (old IS NULL) AS added, count(old) AS updated FROM w LEFT JOIN o USING (series_id, source, b_us) GROUP BY ALL")
def append_added_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.append_counts(*known_and_new(samples(spark, sf_dir)), KEYS)


MODE = f"""{S}, {KN}, {NEAR}, {TOL},
dl AS (SELECT nr.series_id, nr.source, s.value - nv AS delta FROM nr JOIN tol USING (series_id, source) JOIN s USING (event_id) WHERE abs(nr.us - nu) <= t AND nr.us >= lo - coalesce(med / 2, t) AND nr.us <= hi + coalesce(med / 2, t)),
sp AS (SELECT series_id, source, count(*) AS n_pairs, min(delta) AS lo, max(delta) AS hi, median(delta) AS mid FROM dl GROUP BY ALL),
bins AS (SELECT dl.series_id, dl.source, delta, n_pairs, lo, hi, mid, floor((delta - lo + 0.2) / 0.2) AS bin FROM dl JOIN sp USING (series_id, source)),
top AS (SELECT series_id, source, arg_max(bin, (n, -bin)) AS top FROM (SELECT series_id, source, bin, count(*) AS n FROM bins GROUP BY ALL) GROUP BY ALL),
ce AS (SELECT *, lo - 0.2 + (top + 0.5) * 0.2 AS centre FROM bins JOIN top USING (series_id, source)),
md AS (SELECT series_id, source, n_pairs, lo, hi, mid, centre, median(CASE WHEN abs(delta - centre) <= 0.2 THEN delta END) AS nm, count(CASE WHEN abs(delta - centre) <= 0.2 THEN delta END) AS nn FROM ce GROUP BY ALL),
off AS (SELECT series_id, source, n_pairs, CASE WHEN n_pairs < 5 OR hi - lo < 0.5 THEN mid WHEN nn >= 3 THEN nm ELSE centre END AS shift FROM md),
al AS (SELECT n.series_id, n.source, n.event_id, n.us, n.value - coalesce(shift, 0) AS value FROM n LEFT JOIN off USING (series_id, source)),
ub AS (SELECT *, {sql_round('us')} AS b_us FROM (SELECT series_id, source, event_id, us, value, 0 AS is_new FROM s WHERE event_id % 2 = 0 UNION ALL SELECT series_id, source, event_id, us, value, 1 FROM al))"""


@query(f"WITH {MODE} SELECT series_id, source, make_timestamp(b_us) AS bucket, make_timestamp(arg_max(us, (us, is_new, event_id))) AS ts, round(arg_max(value, (us, is_new, event_id)), 6) AS value, arg_max(is_new, (us, is_new, event_id)) AS is_new FROM ub GROUP BY series_id, source, b_us")
def append_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.append(*known_and_new(samples(spark, sf_dir)), KEYS).withColumn("value", r6("value"))


@query(
    f"""WITH {MODE}, o AS (SELECT series_id, source, b_us, arg_max(value, (us, event_id)) AS kv FROM ub WHERE is_new = 0 GROUP BY ALL), w AS (SELECT series_id, source, b_us, arg_max(value, (us, event_id)) AS nv FROM ub WHERE is_new = 1 GROUP BY ALL),
r AS (SELECT series_id, source, count(*) FILTER (kv IS NULL) AS added, count(kv) AS updated, count(*) FILTER (abs(nv - kv) > 1.0) AS conflicts FROM w LEFT JOIN o USING (series_id, source, b_us) GROUP BY ALL)
SELECT series_id, source, added, updated, conflicts, round(coalesce(shift, 0), 6) AS "offset", coalesce(n_pairs, 0) AS n_pairs,
  concat_ws('; ', CASE WHEN n_pairs IS NULL THEN 'no overlap: appended as it is' END, CASE WHEN n_pairs < 3 THEN 'few overlapping rows' END, CASE WHEN abs(shift) >= 5.0 THEN 'large offset' END) AS warnings FROM r LEFT JOIN off USING (series_id, source)"""
)
def append_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = archive.append_report(*known_and_new(samples(spark, sf_dir)), KEYS)
    return report.withColumns({"offset": r6("offset"), "warnings": F.array_join("warnings", "; ")})


@query(f"WITH {S}, {B}, a AS (SELECT series_id, b_us, arg_max(ts, (us, event_id)) AS ts, arg_max(value, (us, event_id)) AS value FROM b WHERE source = 'error' GROUP BY ALL) SELECT series_id, make_timestamp(b_us) AS bucket, ts, value FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source <> 'error' AND b.series_id = a.series_id AND b.b_us = a.b_us)")
def archive_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, old = live_and_archive(samples(spark, sf_dir))
    merged = windows.keep_last(archive.bucketed(live).select("series_id", "bucket", "ts", "event_id", "value"), ["series_id", "bucket"], F.col("ts"), F.col("event_id"))
    return reconcile.fill_from_archive(merged, old, SERIES).filter("NOT live").drop("live")


@query(f"WITH {S}, {B}, c AS (SELECT * FROM b WHERE source = 'click'), q AS (SELECT series_id, b_us, count(DISTINCT source) AS n_sources FROM b WHERE source <> 'error' GROUP BY ALL), k AS (SELECT series_id, us, arg_max(value, event_id) AS value FROM s WHERE source = 'error' GROUP BY ALL), bef AS (SELECT c.*, k.us AS bu, k.value AS bv FROM c ASOF LEFT JOIN k ON c.series_id = k.series_id AND c.us >= k.us), aft AS (SELECT bef.*, k.us AS au, k.value AS av FROM bef ASOF LEFT JOIN k ON bef.series_id = k.series_id AND bef.us <= k.us), nr AS (SELECT *, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bu ELSE au END AS nu, CASE WHEN bu IS NOT NULL AND (au IS NULL OR us - bu <= au - us) THEN bv ELSE av END AS nv FROM aft) SELECT event_id, n_sources, coalesce(abs(us - nu) <= {Q * 2} AND abs(value - nv) <= 3.0, FALSE) AS continues FROM nr JOIN q USING (series_id, b_us) WHERE n_sources >= 2 OR (abs(us - nu) <= {Q * 2} AND abs(value - nv) <= 3.0)")
def quorum_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, old = live_and_archive(samples(spark, sf_dir))
    return archive.quorum(live.filter("source = 'click'"), live, old, SERIES).select("event_id", "n_sources", "continues")


# The merge ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S}, {DENSE} SELECT series_id, source, make_timestamp(g) AS bucket, round(value, 6) AS value FROM dense")
def densify_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.densify(samples(spark, sf_dir), KEYS).select(*KEYS, from_micros(F.col("bucket_us")).alias("bucket"), r6("value").alias("value"))


@query(f"WITH {TAGGED} SELECT series_id, make_timestamp(b_us) AS bucket, make_timestamp(us) AS ts, round(value, 6) AS value, winner, k AS n_sources FROM merged")
def merge_best_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.merge(samples(spark, sf_dir), SERIES, SOURCES).withColumn("value", r6("value"))


@query(f"WITH {TAGGED} SELECT series_id, winner, count(*) AS buckets, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM merged GROUP BY series_id, winner")
def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.winner_counts(reconcile.merge(samples(spark, sf_dir), SERIES, SOURCES), SERIES).withColumn("share", r6("share"))


@query(f"WITH {TAGGED}, t AS (SELECT *, lag(k >= 2) OVER (PARTITION BY series_id ORDER BY us, b_us) AS was FROM merged) SELECT series_id, make_timestamp(b_us) AS bucket, k >= 2 AS several FROM t WHERE was <> (k >= 2)")
def handoff_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    several = F.col("n_sources") >= 2
    w = Window.partitionBy("series_id").orderBy("ts", "bucket")
    marked = reconcile.merge(samples(spark, sf_dir), SERIES, SOURCES).withColumns({"several": several, "was": F.lag(several).over(w)})
    return marked.filter(F.col("was") != F.col("several")).select("series_id", "bucket", "several")


def blended_sql(merged: str) -> str:
    """CTEs from ``merged`` (series_id, b_us, us, value, k, ...) to ``blended``: one step of the recursion spreads a flip of each series."""
    return f"""base AS (SELECT *, k >= 2 AS several, row_number() OVER (PARTITION BY series_id ORDER BY us, b_us) AS j, us / 3.6e9 AS h FROM {merged}),
flips AS (SELECT series_id, j AS at, row_number() OVER (PARTITION BY series_id ORDER BY j) AS i FROM (SELECT *, lag(several) OVER (PARTITION BY series_id ORDER BY j) AS was FROM base) WHERE was <> several),
fold AS (SELECT series_id, j, h, several, value AS v, 0::BIGINT AS i FROM base
  UNION ALL SELECT series_id, j, h, several, v + CASE WHEN abs(step) > 4.0 AND abs(h - fh) <= 6.0 THEN CASE WHEN several THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END * step * greatest(1.0 - abs(h - fh) / 6.0, 0.0::DOUBLE) ELSE 0.0::DOUBLE END, i
  FROM (SELECT series_id, j, h, several, v, i, fh, CASE WHEN before_many THEN v_at - v_before ELSE v_before - v_at END AS step FROM (
    SELECT w.series_id, w.j, w.h, w.several, w.v, f.i, max(CASE WHEN w.j = f.at THEN w.h END) OVER p AS fh, max(CASE WHEN w.j = f.at THEN w.v END) OVER p AS v_at, max(CASE WHEN w.j = f.at - 1 THEN w.v END) OVER p AS v_before, bool_or(w.j = f.at - 1 AND w.several) OVER p AS before_many
    FROM fold w JOIN flips f ON f.series_id = w.series_id AND f.i = w.i + 1 WINDOW p AS (PARTITION BY w.series_id)))),
blended AS (SELECT b.* REPLACE (f.v AS value) FROM fold f JOIN base b USING (series_id, j) WHERE f.i = (SELECT coalesce(max(x.i), 0) FROM flips x WHERE x.series_id = f.series_id))"""


@query(f"WITH RECURSIVE {TAGGED}, {blended_sql('merged')} SELECT series_id, make_timestamp(b_us) AS bucket, make_timestamp(us) AS ts, round(value, 4) AS value, winner, k AS n_sources FROM blended")
def blended_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.blend_handoffs(reconcile.merge(samples(spark, sf_dir), SERIES, SOURCES), SERIES).withColumn("value", F.round("value", 4))


def offsets_sql(rows: str) -> str:
    """A subquery: series_id, source, b of each source of ``rows`` that is tied to the anchor."""
    return f"""WITH RECURSIVE {PAIRS.replace(S, f"s AS (SELECT * FROM {rows})", 1)}, links AS (SELECT series_id, source_i AS a, source_j AS b, beta AS d FROM fit UNION ALL SELECT series_id, source_j, source_i, -beta FROM fit),
pin AS (SELECT series_id, CASE WHEN bool_or(source = 'purchase') THEN 'purchase' ELSE min(source) END AS source FROM s GROUP BY ALL),
reach AS (SELECT series_id, source FROM pin UNION SELECT r.series_id, l.b FROM reach r JOIN links l ON l.series_id = r.series_id AND l.a = r.source),
free AS (SELECT r.series_id, r.source FROM reach r JOIN pin USING (series_id) WHERE r.source <> pin.source),
sweep(k, series_id, source, b) AS (SELECT 0, series_id, source, 0.0::DOUBLE FROM reach
  UNION ALL SELECT * FROM (SELECT w.k + 1, w.series_id, l.a, CASE WHEN any_value(f.source) IS NULL THEN 0.0 ELSE avg(w.b + l.d) END FROM sweep w JOIN links l ON l.series_id = w.series_id AND l.b = w.source LEFT JOIN free f ON f.series_id = l.series_id AND f.source = l.a WHERE w.k < 400 GROUP BY w.k, w.series_id, l.a))
SELECT series_id, source, b FROM sweep WHERE k = 400"""


CORRECTED = f"""{S.replace("s AS", "s_all AS", 1)}, s_live AS (SELECT * FROM s_all WHERE source <> 'error'), off AS ({offsets_sql('s_live')}),
s AS (SELECT event_id, series_id, source, ts, value - coalesce(off.b, 0.0) AS value, us FROM s_live LEFT JOIN off USING (series_id, source))"""


@query(
    f"""WITH RECURSIVE {TAGGED.replace(S, CORRECTED, 1)}, {blended_sql('merged')},
old AS (SELECT series_id, {sql_round('us')} AS b_us, arg_max(us, (us, event_id)) AS us, arg_max(value, (us, event_id)) AS value FROM s_all WHERE source = 'error' GROUP BY ALL)
SELECT series_id, make_timestamp(b_us) AS bucket, make_timestamp(us) AS ts, round(value, 4) AS value, TRUE AS live FROM blended
UNION ALL SELECT series_id, make_timestamp(b_us), make_timestamp(us), round(value, 4), FALSE FROM old WHERE NOT EXISTS (SELECT 1 FROM blended b WHERE b.series_id = old.series_id AND b.b_us = old.b_us)"""
)
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole merge: offsets, correction, grid, winners, softened handoffs, archive gaps."""
    live, old = live_and_archive(samples(spark, sf_dir))
    offsets = reconcile.solve_offsets(live, reconcile.pairwise_offsets(live, SERIES), SERIES, SOURCES)
    merged = reconcile.blend_handoffs(reconcile.merge(reconcile.apply_offsets(live, offsets, SERIES), SERIES, SOURCES), SERIES)
    return reconcile.fill_from_archive(merged, old, SERIES).withColumn("value", F.round("value", 4))


@query(f"WITH {S}, {B}, {LAST}, c AS (SELECT series_id, b_us, median(value) AS med, count(*) AS k FROM last GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT last.series_id, b_us, source, value, med, abs(value - med) AS delta FROM last JOIN c USING (series_id, b_us)), m AS (SELECT series_id, b_us, median(delta) AS mad FROM o GROUP BY ALL) SELECT series_id, make_timestamp(b_us) AS bucket, source, value, round(med, 6) AS bucket_median, round(delta, 6) AS delta FROM o JOIN m USING (series_id, b_us) WHERE delta > greatest(5.0, 3.0 * 1.4826 * mad)")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.outlier_audit(samples(spark, sf_dir), SERIES).withColumns({"bucket_median": r6("bucket_median"), "delta": r6("delta")})


@query(f"WITH {S}, {B}, {LAST} SELECT series_id, make_timestamp(b_us) AS bucket, max(value) FILTER (source = 'click') AS click, max(value) FILTER (source = 'error') AS error, max(value) FILTER (source = 'purchase') AS purchase, max(value) FILTER (source = 'signup') AS signup, max(value) FILTER (source = 'view') AS view, string_agg(source, ',' ORDER BY source) FILTER (value > 20) AS flagged FROM last GROUP BY series_id, b_us")
def sources_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = windows.keep_last(archive.bucketed(samples(spark, sf_dir)).select(*KEYS, "bucket", "ts", "event_id", "value"), [*KEYS, "bucket"], F.col("ts"), F.col("event_id"))
    wide = last.groupBy("series_id", "bucket").pivot("source", ["click", "error", "purchase", "signup", "view"]).agg(F.max("value"))
    flags = last.groupBy("series_id", "bucket").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("value") > 20, F.col("source")))), ",").alias("flagged"))
    return wide.join(flags, ["series_id", "bucket"]).withColumn("flagged", F.nullif("flagged", F.lit("")))


# Peaks and episodes --------------------------------------------------------------------------------------------------------------


@query(f"WITH {hourly_sql(HOUR)} SELECT series_id, make_timestamp(us) AS ts, round(value, 9) AS value, filled FROM h")
def hourly_regularise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.hourly(samples(spark, sf_dir), SERIES).withColumn("value", r9("value"))


@query(f"WITH {TOPS} SELECT series_id, make_timestamp(us) AS ts, round(value, 9) AS value FROM tops")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_day_peaks(samples(spark, sf_dir)).withColumn("value", r9("value"))


@query(f"""WITH {hourly_sql(HOUR)}, t AS (SELECT *, lag(value) OVER w AS lv, lead(value) OVER w AS nv FROM h WINDOW w AS (PARTITION BY series_id ORDER BY us)),
tops AS (SELECT series_id, us, value FROM t WHERE value > lv AND value > nv),
walls AS (SELECT p.series_id, p.us, any_value(p.value) AS value, coalesce(max(h.us) FILTER (h.us < p.us), 0) AS lw, coalesce(min(h.us) FILTER (h.us > p.us), 9e18::BIGINT) AS rw FROM tops p LEFT JOIN h ON h.series_id = p.series_id AND h.value > p.value GROUP BY ALL),
pr AS (SELECT w.series_id, w.us, any_value(w.value) AS value, any_value(w.value) - greatest(min(h.value) FILTER (h.us <= w.us), min(h.value) FILTER (h.us >= w.us)) AS prominence FROM walls w JOIN h ON h.series_id = w.series_id AND h.us BETWEEN w.lw AND w.rw GROUP BY w.series_id, w.us)
SELECT series_id, make_timestamp(us) AS ts, round(value, 9) AS value, round(prominence, 9) AS prominence FROM pr WHERE prominence >= 4.0""")
def peak_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours above both of their neighbours, however near each other; two hours of one mean are none, as in the SQL."""
    found = peaks.detect_peaks(samples(spark, sf_dir), SERIES, Params(distance_days=0.0), flat=False)
    return found.withColumns({"value": r9("value"), "prominence": r9("prominence")})


@query(f"""WITH RECURSIVE {hourly_sql(HOUR)}, n AS (SELECT series_id, us, value, row_number() OVER w AS i, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS c FROM h WINDOW w AS (PARTITION BY series_id ORDER BY us)),
flat AS (SELECT series_id, run, any_value(value) AS value, min(i) AS a, max(i) AS b FROM (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY i) AS run FROM n) GROUP BY series_id, run),
top AS (SELECT series_id, (a + b) // 2 AS i, value FROM (SELECT *, lag(value) OVER w AS lv, lead(value) OVER w AS nv FROM flat WINDOW w AS (PARTITION BY series_id ORDER BY run)) WHERE value > lv AND value > nv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, i DESC) AS k FROM top),
keep(series_id, k, kept) AS (SELECT series_id, k, [i] FROM ranked WHERE k = 1
  UNION ALL SELECT r.series_id, r.k, CASE WHEN len([x FOR x IN kept IF abs(x - r.i) < 120]) = 0 THEN list_append(kept, r.i) ELSE kept END FROM keep JOIN ranked r ON r.series_id = keep.series_id AND r.k = keep.k + 1),
apart AS (SELECT series_id, unnest(kept) AS i FROM keep WHERE k = (SELECT max(r.k) FROM ranked r WHERE r.series_id = keep.series_id)),
p AS (SELECT n.series_id, n.us, n.value FROM apart JOIN n USING (series_id, i)),
walls AS (SELECT p.series_id, p.us, any_value(p.value) AS value, coalesce(max(h.us) FILTER (h.us < p.us), 0) AS lw, coalesce(min(h.us) FILTER (h.us > p.us), 9e18::BIGINT) AS rw FROM p LEFT JOIN h ON h.series_id = p.series_id AND h.value > p.value GROUP BY ALL),
pr AS (SELECT w.series_id, w.us, any_value(w.value) AS value, any_value(w.value) - greatest(min(h.value) FILTER (h.us <= w.us), min(h.value) FILTER (h.us >= w.us)) AS prominence FROM walls w JOIN h ON h.series_id = w.series_id AND h.us BETWEEN w.lw AND w.rw GROUP BY w.series_id, w.us)
SELECT series_id, make_timestamp(us) AS ts, round(value, 6) AS value, round(prominence, 6) AS prominence FROM pr WHERE prominence >= 4.0""")
def peaks_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.detect_peaks(samples(spark, sf_dir), SERIES).withColumns({"value": r6("value"), "prominence": r6("prominence")})


@query(f"WITH {EPISODES} SELECT series_id, make_timestamp(prev) AS prev_ts, make_timestamp(cur) AS end_ts, make_timestamp(t_us) AS trough_ts, t_v AS trough_value, n_rows, CAST(place AS INTEGER) AS place FROM epi")
def episode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return peaks.episodes(s, half_day_peaks(s), SERIES)


@query(f"WITH {TOPS}, {TROUGH} SELECT series_id, make_timestamp(p_us) AS peak_ts, make_timestamp(t_us) AS trough_ts, t_v AS trough_value FROM tr")
def current_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return peaks.current_trough(s, half_day_peaks(s), SERIES)


@query(f"WITH {EPISODES}, {TROUGH}, past AS (SELECT series_id, median((cur - t_us) / 3.6e9) AS median_h, count(*) AS n FROM epi WHERE place <= 6 GROUP BY ALL HAVING count(*) >= 4), now AS (SELECT series_id, max(us) AS now FROM s GROUP BY ALL) SELECT series_id, round(greatest((now - t_us) / 3.6e9, 0), 6) AS elapsed_h, round(median_h, 6) AS median_h, round(greatest((now - t_us) / 3.6e9, 0) / nullif(median_h, 0), 6) AS fraction, n AS n_episodes, greatest((now - t_us) / 3.6e9, 0) / nullif(median_h, 0) >= 0.5 AS late FROM now JOIN tr USING (series_id) JOIN past USING (series_id)")
def phase_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    tops = half_day_peaks(s)
    out = state.phase(s, peaks.current_trough(s, tops, SERIES), peaks.episodes(s, tops, SERIES), SERIES)
    return out.withColumns({c: r6(c) for c in ("elapsed_h", "median_h", "fraction")})


INTERVAL = "gap AS (SELECT series_id, us, us - lag(us) OVER (PARTITION BY series_id ORDER BY us) AS g FROM tops), iv AS (SELECT series_id, max(us) AS l, count(*) AS n_peaks, count(g) AS ng, median(g) AS m, quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.75) AS q3 FROM gap GROUP BY ALL HAVING count(*) >= 2), fc AS (SELECT series_id, floor(l + m + 0.5)::BIGINT AS next_us, CASE WHEN ng >= 3 THEN floor(l + q1 + 0.5)::BIGINT END AS low_us, CASE WHEN ng >= 3 THEN floor(l + q3 + 0.5)::BIGINT END AS high_us, n_peaks FROM iv)"


@query(f"WITH {TOPS}, {INTERVAL} SELECT series_id, make_timestamp(next_us) AS next_ts, make_timestamp(low_us) AS band_low, make_timestamp(high_us) AS band_high, n_peaks FROM fc")
def interval_median_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.interval_forecast(half_day_peaks(samples(spark, sf_dir)), SERIES)
    return out.select("series_id", *[from_micros(F.col(a)).alias(b) for a, b in (("next_us", "next_ts"), ("low_us", "band_low"), ("high_us", "band_high"))], "n_peaks")


def _slope_sql(name: str, hours: float) -> str:
    return f"{name} AS (SELECT series_id, CASE WHEN count(*) >= 3 AND count(DISTINCT us) >= 2 THEN regr_slope(value, (us - mx) / 3.6e9) END AS sl FROM mx WHERE us >= mx - {int(hours * HOUR)} GROUP BY ALL)"


@query(f"""WITH {TOPS}, {INTERVAL}, mx AS (SELECT *, max(us) OVER (PARTITION BY series_id) AS mx FROM s), {_slope_sql('s3', 3)}, {_slope_sql('sh', 0.5)}, {_slope_sql('s6', 6)},
dr AS (SELECT series_id, max(value) - arg_max(value, (us, event_id)) AS dropped FROM mx WHERE us >= mx - {24 * HOUR} GROUP BY ALL),
f AS (SELECT series_id, s3.sl AS a, sh.sl AS b, s6.sl AS c, dropped, coalesce(low_us, next_us - {2 * DAY}) AS lo, coalesce(high_us, next_us + {2 * DAY}) AS hi FROM dr LEFT JOIN s3 USING (series_id) LEFT JOIN sh USING (series_id) LEFT JOIN s6 USING (series_id) LEFT JOIN fc USING (series_id))
SELECT series_id, round(a, 6) AS slope_3h, round(b, 6) AS slope_half_h, round(c, 6) AS slope_6h, round(dropped, 6) AS "drop", CASE WHEN a < -0.5 AND dropped > 2 THEN 'active' WHEN b < -0.15 AND c - b > 0.1 THEN 'starting' WHEN lo IS NULL OR 1706745600000000 < lo THEN 'calm' WHEN 1706745600000000 <= hi THEN 'imminent' ELSE 'overdue' END AS state FROM f""")
def state_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = state.classify(s, state.interval_forecast(half_day_peaks(s), SERIES), SERIES, now)
    return out.withColumns({c: r6(c) for c in ("slope_3h", "slope_half_h", "slope_6h", "drop")})


@query(f"WITH {TOPS}, f AS (SELECT s.series_id, regr_slope(s.value, (s.us - 1704067200000000) / 8.64e10) AS m1, regr_intercept(s.value, (s.us - 1704067200000000) / 8.64e10) AS b1 FROM s GROUP BY ALL), t AS (SELECT series_id, regr_slope(value, (us - 1704067200000000) / 8.64e10) AS m2, regr_intercept(value, (us - 1704067200000000) / 8.64e10) AS b2 FROM tops GROUP BY ALL) SELECT series_id, round(CASE WHEN abs(m1 - m2) >= 1e-12 AND (b2 - b1) / (m1 - m2) BETWEEN -1000 AND 1000 AND abs(m2 * (b2 - b1) / (m1 - m2) + b2) < 50 THEN (b2 - b1) / (m1 - m2) END, 3) AS crossing_day FROM f JOIN t USING (series_id)")
def line_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    day = (micros("ts") - 1704067200000000) / float(DAY)
    line = lambda f, k: f.withColumn("day", day).groupBy("series_id").agg(F.regr_slope("value", "day").alias(f"m{k}"), F.regr_intercept("value", "day").alias(f"b{k}"))
    both = line(s, 1).join(line(half_day_peaks(s), 2), "series_id")
    hit = state.crossing(F.col("m1"), F.col("b1"), F.col("m2"), F.col("b2"), F.lit(-1000.0), F.lit(1000.0))
    return both.select("series_id", F.round(hit, 3).alias("crossing_day"))


@query()
def all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered model on the recent peaks of each series."""
    s = samples(spark, sf_dir)
    return forecast.forecast(s, half_day_peaks(s), SERIES, recent_peaks=6).withColumn("value", F.round("value", 3))


def huber_sql(points: str, rounds: int = 150) -> str:
    """CTEs from ``points`` (series_id, fit, part, x, y) to ``fits``: the line of each (series_id, fit, part), by reweighting at a fixed scale."""
    g, by = "series_id, fit, part", "PARTITION BY series_id, fit, part"
    return f"""pt AS (SELECT series_id, fit, part, x - mid AS x, y, mid FROM (SELECT *, avg(x) OVER ({by}) AS mid, count(*) OVER ({by}) AS n FROM {points}) WHERE n >= 2),
f0 AS (SELECT {g}, any_value(mid) AS mid, regr_slope(y, x) AS m, avg(y) AS b FROM pt GROUP BY ALL),
r0 AS (SELECT {g}, y - m * x - b AS r FROM pt JOIN f0 USING ({g})),
r1 AS (SELECT {g}, median(r) AS med FROM r0 GROUP BY ALL),
sc AS (SELECT {g}, greatest(1.345 * median(abs(r - med)) / 0.6745, 1e-6) AS f FROM r0 JOIN r1 USING ({g}) GROUP BY ALL),
it(k, series_id, fit, part, m, b) AS (SELECT 0, {g}, m, b FROM f0
  UNION ALL SELECT k, {g}, m, (swy - m * swx) / sw FROM (SELECT k + 1 AS k, {g}, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS m
    FROM (SELECT k, series_id, fit, part, x, y, least(1.0, f / greatest(abs(y - (m * x + b)), 1e-300)) AS w FROM it JOIN pt USING ({g}) JOIN sc USING ({g}) WHERE k < {rounds}) GROUP BY k, {g})),
fits AS (SELECT {g}, it.m AS slope, it.b AS level, mid AS middle FROM it JOIN f0 USING ({g}) WHERE k = {rounds})"""


TOPS_6 = TOPS.replace("tops AS (", "every_top AS (", 1) + ", tops AS (SELECT series_id, us, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY us DESC) AS back FROM every_top) WHERE back <= 6)"
D = "8.64e10"
#: Events have no build-ups; their times make ramps of so many hours, their values the noise on them.
RAMP = 60 * HOUR
S_RAMP = S.replace("ts, value, epoch_us(ts) AS us", f"ts, 10.0::DOUBLE * (epoch_us(ts) % {RAMP})::DOUBLE / {RAMP}.0::DOUBLE + value / 50.0::DOUBLE AS value, epoch_us(ts) AS us")


def ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("value", 10.0 * F.pmod(micros("ts"), F.lit(RAMP)).cast("double") / float(RAMP) + F.col("value") / 50.0)


@query(
    f"""WITH RECURSIVE {EPISODES.replace(TOPS, TOPS_6, 1).replace(S, S_RAMP, 1)}, {TROUGH}, ends AS (SELECT series_id, max(us) AS last_us FROM s GROUP BY ALL), lp AS (SELECT series_id, max(us) AS lp_us, count(*) AS n_peaks FROM tops GROUP BY ALL),
rise AS (SELECT *, count(*) OVER w AS n, sum((us >= last_us - {168 * HOUR})::INT) OVER w AS recent, row_number() OVER (PARTITION BY series_id ORDER BY us DESC, event_id DESC) AS back FROM s JOIN tr USING (series_id) JOIN ends USING (series_id) WHERE us >= t_us WINDOW w AS (PARTITION BY series_id)),
used AS (SELECT * FROM epi WHERE place <= 6), erow AS (SELECT r.*, u.t_us, u.t_v FROM rows_in r JOIN used u USING (series_id, prev, cur) WHERE r.us >= u.t_us),
points AS (SELECT series_id, 'trend' AS fit, '' AS part, us / {D} AS x, value AS y FROM tops UNION ALL SELECT series_id, 'linear_naive', '', us / {D}, value FROM rise WHERE n >= 12
  UNION ALL SELECT series_id, 'linear', '', us / {D}, value FROM rise WHERE n >= 12 AND least(ceil(n * 0.5), recent) >= 12 AND back <= least(ceil(n * 0.5), recent)
  UNION ALL SELECT series_id, 'episode', cur::VARCHAR, us / {D}, value FROM erow UNION ALL SELECT series_id, 'stitched', '', us / {D} - t_us / {D}, value - t_v FROM erow),
{huber_sql('points')},
past AS (SELECT series_id, median((cur - t_us) / 3.6e9) AS median_h, count(*) AS n_ep FROM used GROUP BY ALL HAVING count(*) >= 4),
ph AS (SELECT series_id, greatest((last_us - t_us) / 3.6e9, 0) / nullif(median_h, 0) >= 0.5 AS late FROM ends JOIN tr USING (series_id) JOIN past USING (series_id)),
own AS (SELECT series_id, fit AS model_id, slope, middle, level, greatest(last_us / {D}, lp_us / {D}) AS since FROM fits JOIN ends USING (series_id) JOIN lp USING (series_id) WHERE fit IN ('linear', 'linear_naive')),
anch AS (SELECT series_id, median(slope) AS slope, count(*) AS n_ep FROM fits WHERE fit = 'episode' GROUP BY ALL HAVING count(*) >= 4),
lines AS (SELECT * FROM own UNION ALL SELECT series_id, 'auto', slope, middle, level, since FROM own LEFT JOIN ph USING (series_id) WHERE model_id = CASE WHEN late THEN 'linear_naive' ELSE 'linear' END
  UNION ALL SELECT series_id, 'linear_hist', slope, t_us / {D}, t_v, greatest(t_us, lp_us) / {D} FROM anch JOIN tr USING (series_id) JOIN lp USING (series_id)
  UNION ALL SELECT series_id, 'linear_stitched', f.slope, t_us / {D}, t_v, greatest(t_us, lp_us) / {D} FROM anch JOIN tr USING (series_id) JOIN lp USING (series_id) JOIN fits f USING (series_id) WHERE f.fit = 'stitched'),
x AS (SELECT l.series_id, model_id, since, l.slope AS m1, l.level + l.slope * (since - l.middle) AS b1, t.slope AS m2, t.level + t.slope * (since - t.middle) AS b2 FROM lines l JOIN fits t ON t.series_id = l.series_id AND t.fit = 'trend' JOIN lp ON lp.series_id = l.series_id WHERE n_peaks >= 2),
hit AS (SELECT series_id, model_id, since + root AS day, m2 * root + b2 AS value FROM (SELECT *, (b2 - b1) / CASE WHEN abs(m1 - m2) >= 1e-12 THEN m1 - m2 END AS root FROM x) WHERE root BETWEEN 0 AND 90 AND abs(m2 * root + b2) < 50)
SELECT series_id, model_id, round(day, 3) AS next_day, round(value, 3) AS value FROM (SELECT DISTINCT series_id FROM s) CROSS JOIN (VALUES ('auto'), ('linear'), ('linear_naive'), ('linear_hist'), ('linear_stitched')) m(model_id) LEFT JOIN hit USING (series_id, model_id)"""
)
def line_model_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five models of lines, from mergeable sums, on the recent peaks of each series."""
    s = ramps(spark, sf_dir)
    out = line_fits.line_forecasts(s, half_day_peaks(s), SERIES, recent_peaks=6)
    return out.select("series_id", "model_id", F.round(micros("next_ts") / float(DAY), 3).alias("next_day"), F.round("value", 3).alias("value"))


@query(
    f"""WITH RECURSIVE {TOPS_6.replace(S, S_RAMP, 1)}, {TROUGH}, ends AS (SELECT series_id, greatest(max(s.us), any_value(p_us)) / {D} AS since FROM s JOIN lastp USING (series_id) GROUP BY ALL),
trend AS (SELECT series_id, regr_slope(value, us / {D} - since) AS m, regr_intercept(value, us / {D} - since) AS b FROM tops JOIN ends USING (series_id) GROUP BY ALL HAVING count(*) >= 2),
rise AS (SELECT series_id, shape, value, CASE shape WHEN 'root' THEN sqrt(greatest(h, 1e-3)) ELSE 1 - exp(-h / 120.0) END AS f FROM (SELECT s.series_id, s.value, (s.us - t_us) / 3.6e9 AS h FROM s JOIN tr USING (series_id) WHERE us >= t_us), (VALUES ('root'), ('saturating')) v(shape)),
fit AS (SELECT series_id, shape, regr_slope(value, f) AS a, regr_intercept(value, f) AS c FROM rise GROUP BY ALL HAVING count(*) >= 12),
all_of AS (SELECT series_id, shape, a, c, m, b, (since - t_us / {D}) * 24 AS h0 FROM fit JOIN tr USING (series_id) JOIN ends USING (series_id) JOIN trend USING (series_id)),
scan AS (SELECT *, c + a * CASE shape WHEN 'root' THEN sqrt(greatest(h0 + 24.0 * k, 1e-3)) ELSE 1 - exp(-(h0 + 24.0 * k) / 120.0) END - (m * k + b) AS gap FROM all_of, range(91) r(k)),
hits AS (SELECT series_id, shape, min(k) AS k, arg_min(gap, k) AS gap FROM (SELECT *, lead(gap) OVER (PARTITION BY series_id, shape ORDER BY k) AS after FROM scan) WHERE gap = 0 OR gap * after < 0 GROUP BY ALL),
bis(n, series_id, shape, low, high) AS (SELECT 0, series_id, shape, k::DOUBLE, k + 1.0::DOUBLE FROM hits
  UNION ALL SELECT n + 1, series_id, shape, CASE WHEN before THEN mid ELSE low END, CASE WHEN before THEN high ELSE mid END
  FROM (SELECT n, series_id, shape, low, high, mid, (c + a * CASE shape WHEN 'root' THEN sqrt(greatest(h0 + 24.0 * mid, 1e-3)) ELSE 1 - exp(-(h0 + 24.0 * mid) / 120.0) END - (m * mid + b)) * hits.gap > 0 AS before
    FROM (SELECT *, (low + high) / 2 AS mid FROM bis WHERE n < 40) JOIN all_of USING (series_id, shape) JOIN hits USING (series_id, shape))),
met AS (SELECT series_id, shape, day, m * day + b AS value FROM (SELECT series_id, shape, (low + high) / 2 AS day, m, b FROM bis JOIN all_of USING (series_id, shape) WHERE n = 40))
SELECT series_id, shape, round(CASE WHEN abs(value) < 50 THEN day END, 4) AS days_ahead, round(CASE WHEN abs(value) < 50 THEN value END, 4) AS value FROM all_of LEFT JOIN met USING (series_id, shape)"""
)
def curve_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rise since the trough, as a root or a saturating curve of time, meets the trend through the last peaks."""
    s = ramps(spark, sf_dir)
    tops = windows.newest(half_day_peaks(s), SERIES, 6, F.desc("ts"))
    day = lambda c: micros(c) / float(DAY)
    trough = peaks.current_trough(s, tops, SERIES)
    ends = s.groupBy("series_id").agg(F.max("ts").alias("last")).join(tops.groupBy("series_id").agg(F.max("ts").alias("top")), "series_id").select("series_id", F.greatest(day("last"), day("top")).alias("since"))
    after = day("ts") - F.col("since")
    trend = tops.join(ends, "series_id").groupBy("series_id").agg(F.regr_slope(F.col("value"), after).alias("m"), F.regr_intercept(F.col("value"), after).alias("b"), F.count("*").alias("n_tops")).filter("n_tops >= 2")
    hours = F.timestamp_diff("MICROSECOND", "trough_ts", "ts") / float(HOUR)
    rise = s.join(trough.select("series_id", "trough_ts"), "series_id").filter("ts >= trough_ts").withColumn("h", hours)
    shapes = {"root": lambda h: F.sqrt(F.greatest(h, F.lit(1e-3))), "saturating": lambda h: 1 - F.exp(-h / 120.0)}
    out = None
    for shape, f in shapes.items():
        fit = rise.withColumn("f", f(F.col("h"))).groupBy("series_id", "trough_ts").agg(F.regr_slope("value", "f").alias("a"), F.regr_intercept("value", "f").alias("c"), F.count("*").alias("n")).filter("n >= 12")
        both = fit.join(ends, "series_id").join(trend, "series_id").withColumn("h0", (F.col("since") - day("trough_ts")) * 24)
        hit = state.curve_crossing(lambda x, f=f: F.col("c") + F.col("a") * f(F.col("h0") + 24.0 * x), lambda x: F.col("m") * x + F.col("b"), F.lit(0.0))
        rows = both.withColumn("hit", hit).select("series_id", F.lit(shape).alias("shape"), F.round("hit.day", 4).alias("days_ahead"), F.round("hit.value", 4).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def model_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves and trends of all models of the recent peaks with their ribbons."""
    s = samples(spark, sf_dir)
    return forecast.forecast_curves(s, half_day_peaks(s), SERIES, recent_peaks=6).withColumns({c: F.round(c, 3) for c in ("value", "low", "high")})


@query()
def curve_and_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return forecast.both_forecasts(forecast.forecast(s, half_day_peaks(s), SERIES, ["trendline_exp", "interval_median"], recent_peaks=6), SERIES).withColumn("value", F.round("value", 3))


#: Half-day means are tame, so that a lower step is prominent here.
BACK_PARAMS = Params(backtest_prominence=1.0)


def prominent_half_days(s: DataFrame) -> DataFrame:
    """Peaks of the half-day grid with their prominence, however small and near."""
    return peaks.prominent(peaks.hourly(s, SERIES, HALF_DAY), SERIES, Params(distance_days=0.0, prominence=0.0), width=HALF_DAY)


BACK = f"""{TOPS},
walls AS (SELECT p.series_id, p.us, any_value(p.value) AS value, coalesce(max(h.us) FILTER (h.us < p.us), 0) AS lw, coalesce(min(h.us) FILTER (h.us > p.us), 9e18::BIGINT) AS rw FROM tops p LEFT JOIN h ON h.series_id = p.series_id AND h.value > p.value GROUP BY ALL),
ptops AS (SELECT w.series_id, w.us, any_value(w.value) AS value FROM walls w JOIN h ON h.series_id = w.series_id AND h.us BETWEEN w.lw AND w.rw GROUP BY w.series_id, w.us
  HAVING any_value(w.value) - greatest(min(h.value) FILTER (h.us <= w.us), min(h.value) FILTER (h.us >= w.us)) > 1.0),
e AS (SELECT series_id, lag(us) OVER (PARTITION BY series_id ORDER BY us) AS prev, us AS cur FROM ptops),
rows_in AS (SELECT e.series_id, prev, cur, s.us, s.value, s.event_id FROM e JOIN s ON s.series_id = e.series_id AND s.us > prev AND s.us <= cur WHERE prev IS NOT NULL),
seg AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cur DESC) AS place FROM (SELECT series_id, cur, arg_min(us, (value, us, event_id)) AS t_us FROM rows_in GROUP BY series_id, prev, cur HAVING count(*) >= 50)),
task AS (SELECT series_id, cur, f AS fraction FROM seg, (VALUES (0.25), (0.5), (0.75), (1.0)) v(f) WHERE place <= 7),
gaps AS (SELECT t.series_id, t.cur, t.fraction, p.us, p.us - lag(p.us) OVER (PARTITION BY t.series_id, t.cur, t.fraction ORDER BY p.us) AS g FROM task t JOIN ptops p ON p.series_id = t.series_id AND p.us < t.cur),
err AS (SELECT t.series_id, t.cur, t.fraction, (floor(max(us) + median(g) + 0.5) - t.cur) / 3.6e9 AS error_h FROM task t LEFT JOIN gaps USING (series_id, cur, fraction) GROUP BY t.series_id, t.cur, t.fraction)"""


@query(f"WITH {BACK} SELECT CAST(fraction AS DOUBLE) AS fraction, count(error_h) AS n_scored, count(*) AS n_tasks, round(median(abs(error_h)), 4) AS median_abs, round(avg(error_h), 4) AS mean_signed FROM err GROUP BY fraction")
def backtest_interval_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    tops = prominent_half_days(s)
    errors = forecast.backtest(s, tops, peaks.backtest_segments(s, tops, SERIES, BACK_PARAMS), SERIES, ["interval_median"], BACK_PARAMS)
    return forecast.backtest_stats(errors).select("fraction", "n_scored", "n_tasks", F.round("median_abs", 4).alias("median_abs"), F.round("mean_signed", 4).alias("mean_signed"))


@query()
def best_model_per_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    tops = prominent_half_days(s)
    # Errors read point forecasts only, which no model takes from the draws of its band.
    no_bands = replace(BACK_PARAMS, draws=0)
    errors = forecast.backtest(s, tops, peaks.backtest_segments(s, tops, SERIES, no_bands), SERIES, p=no_bands)
    return forecast.best_models(forecast.backtest_stats(errors)).select("fraction", "model_id", "n_scored", F.round("median_abs", 3).alias("median_abs"))


# Text and JSON ---------------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n, upper(event_type) AS kind FROM events GROUP BY ALL")
def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by a number in their JSON; the normalisers of alerts and states are in source_queries."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.pmod(text.json_number(F.col("props"), "$.k").cast("int"), F.lit(10)).alias("k"), F.upper("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'token') THEN 1 WHEN contains(lower(text), 'quell') AND lang IN ('es', 'fr') THEN 2 WHEN source IN ('src1', 'src2') AND lang IN ('es', 'fr') THEN 3 END AS tier FROM documents")
def relevance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tier = text.relevance(F.col("text"), F.array("lang"), F.col("source"), ["license", "token"], ["quell"], ["es", "fr"], ["src1", "src2"])
    return docs.select("doc_id", tier.alias("tier"))


@query("SELECT event_id, ts - INTERVAL 10 HOUR AS local_ts, date_trunc('second', ts) AS parsed FROM events")
def lenient_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    local = F.col("ts") - F.expr("INTERVAL 10 HOURS")
    return events.select("event_id", local.alias("local_ts"), text.lenient_timestamp(F.date_format(local, "yyyy-MM-dd HH:mm:ss")).alias("parsed"))


@query("SELECT event_id, CASE WHEN value <= 3 THEN 'good' WHEN value <= 10 THEN 'fair' ELSE 'poor' END AS tint FROM events")
def diagnostic_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.tint(F.col("value"), 3.0, 10.0).alias("tint"))


@query("SELECT series_id, round(slope, 6) AS slope, round(intercept, 4) AS intercept, n_labels FROM (SELECT CAST(user_id % (SELECT greatest(4, count(*) // 2500) FROM events) AS INTEGER) AS series_id, (sum(w) * sum(w * px * value) - sum(w * px) * sum(w * value)) / (sum(w) * sum(w * px * px) - sum(w * px) ** 2) AS slope, (sum(w * value) - slope * sum(w * px)) / sum(w) AS intercept, count(*) AS n_labels FROM (SELECT user_id, value, event_id % 500 AS px, pow((50 + event_id % 50) / 100.0, 4) AS w FROM events) GROUP BY 1)")
def weighted_axis_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = samples(spark, sf_dir).withColumns({"px": F.pmod("event_id", F.lit(500)).cast("double"), "conf": 50.0 + F.pmod("event_id", F.lit(50))})
    return state.weighted_axis(labels, SERIES).select("series_id", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), "n_labels")
