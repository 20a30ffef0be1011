"""Parsing and predicates on text: labels, titles, alerts, JSON records, formatted phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient_timestamp(text: Column, utc_shift_hours: int = 10) -> Column:
    """YYYY-MM-DD HH:MM:SS by its fields, where a field may overflow (second 60); shifted from local time to UTC."""
    pattern = r"(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{1,2}):(\d{1,2})"
    part = lambda k: F.regexp_extract(text, pattern, k).cast("int")
    whole = text.rlike(pattern)
    year, month, day, hour, minute, second = (F.when(whole, part(k)) for k in range(1, 7))
    midnight = F.make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    return midnight + F.make_dt_interval(F.lit(0), hour + utc_shift_hours, minute, second)


def repaired_years(text: Column) -> tuple[Column, Column]:
    """Start and end of a title range; if the years differ by more than one, the older year is replaced when that stays in order."""
    stamp = r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}:\d{2}:\d{2})"
    pattern = rf"\(\s*{stamp}\s+t[o0]\s+{stamp}\s*\)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    y1, y2 = (F.when(text.rlike(pattern), part(k).cast("int")) for k in (1, 5))
    newer = F.greatest(y1, y2)
    at = lambda year, k: F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), part(k), part(k + 1)), part(k + 2)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    plain, fixed = (at(y1, 2), at(y2, 6)), (at(newer, 2), at(newer, 6))
    repair = (F.abs(y1 - y2) > 1) & (fixed[0] < fixed[1])
    return F.when(repair, fixed[0]).otherwise(plain[0]), F.when(repair, fixed[1]).otherwise(plain[1])


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def tick_time(label: Column, reference: Column) -> Column:
    """A tick label (MM/DD, HH:MM or MMM-YYYY) near a reference time, local time plus ten hours.

    MM/DD takes the reference's year, the year before if that lies over 30 days ahead; HH:MM the nearest of the days
    around the reference; a month begins at its first midnight, as it stands. ``-`` and ``.`` may part month and day,
    ``.`` hour and minute, a blank month and year, and the month's letters may be of either case.
    """
    label, year, shift = F.trim(label), F.year(reference), F.expr("INTERVAL 10 HOURS")
    part = lambda pattern, k: F.regexp_extract(label, pattern, k).cast("int")
    dated, timed, monthly = r"^(\d{1,2})[/.-](\d{1,2})$", r"^(\d{1,2})[:.](\d{2})$", rf"(?i)^({'|'.join(MONTHS)})[-\s](\d{{4}})$"
    in_year = lambda y: F.try_to_timestamp(F.concat_ws("/", y.cast("string"), part(dated, 1).cast("string"), part(dated, 2).cast("string")), F.lit("yyyy/M/d")).cast("timestamp_ntz") + shift
    by_date = F.when(in_year(year) > reference + F.expr("INTERVAL 30 DAYS"), in_year(year - 1)).otherwise(in_year(year))
    hour, minute = part(timed, 1), part(timed, 2)
    midnight = F.date_trunc("DAY", reference - shift).cast("timestamp_ntz")
    tries = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: midnight + F.make_dt_interval(d, hour + 10, minute))
    nearest = F.array_min(F.transform(tries, lambda t: F.struct(F.abs(F.timestamp_diff("SECOND", reference, t)).alias("off"), t.alias("t"))))["t"]
    by_hour = F.when((hour <= 23) & (minute <= 59), nearest)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(label, monthly, 1))).cast("int")
    by_month = F.when(part(monthly, 2).between(2020, 2099), F.make_timestamp_ntz(part(monthly, 2), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.when(label.rlike(timed) & label.contains(":"), by_hour).when(label.rlike(monthly), by_month).when(label.rlike(dated) & in_year(year).isNotNull(), by_date).when(label.rlike(timed), by_hour)


def relevance(texts: Column | list[Column], zones: Column, event: Column, names: list[str], ambiguous: list[str], near: list[str], events: list[str]) -> Column:
    """Tier of an alert: 1 a sure name anywhere, 2 an ambiguous name in a near zone, 3 a listed event in a near zone, else null.

    ``texts`` are all the texts of the alert, such as event, headline, description and instruction; nulls are skipped.
    """
    text = F.lower(F.concat_ws(" ", *(texts if isinstance(texts, list) else [texts])))
    here = F.coalesce(F.arrays_overlap(zones, F.array(*map(F.lit, near))), F.lit(False))
    any_of = lambda words: F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False))
    return F.when(any_of(names), 1).when(any_of(ambiguous) & here, 2).when(F.trim(event).isin(events) & here, 3)


def json_number(text: Column, path: str) -> Column:
    return F.try_cast(F.get_json_object(text, path), "double") if hasattr(F, "try_cast") else F.get_json_object(text, path).try_cast("double")


def tint(value: Column, good: float, fair: float) -> Column:
    """Diagnostic band of a value where smaller is better."""
    return F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= fair, "fair").otherwise("poor")


def banded(value: Column, limits: list[tuple[float, str]], beyond: str) -> Column:
    """The name of the first band whose limit lies above the value, ``beyond`` at the end, unknown for null."""
    out = F.when(value.isNull() | F.isnan(value), "unknown")
    for limit, name in limits:
        out = out.when(value < limit, name)
    return out.otherwise(beyond)


# Bands of what a fit says, each as seen over a usual cycle.


def slope_tint(per_day: Column) -> Column:
    """How fast peaks rise or fall from one to the next."""
    return banded(F.abs(per_day), [(0.05, "flat"), (0.3, "trending"), (1.0, "strong")], "extreme")


def sample_tint(n: Column) -> Column:
    """Whether a saturation fit had rows enough."""
    return banded(n.cast("double"), [(4, "too few"), (12, "undersampled")], "typical")


def rate_tint(k: Column) -> Column:
    """Rate of a saturation curve per day; its ends of the usual range count as usual."""
    return F.when(k <= 0, "invalid").when(k.between(0.02, 0.3), "typical").otherwise(banded(k, [(0.02, "slow")], "rapid"))


def amplitude_tint(rise: Column) -> Column:
    """Whole rise of a saturation curve."""
    return F.when(rise <= 0, "invalid").when(rise.between(5, 50), "typical").otherwise(banded(rise, [(5, "small")], "large"))


def day_phrase(days: Column) -> Column:
    """How far ahead or back a time lies, in words."""
    n = F.bround(days).cast("int")
    return (
        F.when(n.isNull(), "no forecast").when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday")
        .when(n > 1, F.concat(F.lit("in "), n.cast("string"), F.lit(" days"))).otherwise(F.concat((-n).cast("string"), F.lit(" days ago")))
    )


def band_phrase(low: Column, high: Column) -> Column:
    """A forecast's range: half its width in whole days, and its two dates; null without a range."""
    half = F.timestamp_diff("MICROSECOND", low, high) / 2 / 8.64e10
    day = lambda c: F.date_format(c, "MMM d")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("±"), F.bround(half).cast("long").cast("string"), F.lit(" days, "), day(low), F.lit(" to "), day(high)))


def status_line(state: Column, now: Column, next_ts: Column, low: Column, high: Column) -> Column:
    """What is shown of a series: a struct of title, headline and detail by its state and forecast."""
    days = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 8.64e10
    day = lambda c: F.date_format(c, "MMM d")
    row = lambda title, headline, detail: F.struct(title.alias("title"), headline.alias("headline"), detail.alias("detail"))
    end = F.coalesce(high, next_ts)
    late = F.concat(F.bround(days(end, now)).cast("long").cast("string"), F.lit(" days"))
    return (
        F.when(state == "active", row(F.lit("status"), F.lit("under way"), F.lit("")))
        .when(next_ts.isNull() & low.isNull(), row(F.lit("next"), F.lit("unknown"), F.lit("too few peaks for a forecast")))
        .when(state == "overdue", row(F.lit("overdue by"), late, F.concat(F.lit("expected until "), day(end))))
        .when(state == "imminent", row(F.lit("next"), F.lit("any time now"), F.coalesce(band_phrase(low, high), day(next_ts))))
        .when(next_ts.isNotNull(), row(F.lit("next"), day_phrase(days(now, next_ts)), F.coalesce(band_phrase(low, high), day(next_ts))))
        .otherwise(row(F.lit("next"), band_phrase(low, high), F.lit("no single date")))
    )


def stamp_text(ts: Column) -> Column:
    """A time as stored in reports: ISO with microseconds, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def stamp_time(text: Column) -> Column:
    """A stored time back, with any offset or Z, as UTC; null for what is no time."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[Zz]$", "+00:00")).cast("timestamp_ntz")


def http_time(text: Column) -> Column:
    """The time of an HTTP date such as ``Wed, 21 Oct 2015 07:28:00 GMT``; the weekday is not looked at."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", ""), r"\s*(GMT|UTC|\+0000)$", "")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")


def data_age(headers: DataFrame, column: str, now: Column) -> DataFrame:
    """One row: age_seconds of the newest of the HTTP dates in ``column``, infinity where none can be read."""
    newest = headers.agg(F.max(http_time(F.col(column))).alias("newest"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("newest"), now) / 1e6
    return newest.select(F.coalesce(seconds, F.lit(float("inf"))).alias("age_seconds"))


def status_records(raw: DataFrame, target: str) -> DataFrame:
    """The first record of each JSON list in ``body`` whose name contains ``target`` in either case; none where no one does.

    name, observatory, colour, level, sent, notice_url, notice_type, notice_id, with defaults for what is missing.
    """
    schema = "array<struct<volcano_name:string,obs_fullname:string,obs_abbr:string,color_code:string,alert_level:string,sent_utc:string,notice_url:string,notice_type_cd:string,notice_identifier:string>>"
    listed = raw.select(F.filter(F.from_json("body", schema), lambda r: F.contains(F.lower(F.coalesce(r["volcano_name"], F.lit(""))), F.lit(target.lower()))).alias("hits"))
    r, text = F.col("hits")[0], lambda c: F.nullif(F.trim(c), F.lit(""))
    return listed.filter(F.size("hits") > 0).select(
        r["volcano_name"].alias("name"),
        F.coalesce(text(r["obs_fullname"]), text(r["obs_abbr"]), F.lit("Unknown")).alias("observatory"),
        F.upper(F.coalesce(text(r["color_code"]), F.lit("unspecified"))).alias("colour"),
        F.upper(F.coalesce(text(r["alert_level"]), F.lit("unspecified"))).alias("level"),
        stamp_time(r["sent_utc"]).alias("sent"),
        r["notice_url"].alias("notice_url"),
        r["notice_type_cd"].alias("notice_type"),
        r["notice_identifier"].alias("notice_id"),
    )


def alert_records(raw: DataFrame) -> DataFrame:
    """Feature collections in ``body`` to one row per feature, in no order."""
    schema = "features array<struct<properties:struct<event:string,headline:string,description:string,instruction:string,severity:string,sent:string,geocode:struct<UGC:array<string>>>>>"
    rows = raw.select(F.explode(F.from_json("body", schema)["features"]["properties"]).alias("f"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        F.coalesce(text(F.col("f.event")), F.lit("Alert")).alias("event"),
        F.coalesce(text(F.col("f.headline")), text(F.col("f.event")), F.lit("Alert")).alias("headline"),
        F.coalesce("f.description", F.lit("")).alias("description"),
        F.coalesce("f.instruction", F.lit("")).alias("instruction"),
        F.upper(F.coalesce(text(F.col("f.severity")), F.lit("unknown"))).alias("severity"),
        stamp_time(F.col("f.sent")).alias("sent"),
        F.coalesce(F.col("f.geocode.UGC"), F.array().cast("array<string>")).alias("zones"),
    )
