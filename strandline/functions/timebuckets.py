"""Time arithmetic on TIMESTAMP_NTZ columns, all in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: Bucket of the merge, the archive and repeated deliveries.
QUARTER = 15 * MINUTE


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, epoch())


def floor_us(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def round_us(us: Column, width: int) -> Column:
    """The nearest multiple of ``width``; halfway goes to the even multiple."""
    rest = F.pmod(us, F.lit(width))
    count = F.floor((us - rest) / width).cast("long")
    up = F.when(2 * rest > width, 1).when(2 * rest == width, F.pmod(count, F.lit(2))).otherwise(0)
    return us - rest + up * width


def floor_bucket(ts: Column | str, width: int) -> Column:
    return from_micros(floor_us(micros(ts), width))


def round_bucket(ts: Column | str, width: int = QUARTER) -> Column:
    return from_micros(round_us(micros(ts), width))


def epoch_days(ts: Column | str) -> Column:
    return micros(ts) / float(DAY)


def from_epoch_days(days: Column) -> Column:
    return from_micros(F.round(days * float(DAY)).cast("long"))


def local_time(ts: Column | str, zone: str = "Pacific/Honolulu") -> Column:
    """A UTC time as a clock in ``zone`` shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)
