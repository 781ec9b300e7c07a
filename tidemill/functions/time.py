"""Parts, truncation and construction of dates and times; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_minutes(ts: Column, minutes: int) -> Column:
    """The start of the time's slot of ``minutes`` minutes within its hour; ``minutes`` must divide 60. Keeps the type with or without zone."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("minutes must divide 60")
    # taken off as an interval, which leaves a time without zone without one, whatever the session's zone
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.minute(ts), F.lit(minutes)), F.extract(F.lit("SECOND"), ts))


def truncate_time(nanos: Column, minutes: int) -> Column:
    """As truncate_minutes for a time of day in nanoseconds."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("minutes must divide 60")
    step = minutes * 60 * 1_000_000_000
    return nanos - F.pmod(nanos, F.lit(step))


year, month, day, ordinal, hour, minute, second = F.year, F.month, F.dayofmonth, F.dayofyear, F.hour, F.minute, F.second


def nanosecond(ts: Column) -> Column:
    """The part below a second, in nanoseconds; Spark keeps microseconds."""
    return (F.pmod(F.extract(F.lit("SECOND"), ts), F.lit(1)) * 1_000_000_000).cast("int")


def from_days(days: Column) -> Column:
    """The date so many days after 1970-01-01."""
    return F.date_from_unix_date(days)


def as_days(date: Column) -> Column:
    return F.unix_date(date)


def from_ordinal(year_: Column, day_of_year: Column) -> Column:
    """The date of a year's n-th day, from 1; null outside the year."""
    out = F.date_add(F.make_date(year_, F.lit(1), F.lit(1)), day_of_year - 1)
    return F.when(F.year(out) == year_, out)


def from_seconds(seconds: Column, nanos: Column | None = None) -> Column:
    """The time of day, in nanoseconds, of a second of the day; null from 86,400 on."""
    return F.when((seconds >= 0) & (seconds < 86_400), seconds.cast("bigint") * 1_000_000_000 + (nanos if nanos is not None else F.lit(0)))


def with_timezone(ts: Column, zone: str) -> Column:
    """A time without zone, taken in ``zone`` (a name or +HH:MM), as an instant; the session's zone has no part in it."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))
    seconds = F.unix_date(utc.cast("date")).cast("bigint") * 86_400 + F.hour(utc) * 3_600 + F.minute(utc) * 60
    return F.timestamp_micros(seconds * 1_000_000 + (F.extract(F.lit("SECOND"), utc) * 1_000_000).cast("bigint"))


def without_timezone(ts: Column, zone: str) -> Column:
    """The wall clock of an instant in ``zone``."""
    return F.from_utc_timestamp(ts, F.lit(zone))


def offset_seconds(ts: Column, zone: str) -> Column:
    """How far ``zone`` is ahead of UTC at an instant."""
    return (F.unix_micros(F.from_utc_timestamp(ts, F.lit(zone))) - F.unix_micros(ts)) / F.lit(1_000_000)


def fixed_zone(seconds: int) -> str:
    """The name of the zone that is so many seconds ahead of UTC."""
    if abs(seconds) > 18 * 3600 or seconds % 60:
        raise ValueError("an offset is whole minutes within 18 hours")
    return f"{'-' if seconds < 0 else '+'}{abs(seconds) // 3600:02d}:{abs(seconds) % 3600 // 60:02d}"


def parse_date(text: Column) -> Column:
    """A date from YYYY-MM-DD; null if it isn't one."""
    return text.try_cast("date")


def parse_datetime(text: Column) -> Column:
    """An instant from RFC 3339 text; null if it isn't one."""
    return F.try_to_timestamp(text)
