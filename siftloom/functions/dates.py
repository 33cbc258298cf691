"""Dates: lenient parsing, days in a time zone, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
#: A time that says its zone; one that doesn't is of UTC.
_ZONED = "(?:Z|UTC|GMT|[+-]\\d\\d(?::?\\d\\d)?|[ \\d][A-Z]{2,4})$"
_PATTERNS = ("d MMM yyyy HH:mm:ss[ xx][ z]", "d MMM yyyy HH:mm[ xx][ z]", "MMM d, yyyy[ z]", "MMMM d, yyyy[ z]", "MMMM d yyyy[ z]", "d MMMM yyyy[ z]", "yyyy/M/d[ z]")


def utc(wall: Column) -> Column:
    """The instant of a time without a zone, read as UTC whatever the session's zone."""
    return F.try_to_timestamp(F.concat(wall.cast("timestamp_ntz").cast("string"), F.lit("Z")))


def midnight(date: Column) -> Column:
    """The first instant of a UTC day."""
    return F.timestamp_seconds(F.unix_date(date) * F.lit(86_400).cast("long"))


def iso(text: Column) -> Column:
    """The instant of an ISO 8601 text; without a zone it is of UTC, and a bare date is its midnight there."""
    bare = F.trim(text)
    return F.try_to_timestamp(F.when(bare.rlike("^\\d{4}-\\d\\d-\\d\\d$"), F.concat(bare, F.lit("T00:00:00Z"))).when(bare.rlike(_ZONED), bare).otherwise(F.concat(bare, F.lit("Z"))))


def parse(text: Column) -> Column:
    """A timestamp from ISO 8601, mail and long English forms, of UTC without a zone; the day of the week isn't looked at; null if none fits."""
    bare = F.trim(F.regexp_replace(text, "^[A-Za-z]{3,9},\\s*", ""))
    named = F.regexp_replace(bare, "\\b(GMT|UT|Z)$", "UTC")
    named = F.when(named.rlike(_ZONED), named).otherwise(F.concat(named, F.lit(" UTC")))
    tries = [iso(F.when(bare.rlike("^\\d{4}-\\d\\d-\\d\\d"), bare))]
    tries += [F.try_to_timestamp(F.when(~bare.rlike("^\\d{4}-"), named), F.lit(p)) for p in _PATTERNS]
    return F.coalesce(*tries)


def day(ts: Column, zone: str = ZONE) -> Column:
    """The day of an instant in a zone, whatever the session's."""
    return F.date_from_unix_date(F.floor(F.unix_micros(F.from_utc_timestamp(ts, zone)) / 86_400_000_000).cast("int"))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def age_days(ts: Column, now: Column) -> Column:
    return F.round((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000).cast("int")


def label(date: Column, today: Column) -> Column:
    """今天, 昨天 or month, day and weekday."""
    week = F.array(*[F.lit(x) for x in ("周日", "周一", "周二", "周三", "周四", "周五", "周六")])
    long = F.concat(F.month(date).cast("string"), F.lit("月"), F.dayofmonth(date).cast("string"), F.lit("日 "), F.element_at(week, F.dayofweek(date)))
    return F.when(F.datediff(today, date) == 0, "今天").when(F.datediff(today, date) == 1, "昨天").otherwise(long)


def last_dates(today: Column, n: int) -> Column:
    """The last n dates, ascending."""
    return F.sequence(F.date_sub(today, n - 1), today)
