"""Time functions as Column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:[Zz]|[+-]\d{2}:?\d{2})?$"


def parse_iso(text: Column) -> Column:
    """Strict ISO-8601 to epoch milliseconds, fractions cut; impossible dates and other shapes give null; no offset means UTC (261)."""
    parts = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?", 1), F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})", 2)
    day = F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit("yyyy-MM-dd HH:mm:ss"))
    fraction = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    ms = F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("int")
    zone = F.regexp_extract(text, r"([+-]\d{2}:?\d{2})$", 1)
    minutes = F.when(zone != "", F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int"))).otherwise(0)
    return F.when(F.rlike(text, F.lit(_ISO)), F.unix_seconds(day) * 1000 + F.when(fraction != "", ms).otherwise(0) - minutes * 60_000)


def iso_of(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def iso_day(ms: Column) -> Column:
    """UTC date of epoch milliseconds (264)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def month_of(text: Column) -> Column:
    """YYYY-MM of an ISO time, or null (265)."""
    return F.date_format(F.timestamp_millis(parse_iso(text)), "yyyy-MM")


def calendar_days_between(a: Column, b: Column, zone: str = "UTC") -> Column:
    """Day boundaries between two epoch milliseconds in a zone, signed (266)."""
    local = lambda ms: F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    return F.datediff(local(b), local(a))


def format_duration(ms: Column) -> Column:
    """<1m, 5m, 2h 05m, 3d 4h: floors (267)."""
    minutes = F.floor(ms / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 1, F.lit("<1m"))
        .when(hours < 1, F.concat(minutes.cast("string"), F.lit("m")))
        .when(days < 1, F.concat(hours.cast("string"), F.lit("h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m")))
        .otherwise(F.concat(days.cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h")))
    )


def format_clock(ms: Column, ref_ms: Column, zone: str = "UTC") -> Column:
    """HH:MM on the reference's day, else with the date (268)."""
    at = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    same = F.to_date(at) == F.to_date(F.from_utc_timestamp(F.timestamp_millis(ref_ms), zone))
    return F.when(same, F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))


def parse_since(spec: str, now: datetime) -> datetime | None:
    """`30d`, or a date's UTC midnight (262, 263). An argument of a job, not a column."""
    spec = spec.strip()
    if spec.endswith("d") and spec[:-1].isdigit():
        return now - timedelta(days=int(spec[:-1]))
    try:
        return datetime.strptime(spec, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def month_window(now: datetime, month: str | None = None) -> tuple[datetime, datetime, bool]:
    """Start, end and whether it is still running: the given month, else the last whole one (121)."""
    if month is None:
        end = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        return (end - timedelta(days=1)).replace(day=1), end, False
    start = datetime.strptime(month, "%Y-%m").replace(tzinfo=timezone.utc)
    end = (start + timedelta(days=32)).replace(day=1)
    return start, end, end > now
