"""Intervals and epoch-nanosecond columns (BIGINT, UTC throughout)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND
# Interval units. Fixed values.
UNIT_NS = {"s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": DAY, "w": 7 * DAY}
# Buckets count from Monday 2000-01-03, so that weeks start on Mondays.
MONDAY_ORIGIN = 946_857_600 * SECOND


def parse_interval(text: str) -> int:
    """``"5m"`` -> nanoseconds; seconds, minutes, hours, days and weeks."""
    match = re.fullmatch(r"(\d+)([smhdw])", text.strip().lower())
    if match is None or int(match[1]) == 0:
        raise ValueError(f"invalid interval {text!r}: expected e.g. 1s, 5m, 1h, 1d, 1w")
    return int(match[1]) * UNIT_NS[match[2]]


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_div(a: Column, width: int) -> Column:
    return int_div(a - F.pmod(a, F.lit(width)), width)


def bucket_ns(ts: Column, width: int, origin: int = MONDAY_ORIGIN) -> Column:
    return ts - F.pmod(ts - F.lit(origin), F.lit(width))


def day_from_ns(ts: Column) -> Column:
    """UTC DATE of a nanosecond timestamp, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts, DAY).cast("int"))


def date_from_ns(ts: Column) -> Column:
    """UTC date as ``YYYY-MM-DD`` text."""
    return day_from_ns(ts).cast("string")


def ns_from_day(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def ts_from_ns(ts: Column) -> Column:
    """TIMESTAMP (microseconds); only for windows and calendar arithmetic."""
    return F.timestamp_micros(floor_div(ts, 1000))


def ms_to_ns(ms: Column) -> Column:
    return (ms * 1_000_000).cast("long")


def us_to_ns(us: Column) -> Column:
    return (us * 1_000).cast("long")


def micros_to_ns(ts: Column) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ (read as UTC) to nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def rfc3339_to_ns(text: Column) -> Column:
    """RFC 3339 text with up to nine fractional digits; no zone means UTC.

    The zone and the fraction are applied as plain arithmetic, so digits beyond
    microseconds survive and the session time zone plays no part.
    """
    body = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})", 0)
    day = F.try_to_date(F.substring(body, 1, 10))

    def part(pos: int) -> Column:
        return F.substring(body, pos, 2).try_cast("long")

    seconds = part(12) * 3600 + part(15) * 60 + part(18)
    frac = F.rpad(F.regexp_extract(text, r":\d{2}\.(\d{1,9})", 1), 9, "0")
    zone = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 1)
    zone_min = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 2)
    # most times end in Z and need no search
    has_zone = ~text.endswith("Z") & text.rlike(r"[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:?\d{2}$")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when(
        has_zone, sign * (F.abs(zone.try_cast("long")) * 3600 + zone_min.try_cast("long") * 60)
    ).otherwise(F.lit(0))
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86_400 + seconds - shift) * SECOND + frac.cast("long")


def detect_unit_scale(first_ts: Column) -> Column:
    """Nanoseconds per tick, judged from the size of a series' first timestamp."""
    size = first_ts
    return (
        F.when(size < 100_000_000_000, 1)
        .when(size > 100_000_000_000_000_000, 1)
        .when(size > 100_000_000_000_000, 1_000)
        .otherwise(1_000_000)
        .cast("long")
    )


def ts_to_date(ts: Column) -> Column:
    """UTC DATE of an epoch in ns, us, ms or s, told apart by magnitude."""
    size = F.abs(ts)
    ns = (
        F.when(size > 100_000_000_000_000_000, ts)
        .when(size > 100_000_000_000_000, ts * 1_000)
        .when(size > 100_000_000_000, ts * 1_000_000)
        .otherwise(ts * SECOND)
    )
    return day_from_ns(ns)


def date_bounds(start_ns: int, end_ns: int) -> tuple[str, str]:
    """First and last UTC date that an inclusive nanosecond range touches."""
    import datetime as dt

    top = (dt.date.max - dt.date(1970, 1, 1)).days

    def day(ns: int) -> str:
        days = max(0, min(ns // DAY, top))
        return (dt.date(1970, 1, 1) + dt.timedelta(days=days)).isoformat()

    return day(start_ns), day(end_ns)
