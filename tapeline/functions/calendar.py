"""US market calendar as column arithmetic over a DATE column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.timefns import SECOND, floor_div

MARKET_ZONE = "America/New_York"
# Minutes after midnight, market time. Fixed values.
OPEN_MIN, CLOSE_MIN, EARLY_CLOSE_MIN = 9 * 60 + 30, 16 * 60, 13 * 60
# Fixed-date holidays: (month, day, first year).
FIXED_HOLIDAYS = [(1, 1, 0), (6, 19, 2022), (7, 4, 0), (12, 25, 0)]
# Floating holidays: (month, weekday with Monday 0, nth or -1 for last, first year).
FLOATING_HOLIDAYS = [(1, 0, 3, 1998), (2, 0, 3, 0), (5, 0, -1, 0), (9, 0, 1, 0), (11, 3, 4, 0)]


def _day(year: Column, month: int | Column, day: int | Column) -> Column:
    as_col = [c if isinstance(c, Column) else F.lit(c) for c in (month, day)]
    return F.make_date(year, *as_col)


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The nth (or last) weekday of a month."""
    if n < 0:
        last = F.last_day(_day(year, month, 1))
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
    first = _day(year, month, 1)
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def _observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    wd = F.weekday(day)
    return F.when(wd == 5, F.date_sub(day, 1)).when(wd == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Gregorian Easter: the Sunday after the paschal full moon (Gauss's rule)."""

    def div(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    golden = year % 19
    century = div(year, 100)
    shift = (15 + century - div(13 + 8 * century, 25) - div(century, 4)) % 30
    moon = (19 * golden + shift) % 30
    # the paschal full moon never falls after April 18 (or 17 late in the cycle)
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full_moon = F.date_add(_day(year, 3, 21), moon)
    return F.date_add(full_moon, 7 - (F.weekday(full_moon) + 1) % 7)


def is_holiday(day: Column, custom: Sequence[str] = ()) -> Column:
    """Observed market holidays, New Year's Eve before a Saturday New Year included."""
    year = F.year(day)
    hit = day == F.date_sub(easter(year), 2)
    for month, dom, since in FIXED_HOLIDAYS:
        hit = hit | ((year >= since) & (day == _observed(_day(year, month, dom))))
    for month, weekday, n, since in FLOATING_HOLIDAYS:
        hit = hit | ((year >= since) & (day == _nth(year, month, weekday, n)))
    hit = hit | (day == F.when(F.weekday(_day(year + 1, 1, 1)) == 5, _day(year, 12, 31)))
    if custom:
        hit = hit | day.isin(*[dt.date.fromisoformat(c) for c in custom])
    return F.coalesce(hit, F.lit(False))


def is_early_close(day: Column) -> Column:
    """Day after Thanksgiving; Dec 24 on a weekday unless Dec 25 is a Saturday; Jul 3
    when Jul 4 is a weekday."""
    year = F.year(day)
    after_thanks = day == F.date_add(_nth(year, 11, 3, 4), 1)
    eve = (
        (day == _day(year, 12, 24))
        & (F.weekday(_day(year, 12, 25)) != 5)
        & (F.weekday(day) < 5)
    )
    july = (day == _day(year, 7, 3)) & (F.weekday(_day(year, 7, 4)) < 5)
    return after_thanks | eve | july


def is_trading_day(day: Column, custom: Sequence[str] = ()) -> Column:
    return (F.weekday(day) < 5) & ~is_holiday(day, custom)


def calendar_columns(day: Column, custom: Sequence[str] = ()) -> dict[str, Column]:
    trading = is_trading_day(day, custom)
    early = is_early_close(day)
    close = F.when(early, EARLY_CLOSE_MIN).otherwise(CLOSE_MIN)

    def at(minutes: Column) -> Column:
        none = F.lit(0)
        midnight = day.cast("timestamp_ntz")
        clock = midnight + F.make_dt_interval(none, none, minutes.cast("int"), none)
        return F.when(trading, F.convert_timezone(F.lit(MARKET_ZONE), F.lit("UTC"), clock))

    return {
        "is_holiday": is_holiday(day, custom),
        "is_trading_day": trading,
        "is_early_close": early,
        "open_minute": F.when(trading, F.lit(OPEN_MIN)),
        "close_minute": F.when(trading, close),
        "open_utc": at(F.lit(OPEN_MIN)),
        "close_utc": at(close),
    }


def calendar_table(
    spark: SparkSession, first: str, last: str, custom: Sequence[str] = ()
) -> DataFrame:
    """One row per date: (date, year, holiday and session columns). Hours are null when closed."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
        ).alias("date")
    )
    return days.withColumns({"year": F.year("date"), **calendar_columns(F.col("date"), custom)})


def market_clock(ts: Column) -> tuple[Column, Column]:
    """(market DATE, nanoseconds since market midnight) of a nanosecond timestamp.

    Goes through TIMESTAMP_NTZ, so the session time zone plays no part.
    """
    seconds = floor_div(ts, SECOND).cast("decimal(18,6)")
    none = F.lit(0)
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(none, none, none, seconds)
    local = F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), utc)
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return local.cast("date"), clock.cast("long") * SECOND + F.pmod(ts, F.lit(SECOND))


def session_filter(
    records: DataFrame,
    *,
    ts: str = "local_ts",
    custom: Sequence[str] = (),
) -> DataFrame:
    """Rows inside market hours, both ends inclusive; the hours follow from each row's
    own date, whatever its year."""
    minute = 60 * SECOND
    day, clock = market_clock(F.col(ts))
    close = F.when(is_early_close(F.col("_day")), EARLY_CLOSE_MIN).otherwise(CLOSE_MIN)
    timed = records.withColumns({"_day": day, "_clock": clock})
    return timed.where(
        F.col("_clock").between(F.lit(OPEN_MIN * minute), close * minute)
        & is_trading_day(F.col("_day"), custom)
    ).select(*records.columns)


def period_key(day: Column, interval: str) -> Column:
    """The scheduling period that a date belongs to, as text."""
    year, month = F.year(day), F.month(day)

    def key(*parts: Column) -> Column:
        return F.concat_ws("-", *[p.cast("string") for p in parts])

    if interval == "daily":
        return day.cast("string")
    if interval == "weekly":
        return key(F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    if interval == "semi_monthly":
        return key(year, month, F.when(F.day(day) < 15, 1).otherwise(2))
    if interval == "monthly":
        return key(year, month)
    if interval == "bi_monthly":
        return key(year, F.floor((month - 1) / 2))
    raise ValueError(f"unknown interval {interval!r}")


