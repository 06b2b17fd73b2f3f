"""Bars from trades, quotes and finer bars.

All bar aggregates are algebraic (map-side combine), so a symbol that owns a
large share of the trades shuffles one partial row per bucket and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.timefns import MONDAY_ORIGIN, bucket_ns, detect_unit_scale, parse_interval

# Grid points made per row of the first explode; keeps arrays short.
_GRID_CHUNK = 4096
# ... and at most this many nanoseconds, far from the end of BIGINT.
_GRID_REACH = 10**17


def _moment(ts: str, tie: Sequence[str]) -> Column:
    """What first/last order by. A tie column makes equal timestamps repeatable;
    without one the aggregate stays a plain hash aggregate."""
    return F.struct(ts, *tie) if tie else F.col(ts)


def _bar_columns(price: Column, moment: Column) -> list[Column]:
    return [
        F.min_by(price, moment).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, moment).alias("close"),
    ]


def _label(df: DataFrame, keys: Sequence[str], interval: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, "bar", F.lit(interval.strip().lower()).alias("interval"), *columns)


_OUT = ["open", "high", "low", "close", "volume", "vwap", "trade_count"]


def ohlcv_trades(
    trades: DataFrame,
    interval: str,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    price: str = "price",
    size: str = "size",
    tie: Sequence[str] = (),
    origin: int = MONDAY_ORIGIN,
) -> DataFrame:
    """Open/high/low/close, volume, vwap and count per key and interval.

    ``bar`` is the start of the interval. The vwap of a bar without volume is null.
    """
    width = parse_interval(interval)
    p, s = F.col(price), F.col(size)
    bars = trades.groupBy(*keys, bucket_ns(F.col(ts), width, origin).alias("bar")).agg(
        *_bar_columns(p, _moment(ts, tie)),
        F.sum(s).alias("volume"),
        F.try_divide(F.sum(p * s), F.sum(s)).alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return _label(bars, keys, interval, _OUT)


def ohlcv_trades_df(trades: DataFrame, interval: str, **options) -> DataFrame:
    """``ohlcv_trades`` keyed by whichever of symbol, provider, symbol_raw exist.

    The unit of the timestamps is nanoseconds; ``ohlcv_any_unit`` judges it per key.
    """
    keys = [c for c in ("symbol", "provider", "symbol_raw") if c in trades.columns]
    return ohlcv_trades(trades, interval, keys=keys, **options)


def ohlcv_any_unit(
    trades: DataFrame,
    interval: str,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    **options,
) -> DataFrame:
    """Bars of series whose timestamps are in ns, us or ms; ``bar`` keeps the unit.

    The unit is judged from each key's first timestamp, so the interval is scaled
    by a small per-key table instead of per row.
    """
    width = parse_interval(interval)
    unit = trades.groupBy(*keys).agg(detect_unit_scale(F.min(ts)).alias("_unit"))
    p, s = F.col(options.get("price", "price")), F.col(options.get("size", "size"))
    step = F.greatest(F.lit(1), F.call_function("div", F.lit(width), F.col("_unit")))
    bars = (
        trades.join(unit, list(keys))
        .groupBy(*keys, (F.col(ts) - F.pmod(F.col(ts), step)).alias("bar"))
        .agg(
            *_bar_columns(p, _moment(ts, options.get("tie", ()))),
            F.sum(s).alias("volume"),
            F.try_divide(F.sum(p * s), F.sum(s)).alias("vwap"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )
    return _label(bars, keys, interval, _OUT)


def time_grid(spans: DataFrame, width: int, out: str) -> DataFrame:
    """One row per step of ``[_lo, _hi]`` (both multiples of the step from ``_lo``).

    Exploded in two levels so that no row holds an array of the whole span.
    """
    chunk = width * max(1, min(_GRID_CHUNK, _GRID_REACH // width))
    starts = spans.where(F.col("_lo") <= F.col("_hi")).withColumn(
        "_from", F.explode(F.sequence("_lo", "_hi", F.lit(chunk)))
    )
    upto = F.least(F.col("_hi"), F.col("_from") + (chunk - width))
    return starts.withColumn(
        out, F.explode(F.sequence(F.col("_from"), upto, F.lit(width)))
    ).drop("_lo", "_hi", "_from")


def grid_left_join(
    bars: DataFrame,
    interval: str,
    *,
    start_ns: int | None = None,
    end_ns: int | None = None,
    keys: Sequence[str] = ("symbol",),
    origin: int = MONDAY_ORIGIN,
) -> DataFrame:
    """The full time grid of each key, left-joined to its bars.

    Without bounds a key's grid runs from its first to its last bar.
    """
    width = parse_interval(interval)
    lo = F.min("bar") if start_ns is None else bucket_ns(F.lit(start_ns), width, origin)
    hi = F.max("bar") if end_ns is None else bucket_ns(F.lit(end_ns), width, origin)
    spans = bars.groupBy(*keys).agg(F.min("bar").alias("_a"), F.max("bar").alias("_z"))
    if start_ns is None or end_ns is None:
        spans = bars.groupBy(*keys).agg(
            (F.min("bar") if start_ns is None else F.first(lo)).alias("_lo"),
            (F.max("bar") if end_ns is None else F.first(hi)).alias("_hi"),
        )
    else:
        spans = spans.select(*keys, lo.alias("_lo"), hi.alias("_hi"))
    return time_grid(spans, width, "bar").join(bars, [*keys, "bar"], "left")


def ohlcv_trades_fill(
    trades: DataFrame,
    interval: str,
    *,
    start_ns: int | None = None,
    end_ns: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ffill: bool = False,
    **options,
) -> DataFrame:
    """Bars on a full grid: empty intervals have null prices, volume 0 and count 0.

    ``ffill`` puts the last close before them instead.
    """
    bars = ohlcv_trades(trades, interval, keys=keys, **options)
    grid = grid_left_join(bars, interval, start_ns=start_ns, end_ns=end_ns, keys=keys)
    out = grid.withColumns(
        {
            "interval": F.lit(interval.strip().lower()),
            "volume": F.coalesce("volume", F.lit(0.0)),
            "trade_count": F.coalesce("trade_count", F.lit(0)),
        }
    )
    if ffill:
        # one row per interval: the frame is bounded by the span, not by the trades
        past = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last("close", ignorenulls=True).over(past)
        out = out.withColumns({c: F.coalesce(F.col(c), last) for c in ("open", "high", "low")})
        out = out.withColumn("close", last)
    return _label(out, keys, interval, _OUT)


QUOTE_PRICES = {
    "mid": lambda: (F.col("bid_px") + F.col("ask_px")) / 2.0,
    "bid": lambda: F.col("bid_px"),
    "ask": lambda: F.col("ask_px"),
}


def bars_from_quotes(
    quotes: DataFrame,
    interval: str,
    price_type: str = "mid",
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    tie: Sequence[str] = (),
    origin: int = MONDAY_ORIGIN,
) -> DataFrame:
    """Bars of the mid, bid or ask price: no volume, and vwap is the plain mean."""
    if price_type not in QUOTE_PRICES:
        raise ValueError(f"price_type must be one of {sorted(QUOTE_PRICES)}, got {price_type!r}")
    width = parse_interval(interval)
    price = QUOTE_PRICES[price_type]()
    bars = quotes.groupBy(*keys, bucket_ns(F.col(ts), width, origin).alias("bar")).agg(
        *_bar_columns(price, _moment(ts, tie)),
        F.lit(0.0).alias("volume"),
        F.avg(price).alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return _label(bars, keys, interval, _OUT)


def bars_rollup(
    bars: DataFrame,
    interval: str,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    origin: int = MONDAY_ORIGIN,
) -> DataFrame:
    """Bars to coarser bars. A missing vwap counts as the close, a missing count as 1."""
    width = parse_interval(interval)
    vwap = F.coalesce(F.col("vwap"), F.col("close")) if "vwap" in bars.columns else F.col("close")
    count = (
        F.coalesce(F.col("trade_count"), F.lit(1)) if "trade_count" in bars.columns else F.lit(1)
    )
    out = bars.groupBy(*keys, bucket_ns(F.col(ts), width, origin).alias("bar")).agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
        F.try_divide(F.sum(vwap * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.sum(count.cast("long")).alias("trade_count"),
    )
    return _label(out, keys, interval, _OUT)


def order_violations(
    records: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    arrival: Sequence[str],
    ts: str = "local_ts",
) -> DataFrame:
    """Rows whose timestamp lies before that of any earlier arrival of the same key.

    ``prev_ts`` is the latest time seen before the row.
    """
    from tapeline.operators.ordered import lay_out, running

    layout = lay_out(records, keys, arrival)
    seen = running(layout, {"prev_ts": ("max", F.col(ts))}, inclusive=False).done()
    return seen.where(F.col(ts) < F.col("prev_ts"))
