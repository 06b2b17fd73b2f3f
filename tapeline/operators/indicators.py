"""Technical indicators: sma, ema, rsi, macd, Bollinger bands.

Rolling ones are row frames; ema, Wilder averages and macd are affine recurrences
(`ordered.recurrences`). Null, NaN and infinite prices count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.ordered import (
    DAY_NS,
    Blend,
    Layout,
    Segment,
    lag_columns,
    lay_out,
    recurrences,
    rows_since,
    running,
    with_context,
)
from tapeline.operators.resample import ohlcv_trades
from tapeline.operators.returns import finite


def _check(*periods: int) -> None:
    if any(p <= 0 for p in periods):
        raise ValueError("periods must be positive")


def _usable(price: str) -> Column:
    return F.when(finite(F.col(price)), F.col(price))


def _full(layout: Layout, price: str, period: int, value) -> Column:
    frame = layout.window().rowsBetween(-(period - 1), 0)
    seen = F.count(_usable(price)).over(frame)
    return F.when(seen == period, value(_usable(price)).over(frame))


def sma(
    prices: DataFrame,
    period: int,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    out: str = "sma",
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Rolling mean; null until the window is full."""
    _check(period)
    layout = with_context(lay_out(prices, keys, order, segment), period - 1)
    return layout.with_df(layout.df.withColumn(out, _full(layout, price, period, F.avg))).done()


def _bands(layout: Layout, price: str, period: int, k: float) -> dict[str, Column]:
    mid = _full(layout, price, period, F.avg)
    dev = _full(layout, price, period, F.stddev_pop)
    return {"bb_upper": mid + k * dev, "bb_middle": mid, "bb_lower": mid - k * dev}


def bollinger(
    prices: DataFrame,
    period: int = 20,
    k: float = 2.0,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Rolling mean plus and minus ``k`` population standard deviations."""
    _check(period)
    layout = with_context(lay_out(prices, keys, order, segment), period - 1)
    return layout.with_df(layout.df.withColumns(_bands(layout, price, period, k))).done()


_GAP = "_gap"


def _mark_gaps(layout: Layout, price: str) -> Layout:
    """Rows since the last usable price (null before the first one)."""
    return rows_since(layout, _usable(price).isNotNull(), "_pos", _GAP)


def _ema_terms(period: int, price: str, tag: str) -> dict[str, Column]:
    """Step columns of an exponential mean with weight 2 / (period + 1).

    After ``g`` rows the old value weighs (1 - weight)^g against the new one, so
    missing prices decay it; the first usable price seeds the mean.
    """
    weight = 2.0 / (period + 1)
    old = F.pow(F.lit(1.0 - weight), F.col(_GAP).cast("double"))
    here = _usable(price).isNotNull()
    first = F.col(_GAP).isNull()
    gain = F.when(~here, 1.0).when(first, 0.0).otherwise(old / (old + weight))
    scale = F.when(~here, 0.0).when(first, 1.0).otherwise(weight / (old + weight))
    return {
        f"_a_{tag}": gain,
        f"_s_{tag}": scale,
        f"_b_{tag}": scale * F.coalesce(_usable(price), F.lit(0.0)),
    }


def ema(
    prices: DataFrame,
    period: int,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    out: str = "ema",
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Exponential mean with weight 2 / (period + 1), seeded with the first price."""
    _check(period)
    layout = _mark_gaps(lay_out(prices, keys, order, segment), price)
    layout = layout.with_df(layout.df.withColumns(_ema_terms(period, price, "e")))
    done = recurrences(layout, {out: ("_a_e", "_b_e")}).done()
    return done.withColumn(out, F.when(finite(F.col(price)), F.col(out))).drop(
        "_a_e", "_b_e", "_s_e", _GAP, "_pos"
    )


_MACD_TERMS = {
    "_fast": ("_a_f", "_b_f"),
    "_slow": ("_a_s", "_b_s"),
    "macd_signal": ("_a_g", Blend("_s_g", {"_fast": 1.0, "_slow": -1.0})),
}


def _macd_steps(price: str, fast: int, slow: int, signal: int) -> dict[str, Column]:
    return {
        **_ema_terms(fast, price, "f"),
        **_ema_terms(slow, price, "s"),
        **_ema_terms(signal, price, "g"),
    }


def _macd_out(df: DataFrame, price: str) -> DataFrame:
    here = finite(F.col(price))
    line = F.col("_fast") - F.col("_slow")
    return df.withColumns(
        {
            "macd": F.when(here, line),
            "macd_hist": F.when(here, line - F.col("macd_signal")),
            "macd_signal": F.when(here, F.col("macd_signal")),
        }
    ).drop("_fast", "_slow", *[f"_{c}_{t}" for c in "abs" for t in "fsg"])


def macd(
    prices: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Fast minus slow exponential mean, its signal mean and their difference."""
    _check(fast, slow, signal)
    layout = _mark_gaps(lay_out(prices, keys, order, segment), price)
    layout = layout.with_df(layout.df.withColumns(_macd_steps(price, fast, slow, signal)))
    return _macd_out(recurrences(layout, _MACD_TERMS).done(), price).drop(_GAP, "_pos")


def _rsi_steps(period: int) -> dict[str, Column]:
    """The first ``period`` changes are averaged, later ones smoothed with 1/period."""
    change = F.coalesce(F.col("_change"), F.lit(0.0))
    gain = (
        F.when(F.col("_pos") == 1, 0.0)
        .when(F.col("_pos") <= period + 1, 1.0)
        .otherwise((period - 1) / period)
    )
    return {
        "_a_w": gain,
        "_b_up": F.greatest(change, F.lit(0.0)) / period,
        "_b_down": F.greatest(-change, F.lit(0.0)) / period,
    }


_RSI_TERMS = {"_up": ("_a_w", "_b_up"), "_down": ("_a_w", "_b_down")}


def _rsi_out(df: DataFrame, period: int, out: str) -> DataFrame:
    up, down = F.col("_up"), F.col("_down")
    value = (
        F.when(F.col("_pos") <= period, None)
        .when((up == 0.0) & (down == 0.0), 50.0)
        .when(down == 0.0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down)))
    )
    return df.withColumn(out, value).drop("_up", "_down", "_a_w", "_b_up", "_b_down", "_change")


def _with_change(layout: Layout, price: str) -> Layout:
    layout = lag_columns(layout, {"_prev": (_usable(price), 1)})
    changed = layout.df.withColumn("_change", _usable(price) - F.col("_prev")).drop("_prev")
    return layout.with_df(changed).settle()


def rsi(
    prices: DataFrame,
    period: int = 14,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    out: str = "rsi",
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Wilder's index: flat prices give 50, no losses 100; null for the first ``period`` rows."""
    _check(period)
    layout = _with_change(lay_out(prices, keys, order, segment), price)
    layout = running(layout, {"_pos": ("count", F.lit(1))})
    layout = layout.with_df(layout.df.withColumns(_rsi_steps(period)))
    return _rsi_out(recurrences(layout, _RSI_TERMS).done(), period, out).drop("_pos")


def indicators_all(
    trades: DataFrame,
    interval: str = "1d",
    period: int = 14,
    *,
    keys: Sequence[str] = ("symbol",),
    tie: Sequence[str] = (),
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    bb_period: int = 20,
    bb_k: float = 2.0,
) -> DataFrame:
    """Resample trades to bars and append every indicator of the close.

    Bars hold one row per key and interval, so keys are short whatever the number
    of trades; all indicators share one shuffle and one sort by key.
    """
    _check(period, fast, slow, signal, bb_period)
    bars = ohlcv_trades(trades, interval, keys=keys, tie=tie)
    layout = lay_out(bars, keys, ["bar"], segment=None)
    layout = _with_change(layout, "close")
    layout = _mark_gaps(layout, "close")
    columns = {
        "sma": _full(layout, "close", period, F.avg),
        **_bands(layout, "close", bb_period, bb_k),
        **_ema_terms(period, "close", "e"),
        **_macd_steps("close", fast, slow, signal),
        **_rsi_steps(period),
    }
    layout = layout.with_df(layout.df.withColumns(columns))
    done = recurrences(
        layout, {"ema": ("_a_e", "_b_e"), **_MACD_TERMS, **_RSI_TERMS}
    ).done()
    done = _rsi_out(_macd_out(done, "close"), period, "rsi")
    return done.drop("_a_e", "_b_e", "_s_e", _GAP, "_pos")
