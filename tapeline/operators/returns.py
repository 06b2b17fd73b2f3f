"""Returns, beta and realized volatility."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.ratios import ieee_ln, ieee_ratio
from tapeline.operators.ordered import DAY_NS, Segment, lag_columns, lay_out

NAN = float("nan")


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))


def present(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col)


def simple_return(price: Column, prev: Column) -> Column:
    ok = present(price) & present(prev) & (prev != 0.0)
    return F.when(ok, (price - prev) / F.nullif(prev, F.lit(0.0))).otherwise(F.lit(NAN))


def log_return(price: Column, prev: Column) -> Column:
    ok = present(price) & present(prev) & (price > 0.0) & (prev > 0.0)
    return F.when(ok, F.ln(price / F.nullif(prev, F.lit(0.0)))).otherwise(F.lit(NAN))


def _returns(prices, formula, out, price, keys, order, segment):
    layout = lag_columns(lay_out(prices, keys, order, segment), {"_prev": (F.col(price), 1)})
    return layout.done().withColumn(out, formula(F.col(price), F.col("_prev"))).drop("_prev")


def simple_returns(
    prices: DataFrame,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    out: str = "simple_return",
    segment: Segment = DAY_NS,
    ieee: bool = False,
) -> DataFrame:
    """(p - prev) / prev per key; NaN on the first row and where either side is unusable.

    With ``ieee`` null there, and a price of zero before gives an infinity or NaN.
    """
    formula = (lambda p, prev: ieee_ratio(p - prev, prev)) if ieee else simple_return
    return _returns(prices, formula, out, price, keys, order, segment)


def log_returns(
    prices: DataFrame,
    *,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    out: str = "log_return",
    segment: Segment = DAY_NS,
    ieee: bool = False,
) -> DataFrame:
    """ln(p / prev) per key; NaN on the first row and where either side is not positive.

    With ``ieee`` null on the first row, and zeros give infinities or NaN.
    """
    formula = (lambda p, prev: ieee_ln(ieee_ratio(p, prev))) if ieee else log_return
    return _returns(prices, formula, out, price, keys, order, segment)


def beta(
    asset: DataFrame,
    market: DataFrame,
    *,
    on: Sequence[str],
    ret: str = "ret",
    market_ret: str = "market_ret",
    keys: Sequence[str] = ("symbol",),
    ieee: bool = False,
) -> DataFrame:
    """Sample covariance over sample variance against a benchmark, per key.

    Pairs with a non-finite side are left out; fewer than two pairs or a market
    variance near zero give NaN. ``market`` has one row per ``on`` value. With ``ieee``
    only pairs with a null are left out, a non-finite side makes the result NaN, and
    what is undefined is null.
    """
    both = finite(F.col(ret)) & finite(F.col(market_ret))
    used = F.col(ret).isNotNull() & F.col(market_ret).isNotNull() if ieee else both
    pairs = asset.join(market, list(on)).where(used)
    stats = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp(ret, market_ret).alias("_cov"),
        F.var_samp(market_ret).alias("_var"),
        F.bool_and(both).alias("_finite"),
    )
    floor = max(1e-18, 10 * 2.220446049250313e-16)
    # a sum's order must not decide between an infinity and NaN
    value = F.when(F.col("_finite"), F.try_divide(F.col("_cov"), F.col("_var"))).otherwise(F.lit(NAN))
    value = F.when((F.col("n") >= 2) & (F.col("_var") > floor), value)
    value = value if ieee else F.coalesce(value, F.lit(NAN))
    return stats.select(*keys, "n", value.alias("beta"))


def realized_vol(
    returns: DataFrame,
    *,
    ret: str = "ret",
    keys: Sequence[str] = ("symbol",),
    annualization: float = 252.0,
    method: str | Mapping[str, str] = "standard",
    ieee: bool = False,
) -> DataFrame:
    """Annualized volatility per key; non-finite returns are left out.

    With ``ieee`` they count, and what is undefined is null, not NaN.
    Several methods, by the names of their columns, come from one aggregate.
    """
    if not math.isfinite(annualization) or annualization < 0:
        raise ValueError("annualization must be finite and >= 0")
    r = F.col(ret) if ieee else F.when(finite(F.col(ret)), F.col(ret))
    n = F.count(r)
    values = {
        "standard": F.when(n >= 2, F.stddev_samp(r) * math.sqrt(annualization)),
        "sum_of_squares": F.when(n >= 1, F.sqrt(F.try_divide(F.sum(r * r) * annualization, n))),
    }
    wanted = {"realized_vol": method} if isinstance(method, str) else dict(method)
    for chosen in wanted.values():
        if chosen.lower() not in values:
            raise ValueError(f"method must be 'standard' or 'sum_of_squares', got {chosen!r}")
    missing = F.lit(None if ieee else NAN).cast("double")
    return returns.groupBy(*keys).agg(
        n.alias("n"),
        *[F.coalesce(values[chosen.lower()], missing).alias(out) for out, chosen in wanted.items()],
    )
