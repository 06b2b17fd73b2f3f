"""Split and dividend adjustment.

Actions are first multiplied together per (symbol, ex-date). From there on a symbol
holds at most one row per calendar date, so the running product over dates is short
however many rows the action or price table has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.ordered import DAY_NS, Segment, lag_columns, lay_out

# Action types. Fixed values.
SPLIT, STOCK_DIVIDEND, SPIN_OFF, CASH_DIVIDEND = (
    "split",
    "dividend_stock",
    "spinoff",
    "dividend_cash",
)
ACTION_TYPES = (SPLIT, CASH_DIVIDEND, STOCK_DIVIDEND, SPIN_OFF, "merger", "ticker_change")


def _date(col: Column) -> Column:
    """A DATE from a date or text column; malformed text becomes null."""
    return F.try_to_date(F.substring(col.cast("string"), 1, 10))


def known_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions with a known type and a readable date, the rest)."""
    good = F.coalesce(
        F.col("type").isin(*ACTION_TYPES) & _date(F.col("ex_date")).isNotNull(), F.lit(False)
    )
    return actions.where(good), actions.where(~good)


def _multipliers(unknown_as_split: bool) -> tuple[Column, Column]:
    kind, value = F.col("type"), F.col("value")
    split = kind == SPLIT
    if unknown_as_split:
        split = split | ~kind.isin(*ACTION_TYPES)
    price = F.when(split, value).when(kind.isin(STOCK_DIVIDEND, SPIN_OFF), value + 1.0)
    share = F.when(split, value).when(kind == STOCK_DIVIDEND, value + 1.0)
    return F.coalesce(price, F.lit(1.0)), F.coalesce(share, F.lit(1.0))


def date_union(prices: DataFrame, actions: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Price dates and action dates per key, each once."""
    left = prices.select(*keys, _date(F.col(date)).alias("_d"))
    right = actions.select(*keys, _date(F.col("ex_date")).alias("_d"))
    return left.union(right).where(F.col("_d").isNotNull()).distinct()


def cumulative_factors(
    prices: DataFrame,
    actions: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    date: str = "date",
    base_date: str | None = None,
    unknown_as_split: bool = False,
) -> DataFrame:
    """Price and share factors per key and price date, 1 at the base date.

    An action on date d changes the factors of the dates before d, also when d has
    no price. The base is the last price date unless given.
    """
    price, share = _multipliers(unknown_as_split)
    per_date = (
        actions.select(*keys, _date(F.col("ex_date")).alias("_d"), price.alias("p"), share.alias("s"))
        .where(F.col("_d").isNotNull())
        .groupBy(*keys, "_d")
        .agg(F.product("p").alias("_mp"), F.product("s").alias("_ms"))
    )
    priced = (
        prices.select(*keys, _date(F.col(date)).alias("_d"))
        .where(F.col("_d").isNotNull())
        .distinct()
        .withColumn("_priced", F.lit(True))
    )
    # one row per key and date, from here on short per key
    dates = priced.join(per_date, [*keys, "_d"], "full").where(
        F.col("_priced") | F.col("_mp").isNotNull()
    )
    later = (
        Window.partitionBy(*keys).orderBy(F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*keys)
    raw = dates.withColumns(
        {
            "_rp": F.coalesce(F.product(F.coalesce("_mp", F.lit(1.0))).over(later), F.lit(1.0)),
            "_rs": F.coalesce(F.product(F.coalesce("_ms", F.lit(1.0))).over(later), F.lit(1.0)),
        }
    )
    base = (
        F.max(F.when(F.col("_priced"), F.col("_d"))).over(whole)
        if base_date is None
        else F.coalesce(
            _date(F.lit(base_date)), F.max(F.when(F.col("_priced"), F.col("_d"))).over(whole)
        )
    )
    raw = raw.withColumn("_base", base)
    upto = F.when(F.col("_d") <= F.col("_base"), F.col("_d"))

    def at_base(col: str) -> Column:
        return F.coalesce(
            F.max_by(F.col(col), upto).over(whole), F.min_by(F.col(col), F.col("_d")).over(whole)
        )

    return (
        raw.withColumns({"_np": at_base("_rp"), "_ns": at_base("_rs")})
        .where("_priced")
        .select(
            *keys,
            F.col("_d").cast("string").alias(date),
            F.try_divide("_rp", "_np").alias("cfacpr"),
            F.try_divide("_rs", "_ns").alias("cfacshr"),
        )
    )


def factor_join(
    prices: DataFrame, factors: DataFrame, *, keys: Sequence[str] = ("symbol",), date: str = "date"
) -> DataFrame:
    """Prices with their factors; dates without one get 1."""
    keyed = prices.withColumn("_k", _date(F.col(date)).cast("string"))
    side = factors.withColumnRenamed(date, "_k")
    return (
        keyed.join(side, [*keys, "_k"], "left")
        .withColumns(
            {
                "cfacpr": F.coalesce("cfacpr", F.lit(1.0)),
                "cfacshr": F.coalesce("cfacshr", F.lit(1.0)),
            }
        )
        .select(*prices.columns, "cfacpr", "cfacshr")
    )


def dividend_join(
    prices: DataFrame, actions: DataFrame, *, keys: Sequence[str] = ("symbol",), date: str = "date"
) -> DataFrame:
    """Prices with the cash dividends of their date summed (0 when none)."""
    cash = (
        actions.where(F.col("type") == CASH_DIVIDEND)
        .groupBy(*keys, _date(F.col("ex_date")).alias("_k"))
        .agg(F.sum("value").alias("div_cash"))
        .where(F.col("_k").isNotNull())
    )
    return (
        prices.withColumn("_k", _date(F.col(date)))
        .join(cash, [*keys, "_k"], "left")
        .withColumn("div_cash", F.coalesce("div_cash", F.lit(0.0)))
        .select(*prices.columns, "div_cash")
    )


def adjust_prices(prices: DataFrame) -> DataFrame:
    """Adjusted prices and volume from factor columns (a missing factor counts as 1)."""
    price = F.coalesce("cfacpr", F.lit(1.0))
    out = {
        f"adj_{c}": F.try_divide(F.col(c), price)
        for c in ("open", "high", "low", "close", "vwap")
        if c in prices.columns
    }
    if "volume" in prices.columns:
        out["adj_volume"] = F.col("volume") * F.coalesce("cfacshr", F.lit(1.0))
    return prices.withColumns(out)


def total_return(
    adjusted: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    date: str = "date",
    order: Sequence[str] | None = None,
    segment: Segment = DAY_NS,
) -> DataFrame:
    """(adj_close + adjusted dividend) / previous adj_close - 1 per key.

    Null on the first row and after a zero price.
    """
    layout = lay_out(adjusted, keys, order or [date], segment)
    out = lag_columns(layout, {"_prev": (F.col("adj_close"), 1)}).done()
    gain = F.col("adj_close") + F.try_divide("div_cash", F.coalesce("cfacpr", F.lit(1.0)))
    value = F.when(F.col("_prev") != 0.0, F.try_divide(gain, F.col("_prev")) - 1.0)
    return out.withColumn("total_return", value).drop("_prev")


def adjust_dataframe(
    prices: DataFrame,
    actions: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    date: str = "date",
    base_date: str | None = None,
    unknown_as_split: bool = False,
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Factors, adjusted prices, dividends and total returns in one plan.

    Actions of an unknown type or without a readable date take no part; they are the
    second table of ``known_actions``, for a dead-letter output. ``unknown_as_split``
    takes unknown types as splits instead.
    """
    if not unknown_as_split:
        actions, _ = known_actions(actions)
    factors = cumulative_factors(
        prices, actions, keys=keys, date=date, base_date=base_date, unknown_as_split=unknown_as_split
    )
    wide = factor_join(prices, factors, keys=keys, date=date)
    wide = dividend_join(wide, actions, keys=keys, date=date)
    return total_return(adjust_prices(wide), keys=keys, date=date, segment=segment)
