"""Volume at price, price ladders, depth profiles and slippage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.schema import LEVELS

METHODS = ("uniform", "typical", "close")


def usable_bars(bars: DataFrame) -> DataFrame:
    return bars.where((F.col("volume") > 0) & (F.col("high") >= F.col("low")))


def usable_levels(levels: Column) -> Column:
    """Levels with a positive price and size."""
    return F.filter(levels, lambda v: (v["price"] > 0) & (v["size"] > 0))


def reference_price(
    bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "local_ts"
) -> DataFrame:
    """The last close per key."""
    return bars.groupBy(*keys).agg(F.max_by("close", ts).alias("reference_price"))


def volume_at_price(
    bars: DataFrame,
    *,
    bins: int = 40,
    method: str = "uniform",
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Bar volume over ``bins`` equal price buckets of each key's range: (price, size).

    ``uniform`` spreads a bar over the buckets between its low and high, ``typical``
    and ``close`` put it into one. Price and size are rounded to 6 digits. Range and
    bucket sums are partial aggregates; a bar becomes at most ``bins`` rows before them.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    use = usable_bars(bars)
    span = use.groupBy(*keys).agg(
        F.min("low").alias("_lo"), F.max("high").alias("_hi")
    ).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    flat = F.col("_hi") <= F.col("_lo")

    def index(price: Column) -> Column:
        step = F.try_divide(price - F.col("_lo"), F.col("_w"))
        place = F.least(F.greatest(F.floor(step), F.lit(0)), F.lit(bins - 1))
        return F.when(flat, F.lit(0)).otherwise(place).cast("int")

    if method == "uniform":
        first, last = index(F.col("low")), index(F.col("high"))
    else:
        at = F.col("close") if method == "close" else (F.col("high") + F.col("low") + F.col("close")) / 3.0
        first = last = index(at)
    spread = (
        use.join(span, list(keys))
        .select(
            *keys,
            "_lo",
            "_w",
            flat.alias("_flat"),
            (F.col("volume") / (last - first + 1)).alias("_share"),
            F.explode(F.sequence(first, last)).alias("_i"),
        )
        .groupBy(*keys, "_lo", "_w", "_flat", "_i")
        .agg(F.sum("_share").alias("_v"))
        .where(F.col("_v") > 0)
    )
    center = F.when(F.col("_flat"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_i") + 0.5) * F.col("_w")
    )
    size = F.when(F.col("_flat"), F.col("_v")).otherwise(F.round("_v", 6))
    return spread.select(*keys, F.round(center, 6).alias("price"), size.alias("size"))


def ladder_top_n(
    profile: DataFrame,
    reference: DataFrame,
    *,
    top_n: int = 10,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Levels below the reference price (best = highest) and above it (best = lowest),
    ``top_n`` per side with their rank; a level at the reference price is left out."""
    side = F.when(F.col("price") < F.col("reference_price"), "bid").when(
        F.col("price") > F.col("reference_price"), "ask"
    )
    away = F.abs(F.col("price") - F.col("reference_price"))
    sided = profile.join(reference, list(keys)).withColumn("side", side).where(F.col("side").isNotNull())
    spec = Window.partitionBy(*keys, "side").orderBy(away)
    return (
        sided.withColumn("level", F.row_number().over(spec))
        .where(F.col("level") <= top_n)
        .select(*keys, "reference_price", "side", "level", "price", "size")
    )


def depth_profile(
    bars: DataFrame,
    *,
    bins: int = 40,
    top_n: int = 10,
    method: str = "uniform",
    basis: str = "bar_vap",
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
) -> DataFrame:
    """One synthetic depth record per key from its bars."""
    ref = bars.groupBy(*keys).agg(
        F.max_by("close", ts).alias("reference_price"), F.max(ts).alias("source_ts")
    )
    profile = volume_at_price(bars, bins=bins, method=method, keys=keys)
    ladder = ladder_top_n(profile, ref.drop("source_ts"), top_n=top_n, keys=keys)

    def levels(side: str) -> Column:
        # at most top_n entries
        ranked = F.sort_array(
            F.collect_list(F.when(F.col("side") == side, F.struct("level", "price", "size")))
        )
        return F.transform(ranked, lambda v: F.struct(v["price"].alias("price"), v["size"].alias("size")))

    sides = ladder.groupBy(*keys).agg(levels("bid").alias("bids"), levels("ask").alias("asks"))
    none = F.array().cast(LEVELS)
    out = ref.join(sides, list(keys), "left").withColumns(
        {"bids": F.coalesce("bids", none), "asks": F.coalesce("asks", none)}
    )
    return out.select(
        *keys,
        "bids",
        "asks",
        "reference_price",
        F.lit(basis).alias("basis"),
        F.lit(True).alias("is_synthetic"),
        (F.size("bids") + F.size("asks")).cast("long").alias("depth"),
        "source_ts",
    )


def depth_from_quote(
    quotes: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    tie: Sequence[str] = (),
    basis: str = "quote_l1",
) -> DataFrame:
    """One-level depth from the latest quote per key; a zero side is empty."""
    last = quotes.groupBy(*keys).agg(
        F.max_by(F.struct("bid_px", "bid_sz", "ask_px", "ask_sz"), F.struct(ts, *tie)).alias("q")
    )
    bid, ask = F.col("q.bid_px"), F.col("q.ask_px")
    has_bid, has_ask = F.coalesce(bid != 0, F.lit(False)), F.coalesce(ask != 0, F.lit(False))
    none = F.array().cast(LEVELS)

    def one(has: Column, price: Column, size: Column) -> Column:
        return F.when(has, F.array(F.struct(price.alias("price"), size.alias("size")))).otherwise(none)

    return last.select(
        *keys,
        one(has_bid, bid, F.col("q.bid_sz")).alias("bids"),
        one(has_ask, ask, F.col("q.ask_sz")).alias("asks"),
        F.when(has_bid & has_ask, (bid + ask) / 2.0).when(has_bid, bid).otherwise(ask).alias("reference_price"),
        F.lit(basis).alias("basis"),
        F.lit(False).alias("is_synthetic"),
        (has_bid.cast("long") + has_ask.cast("long")).alias("depth"),
    )


def latest_snapshot(
    snapshots: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    tie: Sequence[str] = (),
) -> DataFrame:
    """The newest book per key."""
    newest = F.max_by(F.struct("bids", "asks", ts), F.struct(ts, *tie))
    return snapshots.groupBy(*keys).agg(newest.alias("_b")).select(*keys, "_b.*")


def slippage(
    snapshots: DataFrame,
    side: str,
    size: float,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Walk each key's latest book best-first to fill ``size``.

    One call covers many keys, so a book that cannot fill the order is reported in
    ``status`` (no_levels, exceeds_depth) with null prices. A book is one row, hence
    the walk is a fold over its levels.
    """
    side = side.lower()
    if size <= 0:
        raise ValueError("size must be greater than zero")
    if side not in ("buy", "sell"):
        raise ValueError(f"side must be 'buy' or 'sell', got {side!r}")
    book = latest_snapshot(snapshots, keys=keys, ts=ts, tie=tie)
    levels = F.array_sort(usable_levels(F.col("asks" if side == "buy" else "bids")))
    levels = levels if side == "buy" else F.reverse(levels)
    zero = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(acc: Column, level: Column) -> Column:
        part = F.least(level["size"], F.lit(float(size)) - acc["filled"])
        return F.struct(
            (acc["filled"] + part).alias("filled"),
            (acc["cost"] + part * level["price"]).alias("cost"),
        )

    walked = book.withColumn("_lv", F.coalesce(levels, F.array().cast(LEVELS))).withColumn(
        "_w", F.aggregate("_lv", zero, take)
    )
    empty = F.size("_lv") == 0
    short = F.col("_w.filled") < size
    status = F.when(empty, "no_levels").when(short, "exceeds_depth").otherwise("ok")
    ok = ~empty & ~short
    best = F.get("_lv", F.lit(0))["price"]
    expected = F.when(ok, F.col("_w.cost") / size)
    slip = expected - best if side == "buy" else best - expected
    return walked.select(
        *keys,
        F.lit(side).alias("side"),
        F.lit(float(size)).alias("size"),
        F.when(ok, best).alias("best_price"),
        expected.alias("expected_price"),
        slip.alias("slippage_usd"),
        (F.try_divide(slip, best) * 100.0).alias("slippage_pct"),
        status.alias("status"),
    )
