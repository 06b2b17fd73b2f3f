"""Jobs over decoded on-chain tables: traces, balances and backing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Function selectors. Fixed values.
FLASH_LOAN_SELECTORS = (
    "0x49077656",
    "0xe00fcfbf",
    "0x5cffe9de",
    "0xab305a4e",
    "0x43b2fbe0",
    "0x0f6b45b0",
)
SWAP_SELECTORS = {"0x128acb08": "uniswap_v3", "0x022c0d9f": "uniswap_v2_or_aerodrome"}


def trace_ancestor_join(calls: DataFrame) -> DataFrame:
    """Calls to an address that is already active further up: (tx_hash, ord).

    ``calls``: tx_hash, ord (order in the trace), call_type, from_addr, to_addr, path
    ARRAY<INT>. A call's path is its entry on a tour of the tree of calls, and all it
    makes lie between that and its exit. Intervals of one tree nest or are apart, so of
    the calls to one address, sorted by entry, those before the farthest exit so far are
    active ones' descendants: one sort by (tx_hash, address, entry), linear in the calls.
    A trace lists a call before those it makes. Where one does not, the call at hand is
    looked up by the prefixes of its path. Calls of an empty path have no caller.
    """
    entry = F.array_join(F.transform("path", lambda n: F.lpad(F.hex(n), 8, "0")), "")
    live = calls.where(
        (F.coalesce("to_addr", F.lit("")) != "")
        & (F.coalesce("call_type", F.lit("")) != "staticcall")
        & F.col("path").isNotNull()
    ).select("tx_hash", "ord", F.lower("to_addr").alias("_to"), entry.alias("_entry"))
    tour = Window.partitionBy("tx_hash", "_to").orderBy("_entry", "ord")
    before = tour.rowsBetween(Window.unboundedPreceding, -1)
    # repeated paths see what their first row sees
    alike = Window.partitionBy("tx_hash", "_to", "_entry").orderBy("ord")
    alike = alike.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exits = F.concat("_entry", F.lit("~"))  # after all hexadecimal digits
    seen = live.select(
        "*", F.max(exits).over(before).alias("_exit"), F.max("ord").over(before).alias("_latest")
    ).select("*", F.first("_exit").over(alike).alias("_far"), F.first("_latest").over(alike).alias("_late"))
    below = seen.where(F.col("_far") > F.col("_entry"))
    sure = below.where(F.col("_late") < F.col("ord")).select("tx_hash", "ord")

    unsure = below.where(F.col("_late") >= F.col("ord")).select(
        "tx_hash",
        "ord",
        "_to",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.expr("length(_entry) div 8 - 1").cast("int")),
                lambda n: F.substring("_entry", F.lit(1), n * 8),
            )
        ).alias("_entry"),
    )
    firsts = live.groupBy("tx_hash", "_to", "_entry").agg(F.min("ord").alias("_first"))
    met = unsure.join(firsts, ["tx_hash", "_to", "_entry"]).where(F.col("_first") < F.col("ord"))
    return sure.union(met.select("tx_hash", "ord")).distinct()


def internal_swaps(calls: DataFrame) -> DataFrame:
    """Calls with a swap selector: (tx_hash, ord, pool, protocol, sender, selector)."""
    selector = F.lower(F.substring("input", 1, 10))
    protocol = F.lit(None).cast("string")
    for code, name in SWAP_SELECTORS.items():
        protocol = F.when(selector == code, name).otherwise(protocol)
    return calls.select(
        "tx_hash",
        "ord",
        F.col("to_addr").alias("pool"),
        protocol.alias("protocol"),
        F.col("from_addr").alias("sender"),
        selector.alias("selector"),
    ).where(F.col("protocol").isNotNull())


def trace_summary(calls: DataFrame) -> DataFrame:
    """Per transaction: flash loan seen, re-entrancy, number of internal swaps.

    The swaps themselves are the rows of ``internal_swaps``.
    """
    selector = F.lower(F.substring("input", 1, 10))
    told = calls.select(
        "tx_hash",
        F.coalesce(selector.isin(*FLASH_LOAN_SELECTORS), F.lit(False)).alias("_loan"),
        F.coalesce(selector.isin(*SWAP_SELECTORS), F.lit(False)).alias("_swap"),
        F.lit(False).alias("_again"),
    )
    none = F.lit(False)
    again = trace_ancestor_join(calls).select("tx_hash", none, none, F.lit(True))
    return told.union(again).groupBy("tx_hash").agg(
        F.bool_or("_loan").alias("flashloans"),
        F.bool_or("_again").alias("reentrancy_detected"),
        F.count_if("_swap").alias("internal_swaps"),
    )


def balance_diff_join(local: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed balances with the local ones (missing local = 0) and their difference.

    ``observed``: token_address, holder_address, raw_balance, decimals; ``local``:
    token_address, holder_address, local_balance. Holders compare in lower case.
    """
    keys = ["token_address", "_holder"]
    mine = local.select(
        "token_address", F.lower("holder_address").alias("_holder"), "local_balance"
    )
    seen = observed.withColumns(
        {
            "_holder": F.lower("holder_address"),
            "_unit": F.pow(F.lit(10.0), F.col("decimals").cast("double")),
        }
    )
    joined = seen.join(mine, keys, "left").withColumns(
        {
            "local_balance": F.coalesce("local_balance", F.lit(0.0)),
            "onchain_balance": F.col("raw_balance").cast("double") / F.col("_unit"),
            "threshold": F.lit(1.0) / F.col("_unit"),
        }
    )
    return joined.withColumn(
        "correction_amount", F.col("onchain_balance") - F.col("local_balance")
    ).drop("_holder", "_unit")


def balance_correction(local: DataFrame, observed: DataFrame) -> DataFrame:
    """Holders whose balance is off by more than one smallest unit."""
    diff = balance_diff_join(local, observed)
    return diff.where(F.abs("correction_amount") > F.col("threshold")).select(
        "token_address",
        "holder_address",
        "local_balance",
        "onchain_balance",
        "correction_amount",
    )


def backing_ratio(reserves: DataFrame, supplies: DataFrame) -> DataFrame:
    """Latest reserves over latest supply per token.

    ``reserves``: token_address, ts, raw_reserves, feed_decimals; ``supplies``:
    token_address, ts, raw_supply, token_decimals. Without supply the ratio is 1 unless
    reserves are negative.
    """

    def unit(col: str):
        return F.pow(F.lit(10.0), F.col(col).cast("double"))

    held = reserves.groupBy("token_address").agg(
        F.max_by(F.col("raw_reserves").cast("double") / unit("feed_decimals"), "ts").alias("reserves"),
        F.max("ts").alias("exchange_ts"),
    )
    issued = supplies.groupBy("token_address").agg(
        F.max_by(F.col("raw_supply").cast("double") / unit("token_decimals"), "ts").alias("total_supply")
    )
    ratio = F.when(
        F.col("total_supply") > 0, F.try_divide("reserves", "total_supply")
    ).otherwise(F.when(F.col("reserves") >= 0, 1.0).otherwise(0.0))
    return held.join(issued, "token_address").withColumns(
        {"backing_ratio": ratio, "is_backed": ratio >= 1.0}
    )
