"""Security master as tables: upserts, lookups and ticker resolution.

Symbols and tickers compare case-insensitively. Every job takes whole tables of
requests; nothing is looked up one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTER_COLUMNS = [
    "symbol",
    "ticker",
    "exchange",
    "name",
    "security_type",
    "cik",
    "figi",
    "cusip",
    "isin",
    "is_active",
    "created_at",
    "updated_at",
]
# Allowed security types. Fixed values.
SECURITY_TYPES = ("CS", "ETF", "ADR", "REIT", "PFD", "WARRANT", "UNIT", "RIGHT", "unknown")


def security_type(text: Column) -> Column:
    """The type, or ``unknown`` for anything outside the list."""
    return F.when(text.isin(*SECURITY_TYPES), text).otherwise(F.lit("unknown"))


def security_upsert(master: DataFrame, changes: DataFrame, *, seq: str | None = None) -> DataFrame:
    """The master after inserting or updating ``changes`` by symbol.

    The first spelling of a symbol and its earliest ``created_at`` stay; the other
    fields come from the newest change (by ``updated_at``, then ``seq``).
    """
    rest = [c for c in MASTER_COLUMNS if c not in ("symbol", "created_at")]
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    both = master.select(*MASTER_COLUMNS, F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_n")).unionByName(
        changes.select(*MASTER_COLUMNS, F.lit(1).alias("_new"), order.alias("_n"))
    )
    place = F.struct("_new", "updated_at", "_n")
    merged = both.groupBy(F.lower("symbol").alias("_k")).agg(
        F.min_by("symbol", place).alias("symbol"),
        F.min_by("created_at", place).alias("created_at"),
        F.max_by(F.struct(*rest), place).alias("_r"),
    )
    return merged.select("symbol", "created_at", "_r.*").select(*MASTER_COLUMNS)


def mappings_of(securities: DataFrame) -> DataFrame:
    """The ticker mapping that each registered security brings along."""
    return securities.select("ticker", "symbol", "exchange")


def mapping_add(mappings: DataFrame, added: DataFrame) -> DataFrame:
    """Insert (ticker, symbol) pairs; an existing pair takes the new exchange."""
    cols = ["ticker", "symbol", "exchange"]
    both = mappings.select(*cols, F.lit(0).alias("_new")).union(
        added.select(*cols, F.lit(1).alias("_new"))
    )
    place = F.struct(F.col("_new"), F.col("exchange"))
    merged = both.groupBy(F.lower("ticker"), F.lower("symbol")).agg(
        F.min_by(F.struct("ticker", "symbol"), place).alias("_k"),
        F.max_by(F.struct("exchange"), place).alias("_r"),
    )
    return merged.select("_k.ticker", "_k.symbol", "_r.exchange")


def mapping_remove(mappings: DataFrame, removed: DataFrame) -> DataFrame:
    """Mappings without the given (ticker, symbol) pairs."""
    gone = removed.select(F.lower("ticker").alias("_t"), F.lower("symbol").alias("_s"))
    on = (F.lower(mappings["ticker"]) == F.col("_t")) & (F.lower(mappings["symbol"]) == F.col("_s"))
    return mappings.join(gone, on, "left_anti")


def security_lookup(
    requests: DataFrame, master: DataFrame, by: str, *, ignore_case: bool | None = None
) -> DataFrame:
    """Master rows for each request value of ``by`` (symbol, figi, cusip or cik)."""
    if by not in ("symbol", "figi", "cusip", "cik"):
        raise ValueError(f"cannot look up by {by!r}")
    fold = by == "symbol" if ignore_case is None else ignore_case

    def key(col: Column) -> Column:
        return F.lower(col) if fold else col

    asked = requests.select(F.col(by).alias("request")).distinct()
    return asked.withColumn("_k", key(F.col("request"))).join(
        master.withColumn("_k", key(F.col(by))), "_k"
    ).drop("_k")


def ticker_lookup(requests: DataFrame, master: DataFrame, mappings: DataFrame) -> DataFrame:
    """Securities that ever carried a ticker.

    ``requests`` has ``ticker`` and may have ``exchange``; a given exchange must match
    that of the mapping or that of the security.
    """
    asked = requests.select(
        F.col("ticker").alias("request"),
        (F.col("exchange") if "exchange" in requests.columns else F.lit(None).cast("string")).alias(
            "_want"
        ),
    ).distinct()
    named = mappings.select(
        F.lower("ticker").alias("_t"), F.lower("symbol").alias("_s"), F.col("exchange").alias("_mx")
    )
    found = (
        asked.withColumn("_t", F.lower("request"))
        .join(named, "_t")
        .join(master.withColumn("_s", F.lower("symbol")), "_s")
        .where(
            F.col("_want").isNull()
            | (F.col("_mx") == F.col("_want"))
            | (F.col("exchange") == F.col("_want"))
        )
    )
    return found.select("request", *[c for c in master.columns]).dropDuplicates(["request", "symbol"])


def resolve_ticker(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """One symbol per (ticker, exchange) request, null when unknown.

    With an exchange, a mapping of that exchange goes before one without; other
    exchanges do not count. Ties go to the smallest symbol.
    """
    asked = requests.select("ticker", "exchange").distinct()
    # one candidate per (ticker, exchange) is enough
    named = mappings.groupBy(F.lower("ticker").alias("_t"), F.col("exchange").alias("_mx")).agg(
        F.min("symbol").alias("symbol")
    )
    fits = F.col("exchange").isNull() | F.col("_mx").isNull() | (F.col("_mx") == F.col("exchange"))
    hit = F.when(F.col("symbol").isNotNull() & fits, F.col("symbol"))
    exact = F.coalesce(F.col("exchange").isNotNull() & (F.col("_mx") == F.col("exchange")), F.lit(False))
    best = F.when(hit.isNotNull(), F.struct(~exact, hit))
    return (
        asked.withColumn("_t", F.lower("ticker"))
        .join(named, "_t", "left")
        .groupBy("ticker", "exchange")
        .agg(F.min_by(hit, best).alias("symbol"))
    )


def security_status(master: DataFrame, changes: DataFrame) -> DataFrame:
    """Set ``is_active`` from ``changes`` (symbol, is_active, updated_at).

    Changes for unknown symbols have no effect here; see ``unknown_symbols``.
    """
    newest = changes.groupBy(F.lower("symbol").alias("_k")).agg(
        F.max_by("is_active", "updated_at").alias("_active"), F.max("updated_at").alias("_at")
    )
    return (
        master.withColumn("_k", F.lower("symbol"))
        .join(newest, "_k", "left")
        .withColumns(
            {
                "is_active": F.coalesce("_active", "is_active"),
                "updated_at": F.coalesce("_at", "updated_at"),
            }
        )
        .select(*master.columns)
    )


def unknown_symbols(changes: DataFrame, master: DataFrame) -> DataFrame:
    known = master.select(F.lower("symbol").alias("_k"))
    return changes.join(known, F.lower(changes["symbol"]) == F.col("_k"), "left_anti")


def security_list(master: DataFrame, active_only: bool = True) -> DataFrame:
    return master.where("is_active") if active_only else master


def instrument_enrich(
    raw: DataFrame, known: DataFrame, master: DataFrame, mappings: DataFrame
) -> DataFrame:
    """(provider, symbol_raw) pairs to instruments.

    A known instrument of the provider wins; otherwise the ticker is resolved and the
    master row is used. Pairs found in neither stay with a null symbol.
    """
    cols = ["symbol", "security_type", "name", "exchange", "cik", "figi", "cusip"]
    pairs = raw.select("provider", "symbol_raw").distinct()
    own = known.select("provider", "symbol_raw", F.struct(*cols).alias("_own"))
    asked = pairs.select(F.col("symbol_raw").alias("ticker"), F.lit(None).cast("string").alias("exchange"))
    via = resolve_ticker(asked, mappings).select(
        F.col("ticker").alias("symbol_raw"), F.lower("symbol").alias("_s")
    )
    back = master.select(F.lower("symbol").alias("_s"), F.struct(*cols).alias("_master"))
    joined = (
        pairs.join(own, ["provider", "symbol_raw"], "left")
        .join(via, "symbol_raw", "left")
        .join(back, "_s", "left")
    )
    pick = F.coalesce("_own", "_master")
    return joined.select("provider", "symbol_raw", *[pick[c].alias(c) for c in cols])
