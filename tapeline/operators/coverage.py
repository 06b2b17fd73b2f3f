"""Several providers for the same (symbol, time): pick or merge by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank(provider: str, priority: Sequence[str]) -> Column:
    """Position in the list; unlisted providers share the place after it."""
    rank = F.lit(len(priority))
    for place, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col(provider) == name, place).otherwise(rank)
    return rank


def _checked(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def resolve_coverage(
    records: DataFrame,
    priority: Sequence[str],
    strategy: str = "priority",
    *,
    symbol: str = "symbol",
    ts: str = "local_ts",
    provider: str = "provider",
) -> DataFrame:
    """One row per (symbol, time).

    ``priority`` takes the best provider's row; ``fill_nulls`` also fills its null
    fields from the next providers. Equal ranks go by provider name. Both are
    aggregates with a map-side part, so copies of one record never gather in one task.
    """
    _checked(records, symbol, ts, provider)
    place = F.struct(_rank(provider, priority), F.col(provider))
    rest = [c for c in records.columns if c not in (symbol, ts)]
    if strategy == "priority":
        best = records.groupBy(symbol, ts).agg(F.min_by(F.struct(*rest), place).alias("_r"))
        return best.select(symbol, ts, "_r.*").select(*records.columns)
    if strategy == "fill_nulls":
        merged = [
            F.min_by(F.col(c), F.when(F.col(c).isNotNull() | F.lit(c == provider), place)).alias(c)
            for c in rest
        ]
        return records.groupBy(symbol, ts).agg(*merged).select(*records.columns)
    raise ValueError(f"strategy must be 'priority' or 'fill_nulls', got {strategy!r}")


def coverage_priority(records: DataFrame, priority: Sequence[str], **columns) -> DataFrame:
    return resolve_coverage(records, priority, "priority", **columns)


def coverage_fill_nulls(records: DataFrame, priority: Sequence[str], **columns) -> DataFrame:
    return resolve_coverage(records, priority, "fill_nulls", **columns)
