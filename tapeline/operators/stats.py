"""Ingest statistics per (symbol, channel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.ratios import ieee_ratio


def value_projection(columns: Sequence[str]) -> Column:
    """A record's value: trade price, quote mid or bar close; null for other channels."""
    value = F.lit(None).cast("double")
    if "close" in columns:
        value = F.when(F.col("channel") == "bar", F.col("close")).otherwise(value)
    if "bid_px" in columns and "ask_px" in columns:
        mid = (F.col("bid_px") + F.col("ask_px")) / 2.0
        value = F.when(F.col("channel") == "quote", mid).otherwise(value)
    if "price" in columns:
        value = F.when(F.col("channel") == "trade", F.col("price")).otherwise(value)
    return value


def ingest_stats(
    records: DataFrame,
    *,
    order: Sequence[str] = ("local_ts",),
    last_n: int = 30,
    keys: Sequence[str] = ("symbol", "channel"),
    ieee: bool = False,
) -> DataFrame:
    """Count, last value, the last ``last_n`` values and their change, and rows per second.

    The change from a value of zero is null, or with ``ieee`` an infinity or NaN.

    The last values are a top-n per key, which Spark limits per map task before the
    shuffle; everything else is a partial aggregate.
    """
    value = value_projection(records.columns)
    valued = records.select(*keys, *order, value.alias("value"))
    place = F.struct(*order)
    totals = valued.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.max_by("value", F.when(F.col("value").isNotNull(), place)).alias("last_value"),
        F.min("local_ts").alias("first_ts"),
        F.max("local_ts").alias("last_ts"),
    )
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    recent = (
        valued.where(F.col("value").isNotNull())
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= last_n)
        .groupBy(*keys)
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("_r", "value")))).alias("_v"))
        .select(*keys, F.transform("_v", lambda v: v["value"]).alias("last_values"))
    )
    first, last = F.get("last_values", F.lit(0)), F.col("last_value")
    divide = ieee_ratio if ieee else F.try_divide
    seconds = (F.col("last_ts") - F.col("first_ts")) / 1e9
    return totals.join(recent, list(keys), "left").select(
        *keys,
        "count",
        "last_value",
        "last_values",
        (divide(last - first, first) * 100.0).alias("change_pct"),
        F.try_divide(F.col("count"), seconds).alias("rows_per_second"),
    )
