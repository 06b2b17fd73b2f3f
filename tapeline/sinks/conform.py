"""Rows of any shape to the exact layout of a channel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.timefns import date_from_ns
from tapeline.schema import DEFAULTS, LEVELS, RENAMES, channel_schema

BUCKETS = 128
# Text that may become a folder name. Fixed value.
SAFE_KEY = r"^[A-Za-z0-9._-]+$"


def derive_partition_cols(df: DataFrame, channel: str, buckets: int = BUCKETS) -> DataFrame:
    """Add channel, date, bucket and exchange; rename the fields that clash with them.

    A small lake wants fewer buckets: every (provider, date, bucket) is a folder.
    """
    if channel in RENAMES:
        record_name, table_name = RENAMES[channel]
        if record_name in df.columns and table_name not in df.columns:
            df = df.withColumnRenamed(record_name, table_name)
    return df.withColumns(
        {
            "channel": F.lit(channel),
            "date": date_from_ns(F.col("local_ts")),
            "bucket": F.pmod(F.hash("symbol"), F.lit(buckets)).cast("int"),
            "exchange": F.col("provider"),
        }
    )


def _levels(df: DataFrame, name: str) -> Column:
    """Levels as (price, size); ``amount`` stands in for a missing size."""
    element = df.schema[name].dataType.elementType
    if not isinstance(element, T.StructType):  # [price, size] pairs
        return F.transform(
            name,
            lambda v: F.struct(
                F.get(v, F.lit(0)).cast("double").alias("price"),
                F.coalesce(F.get(v, F.lit(1)).cast("double"), F.lit(0.0)).alias("size"),
            ),
        )
    size_field = "size" if "size" in element.names else "amount"
    return F.transform(
        name,
        lambda v: F.struct(
            v["price"].cast("double").alias("price"),
            F.coalesce(v[size_field].cast("double"), F.lit(0.0)).alias("size"),
        ),
    )


def conform_channel(df: DataFrame, channel: str) -> DataFrame:
    """Cast, null-fill and reorder to the channel schema; other columns are dropped.

    Values that do not fit their type become null.
    """
    defaults = DEFAULTS.get(channel, {})
    out = []
    for field in channel_schema(channel):
        name = field.name
        if name not in df.columns:
            col = F.lit(defaults.get(name)).cast(field.dataType)
        elif field.dataType == LEVELS:
            col = F.coalesce(_levels(df, name), F.array().cast(LEVELS))
        elif df.schema[name].dataType == field.dataType:
            col = F.col(name)
        else:
            col = F.col(name).try_cast(field.dataType)
        if name in df.columns and name in defaults:
            col = F.coalesce(col, F.lit(defaults[name]))
        out.append(col.alias(name))
    return df.select(*out)


def is_safe(name: Column) -> Column:
    """Whether a text may name a folder."""
    return F.coalesce(name.rlike(SAFE_KEY) & ~name.isin(".", ".."), F.lit(False))


def drop_unsafe_keys(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose provider may be a folder name, the rest)."""
    safe = is_safe(F.col("provider"))
    return df.where(safe), df.where(~safe)
