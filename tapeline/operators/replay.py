"""One time-ordered stream out of many channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sequence field of the channels that have one. Fixed values.
SEQUENCE_FIELDS = {"book_delta": "seq_id", "book_snapshot": "sequence_id"}
REPLAY_KEY = ["local_ts", "source_ts", "seq", "provider", "symbol"]


def replay_rows(channel: str, df: DataFrame) -> DataFrame:
    """Replay key, channel tag and the record as JSON text."""
    seq: Column = F.lit(0).cast("long")
    if channel in SEQUENCE_FIELDS:
        seq = F.coalesce(F.col(SEQUENCE_FIELDS[channel]), F.lit(0).cast("long"))
    source = (
        F.coalesce(F.col("source_ts"), F.lit(-1).cast("long"))
        if "source_ts" in df.columns
        else F.lit(-1).cast("long")
    )
    return df.select(
        "local_ts",
        source.alias("source_ts"),
        seq.alias("seq"),
        "provider",
        "symbol",
        F.lit(channel).alias("channel"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
        F.xxhash64(*df.columns).alias("_tie"),
    )


def replay_merge(
    channels: dict[str, DataFrame],
    *,
    start_ns: int | None = None,
    end_ns: int | None = None,
    symbols: list[str] | None = None,
) -> DataFrame:
    """All records of the channels in replay order.

    Order: local_ts, source_ts (missing first), sequence, provider, symbol. The range
    is inclusive. The sort is one range-partitioned exchange on the whole key, so a
    busy symbol is spread; read partitions in order to consume it.
    """
    parts = []
    for channel, df in channels.items():
        if start_ns is not None:
            df = df.where(F.col("local_ts") >= start_ns)
        if end_ns is not None:
            df = df.where(F.col("local_ts") <= end_ns)
        if symbols is not None:
            df = df.where(F.col("symbol").isin(*symbols))
        parts.append(replay_rows(channel, df))
    merged = reduce(DataFrame.unionByName, parts)
    # a hash of the record settles full ties; the payload itself takes no part in the sort
    return merged.orderBy(*REPLAY_KEY, "channel", "_tie").drop("_tie")
