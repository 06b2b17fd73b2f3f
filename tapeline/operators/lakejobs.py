"""Jobs over the lake by channel, symbols and time range.

Each starts from one pruned scan: dates and buckets are partition filters, symbols and
times reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tapeline.operators.replay import replay_merge
from tapeline.operators.resample import bars_from_quotes, bars_rollup, ohlcv_trades
from tapeline.sinks.lake import export
from tapeline.sources.lake import lake_scan_many

BAR_CHANNELS = ("bar", "ohlcv")


def lake_resample(
    spark: SparkSession,
    root: str,
    symbols: Sequence[str] | None,
    start_ns: int,
    end_ns: int,
    interval: str,
    *,
    channel: str = "trade",
    **options,
) -> DataFrame:
    """Bars of stored trades, quotes or finer bars; ``options`` go to the bar function."""
    rows = lake_scan_many(spark, root, channel, symbols, start_ns, end_ns, ordered=False)
    if channel == "trade":
        return ohlcv_trades(rows, interval, **options)
    if channel == "quote":
        return bars_from_quotes(rows, interval, **options)
    if channel in BAR_CHANNELS:
        return bars_rollup(rows, interval, **options)
    raise ValueError(f"cannot make bars of channel {channel!r}")


def lake_replay(
    spark: SparkSession,
    root: str,
    channels: Sequence[str],
    symbols: Sequence[str] | None,
    start_ns: int,
    end_ns: int,
) -> DataFrame:
    """The stored records of some channels as one stream in replay order."""
    return replay_merge(
        {c: lake_scan_many(spark, root, c, symbols, start_ns, end_ns, ordered=False) for c in channels}
    )


def lake_export(
    spark: SparkSession,
    root: str,
    channel: str,
    symbols: Sequence[str] | None,
    start_ns: int,
    end_ns: int,
    fmt: str,
    dest: str,
    limit: int | None = None,
) -> None:
    """Write a range of a channel to a folder, see ``sinks.lake.export``."""
    rows = lake_scan_many(spark, root, channel, symbols, start_ns, end_ns, ordered=limit is None)
    export(rows, fmt, dest, limit)
