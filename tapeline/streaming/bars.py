"""Live bars, de-duplication and late-row accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.timefns import DAY, MONDAY_ORIGIN, micros_to_ns, parse_interval, ts_from_ns
from tapeline.operators.resample import QUOTE_PRICES

KINDS = ("trade", "quote", "bar")


def _aggregates(kind: str, ts: str, tie: Sequence[str], price_type: str) -> list[Column]:
    moment = F.struct(ts, *tie)
    if kind == "bar":
        vwap, volume = F.coalesce("vwap", "close"), F.col("volume")
        return [
            F.min_by("open", moment).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", moment).alias("close"),
            F.sum(volume).alias("volume"),
            F.try_divide(F.sum(vwap * volume), F.sum(volume)).alias("vwap"),
            F.sum(F.coalesce("trade_count", F.lit(1)).cast("long")).alias("trade_count"),
        ]
    price = QUOTE_PRICES[price_type]() if kind == "quote" else F.col("price")
    if kind == "quote":
        volume, vwap = F.lit(0.0), F.avg(price)
    else:
        volume = F.sum("size")
        vwap = F.try_divide(F.sum(price * F.col("size")), F.sum("size"))
    return [
        F.min_by(price, moment).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, moment).alias("close"),
        volume.alias("volume"),
        vwap.alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    ]


def stream_bars(
    records: DataFrame,
    interval: str,
    *,
    kind: str = "trade",
    price_type: str = "mid",
    keys: Sequence[str] = ("symbol",),
    ts: str = "local_ts",
    tie: Sequence[str] = (),
    delay: str | None = None,
) -> DataFrame:
    """Bars of a stream, each emitted once the watermark has passed its end.

    Rows later than ``delay`` (one interval by default) are dropped; Spark counts them
    in the query's progress. Use output mode append.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    width = parse_interval(interval)
    # windows start on Mondays as batch buckets do
    shift = MONDAY_ORIGIN % width if width > DAY or DAY % width else 0
    window = F.window("_t", f"{width // 1000} microseconds", startTime=f"{shift // 1000} microseconds")
    bars = (
        records.withColumn("_t", ts_from_ns(F.col(ts)))
        .withWatermark("_t", delay or f"{width // 1000} microseconds")
        .groupBy(*keys, window.alias("_w"))
        .agg(*_aggregates(kind, ts, tie, price_type))
    )
    return bars.select(
        *keys,
        micros_to_ns(F.col("_w.start")).alias("bar"),
        F.lit(interval.strip().lower()).alias("interval"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "vwap",
        "trade_count",
    )


def closing_bars(records: DataFrame, interval: str, *, ts: str = "local_ts", delay: str | None = None, **options) -> DataFrame:
    """Bars that a bounded stream leaves open when its source ends.

    ``records`` is the same source read as a table. A stream emits a bar once the newest
    row is ``delay`` past its end; this gives the other bars, from their rows alone, so
    that both together are complete but for rows that came later than ``delay``: the
    stream left them out of bars it had closed (``streaming.order.late_rows`` tells late
    rows apart).
    """
    width = parse_interval(interval)
    wait = F.expr(f"INTERVAL {delay}") if delay else F.expr(f"INTERVAL {width // 1000} MICROSECONDS")
    newest = records.agg(F.max(ts).alias("_n")).select((ts_from_ns(F.col("_n")) - wait).alias("_mark"))
    shift = MONDAY_ORIGIN % width if width > DAY or DAY % width else 0
    window = F.window("_t", f"{width // 1000} microseconds", startTime=f"{shift // 1000} microseconds")
    timed = records.withColumn("_t", ts_from_ns(F.col(ts))).withColumn("_end", window["end"])
    # one row on the right: the mark that the stream's watermark ended at
    open_rows = timed.join(F.broadcast(newest), F.col("_end") > F.col("_mark")).select(*records.columns)
    return stream_bars(open_rows, interval, ts=ts, delay=delay, **options)


def stream_dedup(
    records: DataFrame,
    *,
    keys: Sequence[str] = ("tx_hash", "log_index"),
    ts: str = "local_ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Each key once; state is kept as long as a repeat can arrive (``delay``)."""
    timed = records.withColumn("_t", ts_from_ns(F.col(ts))).withWatermark("_t", delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_t")
