"""Continuous writes to the lake, with malformed frames kept aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline.session import scratch_path
from tapeline.sinks.conform import BUCKETS
from tapeline.sinks.lake import lake_write

_BROKEN = "_broken"


def decode_frames(frames: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, dead letters) of raw JSON text (local_ts, raw).

    A dead letter keeps its time, text and reason; the other rows go on.
    """
    parsed = frames.withColumn(
        "_p",
        F.from_json(
            "raw",
            f"{schema}, {_BROKEN} string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN},
        ),
    )
    broken = F.col(f"_p.{_BROKEN}").isNotNull() | F.col("_p").isNull()
    good = parsed.where(~broken).select("local_ts", "_p.*").drop(_BROKEN)
    reason = F.when(F.col("raw").isNull(), "empty frame").otherwise("malformed json")
    return good, parsed.where(broken).select("local_ts", "raw", reason.alias("error"))


def lake_write_stream(
    records: DataFrame,
    channel: str,
    root: str,
    *,
    checkpoint: str,
    every: str | None = "5 seconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append a stream to a channel; ``every=None`` drains what is there and stops.

    A micro-batch is a flush. It comes every so many seconds (``every``) or, with a bound on
    the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``), as
    often as the bound is reached.
    A micro-batch that Spark delivers again after a restart is written once: the commit
    that shows its files names it, by the checkpoint and its number. Only rows that no
    folder can hold (``_rejected``) may stand there twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            lake_write(held, channel, root, buckets=buckets, batch=(checkpoint, batch_id))
        finally:
            held.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def frames_write_stream(
    frames: DataFrame,
    schema: str,
    to_records: Callable[[DataFrame], DataFrame],
    channel: str,
    root: str,
    dead_letters: str,
    *,
    checkpoint: str,
    every: str | None = "5 seconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Decode raw frames; records go to the lake, malformed frames to a table.

    Both hold a micro-batch once: its records as ``lake_write_stream`` says, its dead
    letters in a folder of its own (``batch``), which a second delivery overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # decoded for both tables, read once
        try:
            good, bad = decode_frames(held, schema)
            bad.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
            lake_write(to_records(good), channel, root, buckets=buckets, batch=(checkpoint, batch_id))
        finally:
            held.unpersist()

    writer = frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return the written result."""
    spark: SparkSession = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
