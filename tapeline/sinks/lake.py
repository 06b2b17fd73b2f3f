"""Writing, compacting and exporting lake tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.schema import PARTITION_COLUMNS, channel_schema
from tapeline.sinks.conform import BUCKETS, conform_channel, derive_partition_cols, is_safe
from tapeline.sources import catalog

REJECTED = "_rejected"
# Rows that an export as Arrow may bring to the driver.
ARROW_ROWS = 1_000_000
EXPORT_FORMATS = ("parquet", "csv", "arrow", "json", "jsonl")


def _write_partitions(df: DataFrame, root: str, mode: str, **options: str) -> None:
    """One shuffle by folder, with heavy folders split and light ones joined at run time.

    ``rebalance`` lets adaptive execution cut the folder of a busy symbol into several
    files of the advisory size instead of sending it to one task.
    """
    (
        df.hint("rebalance", *PARTITION_COLUMNS)
        .sortWithinPartitions(*PARTITION_COLUMNS, "symbol", "local_ts")
        .write.mode(mode)
        .partitionBy(*PARTITION_COLUMNS)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "5")
        .options(**options)
        .parquet(root)
    )


def lake_rows(df: DataFrame, channel: str, buckets: int = BUCKETS) -> DataFrame:
    """Records as rows of the channel table."""
    return conform_channel(derive_partition_cols(df, channel, buckets), channel)


def lake_write(
    df: DataFrame,
    channel: str,
    root: str,
    *,
    buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
) -> None:
    """Append records to ``root/provider=/channel=/date=/bucket=``.

    The new files are seen when their row stands in the catalog. Rows whose provider may
    not name a folder go to ``root/_rejected/<channel>``; only if there are any is the
    input computed again for them. The number of buckets is noted with the lake, so that
    scans can prune by it; a lake keeps the number it began with.

    ``batch`` names a stream and the number of its micro-batch. It enters the catalog in
    the commit that shows the files, so a batch is there once, wherever a driver stopped.
    """
    spark = df.sparkSession
    if batch and catalog.has_batch(spark, root, channel, *batch):
        return
    note_buckets(spark, root, buckets)
    if catalog.entries(spark, root) is None:
        catalog.adopt(spark, root)
    rows = lake_rows(df, channel, buckets)
    safe = is_safe(F.col("provider"))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in PARTITION_COLUMNS])
    seen = Observation()
    watched = rows.observe(
        seen, F.collect_set(F.when(safe, folder)).alias("folders"), F.count_if(~safe).alias("unsafe")
    )
    _write_partitions(watched.where(safe), root, "append")
    folders, unsafe = _observed(seen)
    added = catalog.written(spark, root, folders)
    if unsafe:
        rows.where(~safe).write.mode("append").parquet(f"{root}/{REJECTED}/{channel}")
    if added or batch:
        catalog.commit(spark, root, channel, added, batch=batch)


def _observed(seen: Observation) -> tuple[list[str], bool]:
    """Folders that got rows, and whether other rows may have been left out.

    A plan that Spark can tell to write nothing has no figures.
    """
    try:
        found = seen.get
    except Py4JJavaError:
        return [], True
    return found["folders"], found["unsafe"] > 0


def note_buckets(spark: SparkSession, root: str, buckets: int) -> None:
    from tapeline.sources.lake import BUCKET_NOTE, bucket_count

    noted = bucket_count(spark, root)
    if noted is None:
        one = spark.range(1).select(F.lit(buckets).cast("int").alias("buckets"))
        one.coalesce(1).write.mode("ignore").parquet(f"{root}/{BUCKET_NOTE}")
    elif noted != buckets:
        raise ValueError(f"the lake has {noted} buckets, not {buckets}")


def compact(spark: SparkSession, root: str, channel: str, date: str) -> None:
    """Rewrite one (channel, date) as few files, ordered by symbol and time.

    The new files lie beside the old ones until one commit of the catalog puts them in
    their place: a reader sees all old or all new files, and rows appended meanwhile stay.
    Files that an older writer left without a bucket get theirs. The old files are removed
    afterwards; after a stop before that they take up room, but no scan reads them.
    """
    from tapeline.sources.lake import bucket_count, read_files

    if catalog.entries(spark, root) is None:
        catalog.adopt(spark, root)
    files = catalog.live_files(spark, root, channel)
    if files is None:
        return
    files = files.where(F.col("date") == date)
    old = [r["path"] for r in files.select("path").collect()]
    if not old:
        return
    chosen = files.where(F.col("path").isin(*old))
    rows = read_files(spark, root, channel, chosen)
    own = F.pmod(F.hash("symbol"), F.lit(bucket_count(spark, root) or BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", F.coalesce("bucket", own))
    _write_partitions(rows.select(*channel_schema(channel).names), root, "append")
    added = catalog.written(spark, root, [f"provider=*/channel={channel}/date={date}/bucket=*"])
    catalog.commit(spark, root, channel, added, removed=old)
    _delete(spark, [f"{root}/{p}" for p in old])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as text: arrays joined with commas, structs as JSON."""

    def text(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            if isinstance(field.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
                col = F.transform(col, lambda v: F.to_json(v))
            return F.array_join(col.cast("array<string>"), ",").alias(field.name)
        if isinstance(field.dataType, (T.StructType, T.MapType)):
            return F.to_json(col).alias(field.name)
        return col

    return df.select(*[text(f) for f in df.schema.fields])


def _json_arrays(df: DataFrame) -> DataFrame:
    """Lines of text that make one JSON array of each partition."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def lines(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.compute as pc

        mark = "["
        for batch in batches:
            if batch.num_rows:
                marks = [mark] + [","] * (batch.num_rows - 1)
                text = pc.binary_join_element_wise(pa.array(marks), batch.column("value").cast("string"), "")
                yield pa.RecordBatch.from_arrays([text], names=["value"])
                mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    return rows.mapInArrow(lines, "value string")


def _write_arrow(df: DataFrame, dest: str) -> None:
    """One Arrow IPC file of a bounded result, written by the driver."""
    import pyarrow as pa
    from pyarrow import fs

    table = df.toArrow()
    system, base = fs.FileSystem.from_uri(dest) if "://" in dest else (fs.LocalFileSystem(), dest)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/part-000000.arrow") as sink:
        with pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)


def export(df: DataFrame, fmt: str, dest: str, limit: int | None = None) -> None:
    """Write a scan to a folder as parquet, csv, arrow, json (arrays) or jsonl.

    With a limit, the first rows in time order are written. Spark's writers make the files;
    only ``arrow``, for which there is none, passes through the driver and so needs a limit
    of at most ``ARROW_ROWS``.
    """
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"fmt must be one of {EXPORT_FORMATS}, got {fmt!r}")
    if fmt == "arrow" and (limit is None or limit > ARROW_ROWS):
        raise ValueError(f"arrow needs a limit of at most {ARROW_ROWS}, got {limit}")
    df = limit_rows(df, limit)
    if fmt == "parquet":
        df.write.option("compression", "zstd").option(
            "parquet.compression.codec.zstd.level", "5"
        ).parquet(dest)
    elif fmt == "csv":
        _flat(df).write.option("header", True).csv(dest)
    elif fmt == "jsonl":
        df.write.option("ignoreNullFields", False).json(dest)
    elif fmt == "json":
        _json_arrays(df).write.text(dest)
    else:
        _write_arrow(df, os.fspath(dest))


def limit_rows(df: DataFrame, limit: int | None, order: str = "local_ts") -> DataFrame:
    """The first ``limit`` rows in time order."""
    if limit is None:
        return df
    if limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    ties = [c for c in ("provider", "symbol", "source_ts") if c in df.columns and c != order]
    return df.orderBy(order, *ties).limit(limit)
