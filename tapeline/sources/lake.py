"""Reading the lake: pruned scans, views, SQL and summaries.

Where the lake has a catalog (`sources.catalog`) files are chosen from it; only a lake
without one is listed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.timefns import date_bounds
from tapeline.schema import CHANNELS, PARTITION_COLUMNS, channel_schema
from tapeline.sources.catalog import choose, live_files

LONG_MAX = 9_223_372_036_854_775_807
# A one-row table below the lake's root; its name keeps it out of the data folders.
BUCKET_NOTE = "_buckets"
# Equal times fall into the same order in every run.
SCAN_ORDER = ["local_ts", "provider", "symbol", "source_ts"]


def _read(spark: SparkSession, root: str, schema: T.StructType, glob: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(f"{root}/{glob}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _read_layouts(
    spark: SparkSession, root: str, schema: T.StructType, channel: str, date: str
) -> DataFrame | None:
    """Files below ``bucket=`` folders and files right below ``date=`` folders."""
    base = f"provider=*/channel={channel}/date={date}"
    plain = T.StructType([f for f in schema if f.name != "bucket"])
    bucketed = _read(spark, root, schema, f"{base}/bucket=*")
    flat = _read(spark, root, plain, f"{base}/*.parquet")
    if flat is not None:
        flat = flat.withColumn("bucket", F.lit(None).cast("int")).select(*schema.names)
    found = [df.select(*schema.names) for df in (bucketed, flat) if df is not None]
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_files(spark: SparkSession, root: str, channel: str, files: DataFrame) -> DataFrame:
    """The rows of some files of the catalog. Their paths come to the driver."""
    schema = channel_schema(channel)
    found = files.select("path", F.col("bucket").isNull().alias("flat")).collect()
    parts = []
    for flat in (False, True):
        paths = [f"{root}/{r['path']}" for r in found if r["flat"] == flat]
        if paths:
            own = T.StructType([f for f in schema if not (flat and f.name == "bucket")])
            part = spark.read.schema(own).option("basePath", root).parquet(*paths)
            if flat:
                part = part.withColumn("bucket", F.lit(None).cast("int"))
            parts.append(part.select(*schema.names))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_channel(
    spark: SparkSession, root: str, channel: str, dates: Sequence[str] | None = None
) -> DataFrame:
    """A channel table with its fixed schema; no files give an empty table.

    Columns missing from older files read as null.
    """
    schema = channel_schema(channel)
    files = live_files(spark, root, channel)
    if files is not None:
        files = files if dates is None else files.where(F.col("date").isin(*dates))
        return read_files(spark, root, channel, files)
    glob = "*" if dates is None else "{" + ",".join(dates) + "}"
    df = _read_layouts(spark, root, schema, channel, glob)
    return spark.createDataFrame([], schema) if df is None else df


def dates_between(start_ns: int, end_ns: int) -> list[str] | None:
    """UTC dates of an inclusive range; none for a range without a last day."""
    import datetime as dt

    first, last = (dt.date.fromisoformat(d) for d in date_bounds(start_ns, end_ns))
    if end_ns >= LONG_MAX:
        return None
    days = (last - first).days + 1
    return [(first + dt.timedelta(days=i)).isoformat() for i in range(days)]


def bucket_count(spark: SparkSession, root: str) -> int | None:
    """The number of buckets that the lake's writer noted, if it did."""
    try:
        noted = spark.read.schema("buckets int").parquet(f"{root}/{BUCKET_NOTE}").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return noted["buckets"] if noted else None


def filter_buckets(df: DataFrame, symbols: Sequence[str], buckets: int) -> DataFrame:
    """Only the folders that can hold the symbols, and files without a bucket."""
    wanted = [F.pmod(F.hash(F.lit(s)), F.lit(buckets)) for s in symbols]
    return df.where(F.col("bucket").isin(*wanted) | F.col("bucket").isNull())


def filter_symbol_time(
    df: DataFrame, symbols: Sequence[str] | None, start_ns: int | None, end_ns: int | None
) -> DataFrame:
    """Inclusive time range of some symbols, as predicates that reach the files."""
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if start_ns is not None:
        df = df.where(F.col("local_ts") >= F.lit(start_ns))
    if end_ns is not None:
        df = df.where(F.col("local_ts") <= F.lit(min(end_ns, LONG_MAX)))
    return df


def lake_scan_many(
    spark: SparkSession,
    root: str,
    channel: str,
    symbols: Sequence[str] | None,
    start_ns: int,
    end_ns: int,
    *,
    ordered: bool = True,
) -> DataFrame:
    """One scan for any number of symbols.

    The catalog says which files can hold the symbols and times. In a lake without one
    the date range is derived from the nanosecond range, so only its folders are listed
    and read. An unknown channel raises nothing and gives no rows.
    """
    if channel not in CHANNELS:
        return spark.createDataFrame([], CHANNELS["trade"]).limit(0)
    if end_ns < start_ns:
        return spark.createDataFrame([], channel_schema(channel))
    first, last = date_bounds(start_ns, end_ns)
    files = live_files(spark, root, channel)
    if files is None:
        df = read_channel(spark, root, channel, dates_between(start_ns, end_ns))
    else:
        times = (start_ns, min(end_ns, LONG_MAX))
        df = read_files(spark, root, channel, choose(files, (first, last), times, symbols))
    if symbols is not None and (buckets := bucket_count(spark, root)):
        df = filter_buckets(df, symbols, buckets)
    df = filter_symbol_time(df.where(F.col("date").between(first, last)), symbols, start_ns, end_ns)
    return df.orderBy(*SCAN_ORDER) if ordered else df


def lake_scan(
    spark: SparkSession, root: str, channel: str, symbol: str, start_ns: int, end_ns: int
) -> DataFrame:
    return lake_scan_many(spark, root, channel, [symbol], start_ns, end_ns)


def lake_channels(spark: SparkSession, root: str) -> list[str]:
    """Channels that have files, or a folder where there is no catalog."""
    files = live_files(spark, root)
    if files is not None:
        known = {r["channel"] for r in files.select("channel").distinct().collect()}
        return sorted(known & set(CHANNELS))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/provider=*/channel=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = {str(s.getPath().getName()).split("=", 1)[1] for s in found}
    return sorted(names & set(CHANNELS))


def lake_views(spark: SparkSession, root: str, only: Sequence[str] | None = None) -> list[str]:
    """Register a temporary view per channel found; returns their names."""
    names = [c for c in lake_channels(spark, root) if only is None or c in only]
    for name in names:
        read_channel(spark, root, name).createOrReplaceTempView(name)
    return names


def lake_sql(spark: SparkSession, root: str, sql: str) -> DataFrame:
    """Run Spark SQL over the channel views, refreshed for the channels it names."""
    lake_views(spark, root, only=set(re.findall(r"\w+", sql)))
    return spark.sql(sql)


def lake_summary(spark: SparkSession, root: str) -> DataFrame:
    """Rows per channel, from the catalog, or else from folder names and file footers."""
    files = live_files(spark, root)
    if files is not None:
        return files.groupBy("channel").agg(F.sum("rows").alias("rows"))
    fields = {"provider": "string", "channel": "string", "date": "string", "bucket": "integer"}
    schema = T.StructType()
    for name in PARTITION_COLUMNS:
        schema = schema.add(name, fields[name])
    df = _read_layouts(spark, root, schema, "*", "*")
    if df is None:
        return spark.createDataFrame([], "channel string, rows long")
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"))


def lake_symbols(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """Distinct symbols; only files of very many symbols are read for them."""
    files = live_files(spark, root, channel)
    if files is None:
        return read_channel(spark, root, channel).select("symbol").distinct()
    listed = files.select(F.explode("symbols").alias("symbol"))
    unlisted = files.where("symbols IS NULL")
    if unlisted.isEmpty():
        return listed.distinct()
    return listed.union(read_files(spark, root, channel, unlisted).select("symbol")).distinct()


def lake_time_range(
    spark: SparkSession, root: str, channel: str, symbols: Sequence[str] | None = None
) -> DataFrame:
    """First and last time, from the catalog alone where no symbols are asked for.

    With symbols, files that list no other symbol count by their statistics, and the rows
    of the remaining files that may hold one are read.
    """
    first, last = F.min("local_ts").alias("first_ts"), F.max("local_ts").alias("last_ts")
    files = live_files(spark, root, channel)
    if files is None:
        return filter_symbol_time(read_channel(spark, root, channel), symbols, None, None).agg(first, last)
    if symbols is None:
        whole, rows = files, None
    else:
        wanted = F.array(*[F.lit(s) for s in symbols]).cast("array<string>")
        alone = F.col("symbols").isNotNull() & (F.size(F.array_except("symbols", wanted)) == 0)
        whole, rest = files.where(alone), choose(files, symbols=symbols).where(~alone)
        rows = filter_symbol_time(read_files(spark, root, channel, rest), symbols, None, None)
    ends = whole.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    if rows is not None:
        ends = ends.union(rows.agg(first, last))
    return ends.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
