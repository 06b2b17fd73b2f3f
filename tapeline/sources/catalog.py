"""A lake's files: one row of statistics each, by which scans choose what to read.

``root/_files/channel=<channel>`` holds commits, one Parquet file each, so a commit is
there whole or not at all. A row adds a file (path below the root, provider, date, bucket,
rows, first and last time, symbols), removes one, or notes a stream's micro-batch whose
files the same commit adds (stream as path, number of the batch as rows). Up to ``LISTED`` symbols are listed; a
file of more has a Bloom filter alone: ``HASHES`` positions a symbol in ``BITS`` bits.

A lake that has a catalog is read through it, and no folder is listed. Files that another
writer put there are seen after ``adopt``; the first write to a lake without a catalog
adopts what it holds. Files that a stop left between a write and its commit are not seen,
also after a second try; only ``adopt`` cannot tell them from another writer's. Two writers
must not write to the same folder at the same time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "_files"
LISTED = 256
# What one bitmap of Spark's holds.
BITS = 32_768
HASHES = 3
_STATS = "rows long, first_ts long, last_ts long, symbols array<string>, bloom binary"
SCHEMA = f"op string, path string, provider string, date string, bucket int, {_STATS}, channel string"


def entries(spark: SparkSession, root: str, channel: str | None = None) -> DataFrame | None:
    """All rows of the catalog, or of one channel's; None for a lake without one."""
    try:
        found = spark.read.schema(SCHEMA).parquet(f"{root}/{FILES}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found if channel is None else found.where(F.col("channel") == channel)


def live_files(spark: SparkSession, root: str, channel: str | None = None) -> DataFrame | None:
    """The files that hold the lake's rows now."""
    found = entries(spark, root, channel)
    if found is None:
        return None
    removed = found.where("op = 'remove'").select("path")
    return found.where("op = 'add'").dropDuplicates(["path"]).join(removed, "path", "left_anti")


def has_batch(spark: SparkSession, root: str, channel: str, stream: str, number: int) -> bool:
    """Whether a stream's micro-batch, or a later one, stands in the catalog."""
    found = entries(spark, root, channel)
    if found is None:
        return False
    return not found.where((F.col("op") == "batch") & (F.col("path") == stream) & (F.col("rows") >= number)).isEmpty()


def _bits(symbol: Column) -> Column:
    return F.transform(
        F.array(*[F.lit(k) for k in range(HASHES)]), lambda k: F.pmod(F.xxhash64(symbol, k), F.lit(BITS))
    )


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    byte = F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1)))
    mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (position % 8 + 1).cast("int"))
    return F.conv(byte, 16, 10).cast("int").bitwiseAND(mask) > 0


def may_hold(symbols: Sequence[str]) -> Column:
    """Whether a file can have rows of any of the symbols."""
    wanted = F.array(*[F.lit(s) for s in symbols]).cast("array<string>")
    in_bloom = F.exists(wanted, lambda s: F.forall(_bits(s), lambda p: _bit_is_set(F.col("bloom"), p)))
    return F.when(F.col("symbols").isNotNull(), F.arrays_overlap("symbols", wanted)).otherwise(in_bloom)


def choose(
    files: DataFrame,
    dates: tuple[str, str] | None = None,
    times: tuple[int, int] | None = None,
    symbols: Sequence[str] | None = None,
) -> DataFrame:
    """Files that can hold rows of some dates, times (both inclusive) and symbols."""
    if dates is not None:
        files = files.where(F.col("date").between(*dates))
    if times is not None:
        files = files.where((F.col("first_ts") <= times[1]) & (F.col("last_ts") >= times[0]))
    return files if symbols is None else files.where(may_hold(symbols))


def statistics(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Rows that add the files at ``paths`` (below the root). Reads two columns of them."""
    rows = spark.read.schema("symbol string, local_ts long").parquet(*[f"{root}/{p}" for p in paths])
    # Spark gives paths as encoded URIs, in which a plus is a plus
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_extract(path, "(provider=[^/]*/channel=.*)$", 1)
    per_symbol = rows.groupBy(path.alias("path"), "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("local_ts").alias("first_ts"), F.max("local_ts").alias("last_ts")
    )
    # every symbol gives a row for each of its bits; the first one carries its counts
    spread = per_symbol.select("*", F.posexplode(_bits(F.col("symbol"))).alias("k", "bit"))
    first = F.col("k") == 0
    found = spread.groupBy("path").agg(
        F.sum(F.when(first, F.col("rows"))).alias("rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.collect_list(F.when(first, F.col("symbol"))).alias("symbols"),
        F.bitmap_construct_agg("bit").alias("bloom"),
    )
    few = F.size("symbols") <= LISTED
    return found.select(
        F.lit("add").alias("op"),
        "path",
        *[F.regexp_extract("path", f"{c}=([^/]*)/", 1).alias(c) for c in ("provider", "date")],
        F.regexp_extract("path", "bucket=([0-9]+)/", 1).try_cast("int").alias("bucket"),
        "rows",
        "first_ts",
        "last_ts",
        F.when(few, F.col("symbols")).alias("symbols"),
        F.when(~few, F.col("bloom")).alias("bloom"),
    )


def commit(
    spark: SparkSession,
    root: str,
    channel: str,
    added: Sequence[str],
    removed: Iterable[str] = (),
    batch: tuple[str, int] | None = None,
) -> None:
    """Add and remove files of a channel in one step; ``batch`` names the stream and number
    of the micro-batch they come from."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")][:-1]
    changes = [("remove", p, None) for p in removed] + ([("batch", *batch)] if batch else [])
    rows = spark.createDataFrame(changes, "op string, path string, rows long")
    if added:
        rows = rows.unionByName(statistics(spark, root, added), allowMissingColumns=True)
    else:
        empty = spark.createDataFrame([], SCHEMA)
        rows = rows.unionByName(empty.drop("channel"), allowMissingColumns=True)
    # one file, which appears by one rename
    rows.select(*columns).repartition(1).write.mode("append").parquet(f"{root}/{FILES}/channel={channel}")


def _below(uri: str) -> str:
    """The part of a file's URI below the lake's root."""
    return unquote(uri[uri.rindex("/provider=") + 1 :])


def written(spark: SparkSession, root: str, folders: Sequence[str]) -> list[str]:
    """Files of the last write to some folders (or globs of them), by their paths.

    All files of a write have its number in their names, and the last write has the newest
    one. Those of a write that stopped before its commit are older, so that a second try
    leaves them out.
    """
    if not folders:
        return []
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet")
    path = F.regexp_extract("path", "(provider=[^/]*/channel=.*)$", 1)
    found = listed.load([f"{root}/{f}" for f in folders]).select(
        path.alias("path"),
        F.regexp_extract("path", "/part-[0-9]+-([0-9a-f-]{36})", 1).alias("write"),
        "modificationTime",
    )
    files = found.collect()
    newest = max(files, key=lambda r: r["modificationTime"])["write"]
    return sorted(r["path"] for r in files if r["write"] == newest)


def adopt(spark: SparkSession, root: str) -> None:
    """Take in all files that the catalog does not know. Lists the whole lake once."""
    found: dict[str, set[str]] = {}
    for glob in ("date=*/bucket=*", "date=*/*.parquet"):
        try:
            reader = spark.read.schema("local_ts long")
            paths = reader.parquet(f"{root}/provider=*/channel=*/{glob}").inputFiles()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        for path in paths:
            below = _below(path)
            found.setdefault(below.split("/")[1].removeprefix("channel="), set()).add(below)
    for channel, paths in found.items():
        known = entries(spark, root, channel)
        if known is not None:
            paths -= {r["path"] for r in known.select("path").collect()}
        if paths:
            commit(spark, root, channel, sorted(paths))


def fold(spark: SparkSession, root: str, channel: str) -> None:
    """Write a channel's commits anew as one.

    The new commit repeats the rows of live files and the last batch of each stream. The
    old ones go from the oldest on, so that a file's removal never goes before its addition.
    """
    folder = f"{root}/{FILES}/channel={channel}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted((s.getModificationTime(), str(s.getPath())) for s in system.listStatus(path))
    old = [name for _, name in old if name.endswith(".parquet")]
    live = live_files(spark, root, channel).drop("channel")
    streams = entries(spark, root, channel).where("op = 'batch'")
    streams = streams.groupBy("op", "path").agg(F.max("rows").alias("rows"))
    live = live.unionByName(streams, allowMissingColumns=True)
    live.repartition(1).write.mode("append").parquet(folder)
    for name in old:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
