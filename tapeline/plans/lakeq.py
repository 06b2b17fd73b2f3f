"""Queries: writing, reading and exporting the lake."""

from __future__ import annotations

from pyarrow import fs, ipc
from pyspark.sql import functions as F

from tapeline.operators import lakejobs as jobs
from tapeline.plans.registry import query, r6, rnd, table
from tapeline.plans.roles import HOUR, TRADES, bucket_sql, trades
from tapeline.session import scratch_path
from tapeline.sinks import conform as cf
from tapeline.sinks import lake as out
from tapeline.sources import catalog
from tapeline.sources import lake as src
from tapeline.streaming.lake import decode_frames

DAY = 24 * HOUR
JAN_1 = 1_704_067_200 * 10**9
START, END = JAN_1 + 4 * DAY + 6 * HOUR, JAN_1 + 8 * DAY + 18 * HOUR
SYMBOLS = ["ev:7", "ev:17", "ev:27"]
_LISTED = ", ".join(f"'{s}'" for s in SYMBOLS)
_roots: dict[tuple[str, str], tuple[str, set[str]]] = {}


# a lake of this size wants few folders
FEW = 2


def feed(spark, d):
    """The events of one provider, so that a date is a handful of folders."""
    return trades(spark, d).withColumn("provider", F.lit("events"))


def quotes(spark, d):
    """A quote around every trade."""
    return feed(spark, d).select(
        "provider",
        "symbol",
        "symbol_raw",
        "local_ts",
        (F.col("price") * 0.5).alias("bid_px"),
        F.col("size").alias("bid_sz"),
        (F.col("price") * 1.5).alias("ask_px"),
        F.col("size").alias("ask_sz"),
    )


CHANNELS = {"trade": feed, "quote": quotes}


def shared_lake(spark, d, *channels):
    """Trades and quotes of the events, or the channels named, each written once per session."""
    key = (spark.sparkContext.applicationId, d)
    root, written = _roots.setdefault(key, (scratch_path(spark, "lake"), set()))
    for channel in channels or CHANNELS:
        if channel not in written:
            out.lake_write(CHANNELS[channel](spark, d), channel, root, buckets=FEW)
            written.add(channel)
    return root


@query(
    "derive_partition_cols",
    f"""WITH {TRADES} SELECT id, 'trade' AS channel, strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date,
       provider AS exchange, true AS in_range FROM trades""",
)
def derive_partition_cols(spark, d):
    t = cf.derive_partition_cols(trades(spark, d), "trade")
    return t.select("id", "channel", "date", "exchange", F.col("bucket").between(0, cf.BUCKETS - 1).alias("in_range"))


@query(
    "conform_channel",
    f"""WITH {TRADES} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN provider <> 'view' THEN {rnd('price')} END AS price, NULL::VARCHAR AS venue,
       local_ts FROM trades""",
)
def conform_channel(spark, d):
    """Text prices, some unreadable, and no venue at all."""
    t = trades(spark, d).withColumn("price", F.when(F.col("provider") == "view", "n/a").otherwise(F.col("price").cast("string")))
    return r6(out.lake_rows(t, "trade").select("id", "price", "venue", "local_ts"), "price")


@query(
    "drop_unsafe_keys",
    """SELECT o_orderkey AS id, o_orderpriority <> '4-NOT SPECIFIED' AS kept FROM orders""",
)
def drop_unsafe_keys(spark, d):
    """A priority with a space in it may not become a folder."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("provider"))
    good, bad = cf.drop_unsafe_keys(o)
    return good.select("id", F.lit(True).alias("kept")).unionByName(bad.select("id", F.lit(False).alias("kept")))


@query(
    "lake_write",
    f"""WITH {TRADES} SELECT 'events' AS provider, symbol, strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date, count(*) AS rows,
       {rnd('sum(price)')} AS total FROM trades GROUP BY 1, 2, 3""",
)
def lake_write(spark, d):
    """Write the trades and read them back."""
    root = scratch_path(spark, "write")
    out.lake_write(feed(spark, d), "trade", root, buckets=FEW)
    back = src.read_channel(spark, root, "trade")
    return r6(back.groupBy("provider", "symbol", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("total")), "total")


@query(
    "lake_scan",
    f"WITH {TRADES} SELECT CAST(id AS VARCHAR) AS id, local_ts, price, size FROM trades WHERE symbol = 'ev:17' AND local_ts BETWEEN {START} AND {END}",
)
def lake_scan(spark, d):
    df = src.lake_scan(spark, shared_lake(spark, d, "trade"), "trade", "ev:17", START, END)
    return df.select("id", "local_ts", "price", "size")


@query(
    "lake_scan_many",
    f"WITH {TRADES} SELECT symbol, CAST(id AS VARCHAR) AS id, local_ts, price FROM trades WHERE symbol IN ({_LISTED}) AND local_ts BETWEEN {START} AND {END}",
)
def lake_scan_many(spark, d):
    df = src.lake_scan_many(spark, shared_lake(spark, d, "trade"), "trade", SYMBOLS, START, END)
    return df.select("symbol", "id", "local_ts", "price")


@query(
    "partition_prune",
    f"""WITH {TRADES} SELECT strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date, count(*) AS rows
FROM trades WHERE local_ts BETWEEN {START} AND {END} GROUP BY 1""",
)
def partition_prune(spark, d):
    """Rows per date folder that a time range touches."""
    df = src.lake_scan_many(spark, shared_lake(spark, d, "trade"), "trade", None, START, END, ordered=False)
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "filter_symbol_time",
    f"WITH {TRADES} SELECT symbol, id FROM trades WHERE symbol IN ({_LISTED}) AND local_ts >= {START}",
)
def filter_symbol_time(spark, d):
    """An end beyond BIGINT means no end."""
    return src.filter_symbol_time(trades(spark, d), SYMBOLS, START, 9_999_999_999_999_999_999).select("symbol", "id")


@query(
    "lake_views",
    f"""WITH {TRADES} SELECT 'trade' AS channel, count(DISTINCT symbol) AS symbols FROM trades
UNION ALL SELECT 'quote', count(DISTINCT symbol) FROM trades""",
)
def lake_views(spark, d):
    names = src.lake_views(spark, shared_lake(spark, d))
    parts = [f"SELECT '{n}' AS channel, count(DISTINCT symbol) AS symbols FROM {n}" for n in names]
    return spark.sql(" UNION ALL ".join(parts))


@query(
    "lake_sql",
    f"""WITH {TRADES} SELECT symbol, 'events' AS provider, count(*) AS n, {rnd('max(price)')} AS top FROM trades
WHERE strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') >= '2024-01-20' GROUP BY 1 HAVING count(*) > 1""",
)
def lake_sql(spark, d):
    sql = "SELECT symbol, provider, count(*) AS n, max(price) AS top FROM trade WHERE date >= '2024-01-20' GROUP BY 1, 2 HAVING count(*) > 1"
    return r6(src.lake_sql(spark, shared_lake(spark, d), sql), "top")


@query(
    "lake_summary",
    "SELECT 'trade' AS channel, count(*) AS rows FROM events UNION ALL SELECT 'quote', count(*) FROM events",
)
def lake_summary(spark, d):
    return src.lake_summary(spark, shared_lake(spark, d))


@query("lake_symbols", f"WITH {TRADES} SELECT DISTINCT symbol FROM trades")
def lake_symbols(spark, d):
    return src.lake_symbols(spark, shared_lake(spark, d, "trade"), "trade")


@query(
    "lake_time_range",
    f"WITH {TRADES} SELECT min(local_ts) AS first_ts, max(local_ts) AS last_ts FROM trades WHERE symbol IN ({_LISTED})",
)
def lake_time_range(spark, d):
    return src.lake_time_range(spark, shared_lake(spark, d, "trade"), "trade", SYMBOLS)


@query(
    "union_files_by_name",
    f"""WITH {TRADES} SELECT symbol, count(*) AS rows, {rnd("sum(CASE WHEN provider <> 'click' THEN size END)")} AS size FROM trades GROUP BY 1""",
)
def union_files_by_name(spark, d):
    """Clicks come from an older writer without sizes and without buckets."""
    root = scratch_path(spark, "mixed")
    t = trades(spark, d).withColumn("kind", F.col("provider")).withColumn("provider", F.lit("events"))
    out.lake_write(t.where("kind <> 'click'"), "trade", root, buckets=FEW)
    old = out.lake_rows(t.where("kind = 'click'"), "trade").select(
        "symbol", "local_ts", "price", "provider", "channel", "date"
    )
    old.write.mode("append").partitionBy("provider", "channel", "date").parquet(root)
    catalog.adopt(spark, root)
    back = src.read_channel(spark, root, "trade")
    return r6(back.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")), "size")


@query(
    "compact",
    f"""WITH {TRADES} SELECT symbol, strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date, count(*) AS rows, {rnd('sum(price)')} AS total
FROM trades GROUP BY 1, 2""",
)
def compact(spark, d):
    """Two appends leave small files; compacting one date changes no row."""
    root = scratch_path(spark, "compact")
    t = feed(spark, d)
    out.lake_write(t.where("price < 40"), "trade", root, buckets=FEW)
    out.lake_write(t.where("price >= 40"), "trade", root, buckets=FEW)
    out.compact(spark, root, "trade", "2024-01-10")
    back = src.read_channel(spark, root, "trade")
    return r6(back.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("total")), "total")


@query(
    "lake_resample",
    f"""WITH {TRADES} SELECT symbol, {bucket_sql('local_ts', 6 * HOUR)} AS bar, {rnd('max(price)')} AS high, {rnd('min(price)')} AS low,
       {rnd('sum(size)')} AS volume, count(*) AS trade_count
FROM trades WHERE symbol IN ({_LISTED}) AND local_ts BETWEEN {START} AND {END} GROUP BY 1, 2""",
)
def lake_resample(spark, d):
    bars = jobs.lake_resample(spark, shared_lake(spark, d, "trade"), SYMBOLS, START, END, "6h", tie=["id"])
    return r6(bars.select("symbol", "bar", "high", "low", "volume", "trade_count"), "high", "low", "volume")


@query(
    "lake_replay",
    f"""WITH {TRADES}, t AS (SELECT * FROM trades WHERE symbol IN ({_LISTED}) AND local_ts BETWEEN {START} AND {END})
SELECT local_ts, symbol, 'trade' AS channel FROM t UNION ALL SELECT local_ts, symbol, 'quote' FROM t""",
)
def lake_replay(spark, d):
    merged = jobs.lake_replay(spark, shared_lake(spark, d), ["trade", "quote"], SYMBOLS, START, END)
    return merged.select("local_ts", "symbol", "channel")


@query(
    "lake_export",
    f"""WITH {TRADES} SELECT symbol, CAST(id AS VARCHAR) AS id, local_ts, {rnd('price')} AS price FROM trades
WHERE symbol IN ({_LISTED}) AND local_ts BETWEEN {START} AND {END}""",
)
def lake_export(spark, d):
    dest = scratch_path(spark, "lake-export")
    jobs.lake_export(spark, shared_lake(spark, d, "trade"), "trade", SYMBOLS, START, END, "parquet", dest)
    return r6(spark.read.parquet(dest).select("symbol", "id", "local_ts", "price"), "price")


@query(
    "compact_unbucketed",
    f"""WITH {TRADES} SELECT symbol, strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date, count(*) AS rows,
       CAST(count(*) FILTER (strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') <> '2024-01-10' AND price >= 40) AS BIGINT) AS unbucketed
FROM trades GROUP BY 1, 2""",
)
def compact_unbucketed(spark, d):
    """High prices come from a writer without buckets; one date is compacted, twice."""
    root = scratch_path(spark, "flat")
    t = feed(spark, d)
    out.lake_write(t.where("price < 40"), "trade", root, buckets=FEW)
    old = out.lake_rows(t.where("price >= 40"), "trade").drop("bucket", "exchange")
    old.write.mode("append").partitionBy("provider", "channel", "date").parquet(root)
    catalog.adopt(spark, root)
    for _ in range(2):
        out.compact(spark, root, "trade", "2024-01-10")
    flat = F.count(F.when(F.col("bucket").isNull(), 1))
    return src.read_channel(spark, root, "trade").groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"), flat.alias("unbucketed"))


@query(
    "export",
    f"""WITH {TRADES}, e AS (SELECT symbol, count(*) AS rows, {rnd('sum(price * 0.5)', 4)} AS total FROM trades GROUP BY 1)
SELECT f.fmt, e.* FROM e, (VALUES ('parquet'), ('csv'), ('json'), ('jsonl')) f(fmt)""",
)
def export(spark, d):
    """The quotes in every format that Spark can read back."""
    q = src.read_channel(spark, shared_lake(spark, d, "quote"), "quote")
    schema = q.schema
    parts = []
    for fmt in ("parquet", "csv", "json", "jsonl"):
        dest = scratch_path(spark, f"export-{fmt}")
        out.export(q, fmt, dest)
        if fmt == "parquet":
            back = spark.read.parquet(dest)
        elif fmt == "csv":
            back = spark.read.option("header", True).csv(dest).withColumn("bid_px", F.col("bid_px").cast("double"))
        else:
            back = spark.read.schema(schema).option("multiLine", fmt == "json").json(dest)
        grouped = back.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("bid_px").alias("total"))
        parts.append(grouped.withColumn("fmt", F.lit(fmt)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return r6(both, "total", digits=4)


@query(
    "export_arrow",
    f"""WITH {TRADES} SELECT symbol, CAST(id AS VARCHAR) AS id, local_ts, {rnd('price')} AS price FROM trades
WHERE symbol IN ({_LISTED}) AND local_ts BETWEEN {START} AND {END}""",
)
def export_arrow(spark, d):
    """A range of trades as one Arrow file, read back."""
    dest = scratch_path(spark, "export-arrow")
    jobs.lake_export(spark, shared_lake(spark, d, "trade"), "trade", SYMBOLS, START, END, "arrow", dest, limit=out.ARROW_ROWS)
    system, base = fs.FileSystem.from_uri(dest) if "://" in dest else (fs.LocalFileSystem(), dest)
    with system.open_input_file(f"{base}/part-000000.arrow") as source:
        rows = ipc.open_file(source).read_all()
    back = spark.createDataFrame(rows.select(["symbol", "id", "local_ts", "price"]))
    return r6(back, "price")


@query(
    "dead_letter",
    """SELECT event_id AS id, event_type = 'error' AS broken FROM events""",
)
def dead_letter(spark, d):
    """Frames of failed events lose their last brace; the others decode."""
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("value").alias("price")))
    cut = F.when(F.col("event_type") == "error", F.left(whole, F.length(whole) - 1)).otherwise(whole)
    raw = table(spark, d, "events").select(F.lit(0).cast("long").alias("local_ts"), cut.alias("raw"))
    good, bad = decode_frames(raw, "id long, price double")
    found = F.regexp_extract("raw", r'"id":(\d+)', 1).cast("long")
    return good.select("id", F.lit(False).alias("broken")).unionByName(
        bad.select(found.alias("id"), F.lit(True).alias("broken"))
    )
