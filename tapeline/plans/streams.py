"""Queries: streaming jobs, drained over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.plans.books import REBUILT, book_table
from tapeline.plans.market import BAR_DOUBLES
from tapeline.plans.registry import query, r6, rnd
from tapeline.plans.roles import FILLS, HOUR, TRADES, bucket_sql
from tapeline.session import materialize, scratch_path
from tapeline.sources.lake import read_channel
from tapeline.streaming import bars as sb
from tapeline.streaming import books as bk
from tapeline.streaming.lake import drain, lake_write_stream
from tapeline.streaming.order import late_rows
from tapeline.streaming.totals import LiveTotals, watch_totals
from tapeline.plans import roles

WEEK = 168 * HOUR


class _Stream:
    """Lets the role functions read a table as a stream."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path):
        folder, name = path.rsplit("/", 1)
        schema = self.spark.read.parquet(path).schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", name)
        return reader.option("maxFilesPerTrigger", 8).parquet(folder)


def trade_stream(spark, d):
    return roles.trades(_Stream(spark), d)


def quote_stream(spark, d):
    return roles.fills(_Stream(spark), d)


def _bars(source: str, price: str, width: int, label: str, tie: str, volume: str, vwap: str) -> str:
    bar = bucket_sql("local_ts", width)
    return f"""SELECT symbol, {bar} AS bar, '{label}' AS interval, {rnd(f'first({price} ORDER BY local_ts, {tie})')} AS open,
       {rnd(f'max({price})')} AS high, {rnd(f'min({price})')} AS low, {rnd(f'last({price} ORDER BY local_ts, {tie})')} AS close,
       {rnd(volume)} AS volume, {rnd(vwap)} AS vwap, count(*) AS trade_count
FROM {source} GROUP BY symbol, {bar}"""


@query(
    "stream_bars",
    f"WITH {TRADES} {_bars('trades', 'price', HOUR, '1h', 'id', 'sum(size)', 'sum(price * size) / sum(size)')}",
)
def stream_bars(spark, d):
    """The bars that the stream emits and those that its end leaves open."""
    live = drain(sb.stream_bars(trade_stream(spark, d), "1h", tie=["id"]), "bars")
    rest = sb.closing_bars(roles.trades(spark, d), "1h", tie=["id"])
    return r6(live.unionByName(rest), *BAR_DOUBLES)


@query(
    "stream_bars_quotes",
    f"""WITH {FILLS}, q AS (SELECT *, (bid_px + ask_px) / 2 AS px FROM fills)
{_bars('q', 'px', WEEK, '1w', 'id, bid_px, ask_px', '0.0::DOUBLE', 'avg(px)')}""",
)
def stream_bars_quotes(spark, d):
    how = {"kind": "quote", "tie": ["id", "bid_px", "ask_px"]}
    live = drain(sb.stream_bars(quote_stream(spark, d), "1w", **how), "quote-bars")
    rest = sb.closing_bars(roles.fills(spark, d), "1w", **how)
    return r6(live.unionByName(rest), *BAR_DOUBLES)


@query("stream_dedup", "SELECT event_id AS id, event_type AS provider FROM events")
def stream_dedup(spark, d):
    """Every message is delivered twice."""
    twice = trade_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(sb.stream_dedup(twice, keys=["id"]).select("id", "provider"), "dedup")


@query(
    "lake_write_stream",
    f"""WITH {TRADES} SELECT symbol, strftime(make_timestamp(local_ts // 1000), '%Y-%m-%d') AS date, count(*) AS rows FROM trades GROUP BY 1, 2""",
)
def lake_stream(spark, d):
    root = scratch_path(spark, "live")
    writer = lake_write_stream(
        trade_stream(spark, d).withColumn("provider", F.lit("events")),
        "trade",
        root,
        checkpoint=scratch_path(spark, "live-state"),
        every=None,
        buckets=2,
    )
    writer.awaitTermination()
    return read_channel(spark, root, "trade").groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"))


def feeds(spark, d):
    """Feeds of a hundred consecutive messages each, with the ``error`` messages lost."""
    lost = trade_stream(spark, d).where("provider <> 'error'")
    feed = F.concat(F.lit("feed:"), F.floor(F.col("id") / 100).cast("string"))
    return lost.withColumn("symbol", feed).withColumn("ord", F.col("id"))


FEEDS = f"""{TRADES}, feeds AS (
  SELECT 'feed:' || (id // 100) AS symbol, id, provider, provider = 'signup' AS snap,
         max(CASE WHEN provider = 'signup' THEN id END) OVER (PARTITION BY id // 100 ORDER BY id) AS sid
  FROM trades WHERE provider <> 'error'),
synced AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, sid ORDER BY id) - 1 AS place FROM feeds)"""


def depth_events(spark, d):
    return feeds(spark, d).select(
        "symbol",
        "ord",
        (F.col("provider") == "signup").alias("is_snapshot"),
        F.col("id").alias("first_id"),
        F.col("id").alias("final_id"),
        (F.col("id") - 1).alias("prev_id"),
    )


@query(
    "book_sync",
    f"""WITH {FEEDS} SELECT symbol, id AS ord, CASE WHEN sid IS NULL THEN 'DROP' WHEN id - sid = place THEN 'APPLY' ELSE 'RESYNC' END AS action
FROM synced WHERE NOT snap""",
)
def book_sync(spark, d):
    return drain(bk.book_sync(depth_events(spark, d), "spot"), "sync")


@query(
    "book_sync_futures",
    f"""WITH {FEEDS} SELECT symbol, id AS ord, CASE WHEN sid IS NULL THEN 'DROP' WHEN id - sid = place THEN 'APPLY' ELSE 'RESYNC' END AS action
FROM synced WHERE NOT snap""",
)
def book_sync_futures(spark, d):
    """Deltas of three ids each; a snapshot's number lies within the delta after it."""
    snap, n = F.col("provider") == "signup", 3 * F.col("id")
    events = feeds(spark, d).select(
        "symbol",
        "ord",
        snap.alias("is_snapshot"),
        n.alias("first_id"),
        F.when(snap, n + 4).otherwise(n + 2).alias("final_id"),
        (n - 1).alias("prev_id"),
    )
    return drain(bk.book_sync(events, "futures"), "sync-futures")


RESYNC_BUFFER = 3


@query(
    "book_resync",
    f"""WITH {TRADES}, feeds AS (
  SELECT 'feed:' || (id // 100) AS symbol, id, provider = 'signup' AS snap, id % 4 AS late FROM trades WHERE provider <> 'error'),
parts AS (  -- part k of a feed follows its k-th snapshot and ends with the next
  SELECT *, coalesce(sum(snap::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, id - lag(id) OVER w AS step
  FROM feeds WINDOW w AS (PARTITION BY symbol ORDER BY id)),
runs AS (SELECT *, sum((step IS DISTINCT FROM 1)::INT) OVER (PARTITION BY symbol, k ORDER BY id) AS run FROM parts),
placed AS (SELECT *, id - min(id) OVER (PARTITION BY symbol, k, run) AS pos FROM runs),
snaps AS (SELECT *, late = 0 OR pos % {RESYNC_BUFFER} + 1 >= late AS covers, run > 0 AS broken FROM placed WHERE snap),
rules AS (  -- whether a book waits at a snapshot, after waiting or not at the one before
  SELECT *, k > 0 AND (broken OR NOT lag(covers) OVER w) AS after_wait, k > 0 AND (broken OR lag(late) OVER w <> 0) AS after_sync
  FROM snaps WINDOW w AS (PARTITION BY symbol ORDER BY id)),
sure AS (SELECT *, sum((after_wait = after_sync)::INT) OVER (PARTITION BY symbol ORDER BY id) AS grp FROM rules),
waits AS (  -- where the two differ, waiting turns over
  SELECT *, (first(after_wait::INT) OVER w + row_number() OVER w - 1) % 2 = 1 AS waiting
  FROM sure WINDOW w AS (PARTITION BY symbol, grp ORDER BY id)),
deltas AS (
  SELECT p.*, p.k > 0 AND p.run = 0 AND CASE WHEN b.waiting THEN b.covers ELSE b.late = 0 END AS live,
         coalesce(e.waiting AND e.covers AND p.id > e.id - e.late, false) AS kept
  FROM placed p LEFT JOIN waits b ON b.symbol = p.symbol AND b.k = p.k - 1 LEFT JOIN waits e ON e.symbol = p.symbol AND e.k = p.k)
SELECT symbol, 2 * id + 1 AS ord, CASE WHEN waiting AND NOT covers THEN 'resync_failed' ELSE 'snapshot' END AS emitted FROM waits
UNION ALL SELECT symbol, 2 * id, 'delta' FROM deltas WHERE live
UNION ALL SELECT symbol, 2 * id, 'kept' FROM deltas WHERE kept
UNION ALL SELECT symbol, 2 * id, 'buffer_full' FROM deltas WHERE k > 0 AND NOT live AND pos > 0 AND pos % {RESYNC_BUFFER} = 0""",
)
def book_resync(spark, d):
    """Every message is a delta; after a sign-up comes a snapshot that is up to three
    messages old. A book keeps three deltas while it waits."""
    snap, n = F.col("provider") == "signup", F.col("id")

    def event(ord_, is_snapshot, first, final):
        parts = {"ord": ord_, "is_snapshot": F.lit(is_snapshot), "first_id": first, "final_id": final, "prev_id": n - 1}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    delta, held = event(2 * n, False, n, n), event(2 * n + 1, True, n - n % 4, n - n % 4)
    events = feeds(spark, d).select(
        "symbol", F.explode(F.when(snap, F.array(delta, held)).otherwise(F.array(delta))).alias("e")
    )
    return drain(bk.book_resync(events.select("symbol", "e.*"), "spot", RESYNC_BUFFER), "resync")


@query(
    "stream_order_check",
    f"""WITH {TRADES}, t AS (
  SELECT symbol, id, local_ts, max(local_ts) OVER (PARTITION BY symbol ORDER BY id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ts
  FROM (SELECT symbol, (id * 1103515245) % 2147483647 AS id, local_ts FROM trades))
SELECT symbol, id, local_ts, prev_ts FROM t WHERE local_ts < prev_ts""",
)
def stream_order_check(spark, d):
    """Late rows of a stream whose messages arrive in another order than they were sent."""
    arriving = trade_stream(spark, d).withColumn("id", F.col("id") * 1103515245 % 2147483647)
    return drain(late_rows(arriving, arrival="id"), "late")


@query(
    "stream_book_gap",
    f"""WITH {FEEDS}, seen AS (
  SELECT *, CASE WHEN provider = 'click' THEN id - 1 END AS prev, lag(id) OVER w AS last, lag(snap) OVER w AS fresh
  FROM feeds WINDOW w AS (PARTITION BY symbol ORDER BY id))
SELECT symbol, id AS ord, CASE WHEN snap THEN 'ok'
    WHEN prev IS NOT NULL THEN CASE WHEN prev = last OR (fresh AND prev < last AND last <= id) THEN
         CASE WHEN fresh AND NOT (prev < last AND last <= id) THEN 'gap' ELSE 'ok' END ELSE 'gap' END
    WHEN id <> last + 1 THEN 'gap' ELSE 'ok' END AS status FROM seen WHERE sid IS NOT NULL""",
)
def stream_book_gap(spark, d):
    records = feeds(spark, d).select(
        "symbol",
        "ord",
        (F.col("provider") == "signup").alias("is_snapshot"),
        F.col("id").alias("seq"),
        F.when(F.col("provider") == "click", F.col("id") - 1).alias("prev_seq"),
        F.col("provider").alias("content"),
    )
    return drain(bk.stream_book_gap(records), "book-gap")


@query(
    "stream_reorg",
    """WITH b AS (
  SELECT o_orderkey AS n, o_orderkey // 1000 AS chain, o_orderpriority = '1-URGENT' AS odd FROM orders),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY chain ORDER BY n) AS run FROM b WHERE odd),
placed AS (SELECT *, row_number() OVER (PARTITION BY chain, run ORDER BY n) AS place,
                  min(n) OVER (PARTITION BY chain, run) AS first_n FROM runs)
SELECT 'c:' || chain AS chain, n AS block_number, n - 1 AS fork_point, 'h' || (n - 1) AS expected, 'x' || (n - 1) AS got
FROM placed WHERE (place + CASE WHEN first_n % 1000 = 0 THEN 1 ELSE 0 END) % 2 = 1""",
)
def stream_reorg(spark, d):
    """orders as blocks of chains of a thousand; urgent ones name a parent that never came."""
    key = F.col("o_orderkey")
    odd = F.col("o_orderpriority") == "1-URGENT"
    blocks = _Stream(spark).parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("c:"), F.floor(key / 1000).cast("string")).alias("chain"),
        key.alias("ord"),
        key.alias("block_number"),
        F.concat(F.lit("h"), key.cast("string")).alias("block_hash"),
        F.concat(F.when(odd, "x").otherwise("h"), (key - 1).cast("string")).alias("parent_hash"),
    )
    return drain(bk.stream_reorg(blocks), "reorg")


@query(
    "stream_book",
    f"""WITH {REBUILT}, top AS (
  SELECT symbol, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask,
         count(*) AS levels FROM rebuilt GROUP BY 1),
newest AS (SELECT symbol, max(local_ts) AS ord FROM levels GROUP BY 1)
SELECT s.symbol, n.ord, t.best_bid, t.best_ask, coalesce(t.levels, 0) AS levels
FROM last_snap s JOIN newest n ON n.symbol = s.symbol LEFT JOIN top t ON t.symbol = s.symbol""",
)
def stream_book(spark, d):
    """Live top of book of every symbol after all records."""
    stored = materialize(
        book_table(spark, d).select("symbol", F.col("local_ts").alias("ord"), "is_snapshot", "bids", "asks"), "book"
    )
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    live = spark.readStream.schema(stored.schema).parquet(path)
    return drain(bk.stream_book(live), "live-book")


@query(
    "live_totals",
    f"""WITH {TRADES} SELECT count(*) AS rows, count(price) AS valued, {rnd('last(price ORDER BY local_ts, id)')} AS last_value,
       max(local_ts) AS last_ts FROM trades""",
)
def live_totals(spark, d):
    """What the micro-batches of the trade stream counted, added up."""
    totals = LiveTotals()
    spark.streams.addListener(totals)
    try:
        trades = trade_stream(spark, d).withColumn("channel", F.lit("trade"))
        drain(watch_totals(trades, order=["local_ts", "id"]), "totals")
        totals.ended.wait(30)
    finally:
        spark.streams.removeListener(totals)
    rows = [(b["rows"], b["valued"], b["last_value"], b["last_ts"]) for b in totals.batches]
    seen = spark.createDataFrame(rows, "rows long, valued long, last_value double, last_ts long")
    out = seen.agg(
        F.sum("rows").alias("rows"),
        F.sum("valued").alias("valued"),
        F.max_by("last_value", "last_ts").alias("last_value"),
        F.max("last_ts").alias("last_ts"),
    )
    return r6(out, "last_value")
