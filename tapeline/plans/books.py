"""Queries: depth, books, sequences and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.timefns import micros_to_ns
from tapeline.operators import book as bk
from tapeline.operators import depth as dp
from tapeline.operators import reorg as ro
from tapeline.operators import replay as rp
from tapeline.operators import sequence as sq
from tapeline.operators import stats as st
from tapeline.plans.registry import query, r6, rnd, table
from tapeline.plans.roles import FILLS, HOUR, HOURLY, TRADES, fills, hourly, trades
from tapeline.sinks.lake import limit_rows

BINS = 40
FOUR_WEEKS = 28 * 24 * HOUR

VAP = f"""{HOURLY}, use_bars AS (SELECT * FROM hourly WHERE volume > 0 AND high >= low),
span AS (SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / {BINS} AS w FROM use_bars GROUP BY 1),
placed AS (
  SELECT b.symbol, lo, hi, w, volume, CASE WHEN hi <= lo THEN 0 ELSE least(greatest(floor((low - lo) / w), 0), {BINS - 1}) END AS a,
         CASE WHEN hi <= lo THEN 0 ELSE least(greatest(floor((high - lo) / w), 0), {BINS - 1}) END AS z
  FROM use_bars b JOIN span USING (symbol)),
spread AS (
  SELECT symbol, lo, w, unnest(generate_series(CAST(a AS BIGINT), CAST(z AS BIGINT))) AS i, volume / (z - a + 1) AS share FROM placed),
vap AS (
  SELECT symbol, round(lo + (i + 0.5) * w, 6) AS price, round(sum(share), 6) AS size FROM spread GROUP BY symbol, lo, w, i),
ref AS (SELECT symbol, last(close ORDER BY bar) AS reference_price, max(bar) AS source_ts FROM hourly GROUP BY 1),
sided AS (
  SELECT symbol, reference_price, source_ts, price, size, CASE WHEN price < reference_price THEN 'bid' ELSE 'ask' END AS side
  FROM vap JOIN ref USING (symbol) WHERE price <> reference_price),
ladder AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(price - reference_price)) AS level FROM sided
  QUALIFY level <= 10)"""


@query("volume_at_price", f"WITH {VAP} SELECT symbol, {rnd('price')} AS price, {rnd('size')} AS size FROM vap")
def volume_at_price(spark, d):
    return r6(dp.volume_at_price(hourly(spark, d), bins=BINS), "price", "size")


def _one_bucket(price: str) -> str:
    return f"""WITH {HOURLY}, span AS (
  SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / {BINS} AS w FROM hourly GROUP BY 1),
placed AS (
  SELECT symbol, lo, w, volume, least(greatest(floor(({price} - lo) / w), 0), {BINS - 1}) AS i
  FROM hourly JOIN span USING (symbol))
SELECT symbol, {rnd('lo + (i + 0.5) * w')} AS price, {rnd('sum(volume)')} AS size FROM placed GROUP BY symbol, lo, w, i"""


@query("volume_at_price_typical", _one_bucket("((high + low + close) / 3.0)"))
def volume_at_price_typical(spark, d):
    return r6(dp.volume_at_price(hourly(spark, d), bins=BINS, method="typical"), "price", "size")


@query("volume_at_price_close", _one_bucket("close"))
def volume_at_price_close(spark, d):
    return r6(dp.volume_at_price(hourly(spark, d), bins=BINS, method="close"), "price", "size")


@query("reference_price", f"WITH {HOURLY} SELECT symbol, {rnd('last(close ORDER BY bar)')} AS reference_price FROM hourly GROUP BY 1")
def reference_price(spark, d):
    return r6(dp.reference_price(hourly(spark, d)), "reference_price")


@query(
    "ladder_top_n",
    f"WITH {VAP} SELECT symbol, {rnd('reference_price')} AS reference_price, side, CAST(level AS INTEGER) AS level, {rnd('price')} AS price, {rnd('size')} AS size FROM ladder",
)
def ladder_top_n(spark, d):
    bars = hourly(spark, d)
    out = dp.ladder_top_n(dp.volume_at_price(bars, bins=BINS), dp.reference_price(bars))
    return r6(out, "reference_price", "price", "size")


@query(
    "depth_profile",
    f"""WITH {VAP} SELECT symbol, {rnd('max(reference_price)')} AS reference_price, max(source_ts) AS source_ts, 'bar_vap' AS basis,
       true AS is_synthetic, count(*) AS depth, {rnd("max(CASE WHEN side = 'bid' THEN price END)")} AS best_bid,
       {rnd("min(CASE WHEN side = 'ask' THEN price END)")} AS best_ask,
       {rnd("sum(CASE WHEN side = 'bid' THEN size ELSE 0 END)")} AS bid_size,
       {rnd("sum(CASE WHEN side = 'ask' THEN size ELSE 0 END)")} AS ask_size
FROM ladder GROUP BY 1""",
)
def depth_profile(spark, d):
    p = dp.depth_profile(hourly(spark, d), bins=BINS)

    def total(side):
        return F.aggregate(side, F.lit(0.0), lambda a, v: a + v["size"])

    out = p.select(
        "symbol",
        "reference_price",
        "source_ts",
        "basis",
        "is_synthetic",
        "depth",
        F.get("bids", F.lit(0))["price"].alias("best_bid"),
        F.get("asks", F.lit(0))["price"].alias("best_ask"),
        total("bids").alias("bid_size"),
        total("asks").alias("ask_size"),
    )
    return r6(out, "reference_price", "best_bid", "best_ask", "bid_size", "ask_size")


@query(
    "usable_bars",
    f"WITH {FILLS} SELECT symbol, id, {rnd('price')} AS close FROM fills WHERE size > 25 AND ask_px >= bid_px AND ask_px - bid_px > 0",
)
def usable_bars(spark, d):
    """Fills read as bars; small ones carry no volume."""
    f = fills(spark, d).select(
        "symbol",
        "id",
        F.col("price").alias("close"),
        (F.col("size") - 25).alias("volume"),
        F.when(F.col("ask_px") > F.col("bid_px"), F.col("ask_px")).alias("high"),
        F.col("bid_px").alias("low"),
    )
    return r6(dp.usable_bars(f).select("symbol", "id", "close"), "close")


# -- books ------------------------------------------------------------------------


def book_table(spark, d):
    """lineitem as book records of a supplier, one per ship date.

    Bids stand at 100 minus the discount in percent, asks at 101 plus the tax, so a book
    has at most twenty prices; returned goods remove their level and the first day of a
    month is a snapshot.
    """
    li = table(spark, d, "lineitem")
    bid = F.col("l_linenumber").isin(1, 3, 5, 7)
    price = F.when(bid, 100.0 - F.round(F.col("l_discount") * 100)).otherwise(
        101.0 + F.round(F.col("l_tax") * 100)
    )
    size = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    # one shuffle, by symbol and time
    held = (
        li.select(
            F.concat(F.lit("li:"), F.col("l_suppkey").cast("string")).alias("symbol"),
            micros_to_ns(F.col("l_shipdate")).alias("local_ts"),
            F.struct(
                F.coalesce(bid, F.lit(False)).alias("bid"),
                price.alias("price"),
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                size.alias("size"),
            ).alias("level"),
        )
        .groupBy("symbol", "local_ts")
        .agg(F.array_sort(F.collect_list("level")).alias("levels"))
    )

    def replaced(level, i):
        """The next level sets the same price."""
        later = F.get("levels", i + 1)
        same = (later["bid"] == level["bid"]) & later["price"].eqNullSafe(level["price"])
        return F.coalesce(same, F.lit(False))

    def side(bids):
        of_side = F.filter("levels", lambda v: v["bid"] == bids)
        return F.transform(of_side, lambda v: F.struct(v["price"].alias("price"), v["size"].alias("size")))

    last = held.withColumn("levels", F.filter("levels", lambda v, i: ~replaced(v, i)))
    days = (F.col("local_ts") - F.pmod("local_ts", F.lit(24 * HOUR))) / F.lit(24 * HOUR)
    return last.select(
        "symbol",
        "local_ts",
        (F.dayofmonth(F.date_from_unix_date(days.cast("int"))) == 1).alias("is_snapshot"),
        side(True).alias("bids"),
        side(False).alias("asks"),
        F.lit(0).cast("long").alias("seq"),
    )


BOOK = """lv AS (
  SELECT 'li:' || l_suppkey AS symbol, epoch_us(l_shipdate) * 1000 AS local_ts, day(l_shipdate) = 1 AS is_snapshot,
         CASE WHEN l_linenumber IN (1, 3, 5, 7) THEN 'bid' ELSE 'ask' END AS side,
         CASE WHEN l_linenumber IN (1, 3, 5, 7) THEN 100.0 - round(l_discount * 100)
              ELSE 101.0 + round(l_tax * 100) END AS price,
         l_orderkey * 8 + l_linenumber AS id,
         CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS size FROM lineitem),
levels AS (
  SELECT symbol, local_ts, is_snapshot, side, CAST(price AS DOUBLE) AS price, last(size ORDER BY id, size) AS size
  FROM lv GROUP BY ALL)"""


@query(
    "usable_levels",
    f"WITH {BOOK} SELECT symbol, local_ts, count(*) FILTER (size > 0) AS n FROM levels GROUP BY 1, 2",
)
def usable_levels(spark, d):
    b = book_table(spark, d)
    n = F.size(dp.usable_levels(F.col("bids"))) + F.size(dp.usable_levels(F.col("asks")))
    return b.select("symbol", "local_ts", n.cast("long").alias("n"))


LAST_SNAP = f"""{BOOK}, last_snap AS (SELECT symbol, max(local_ts) AS at FROM levels WHERE is_snapshot GROUP BY 1)"""


@query(
    "latest_snapshot",
    f"""WITH {LAST_SNAP} SELECT l.symbol, local_ts, count(*) FILTER (side = 'bid') AS bids,
       count(*) FILTER (side = 'ask') AS asks FROM levels l JOIN last_snap s ON l.symbol = s.symbol AND l.local_ts = s.at GROUP BY 1, 2""",
)
def latest_snapshot(spark, d):
    out = dp.latest_snapshot(book_table(spark, d).where("is_snapshot"))
    return out.select(
        "symbol", "local_ts", F.size("bids").cast("long").alias("bids"), F.size("asks").cast("long").alias("asks")
    )


def _slippage_sql(side: str, size: float) -> str:
    book, order, sign = ("ask", "price", 1) if side == "buy" else ("bid", "price DESC", -1)
    return f"""WITH {LAST_SNAP}, walk AS (
  SELECT l.symbol, price, size, sum(size) OVER (PARTITION BY l.symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING) - size AS before,
         first_value(price) OVER (PARTITION BY l.symbol ORDER BY {order}) AS best
  FROM levels l JOIN last_snap s ON l.symbol = s.symbol AND l.local_ts = s.at WHERE side = '{book}' AND size > 0),
filled AS (
  SELECT symbol, max(best) AS best, sum(greatest(least(size, {size} - before), 0)) AS got,
         sum(greatest(least(size, {size} - before), 0) * price) AS cost FROM walk GROUP BY 1),
done AS (
  SELECT s.symbol, best, cost / {size} AS px, CASE WHEN got IS NULL THEN 'no_levels' WHEN got < {size} THEN 'exceeds_depth' ELSE 'ok' END AS status
  FROM last_snap s LEFT JOIN filled USING (symbol))
SELECT symbol, '{side}' AS side, {size}::DOUBLE AS size, CASE WHEN status = 'ok' THEN {rnd('best')} END AS best_price,
       CASE WHEN status = 'ok' THEN {rnd('px')} END AS expected_price,
       CASE WHEN status = 'ok' THEN {rnd(f'{sign} * (px - best)')} END AS slippage_usd,
       CASE WHEN status = 'ok' THEN {rnd(f'{sign} * (px - best) / best * 100')} END AS slippage_pct, status FROM done"""


SLIP = ["best_price", "expected_price", "slippage_usd", "slippage_pct"]


@query("slippage", _slippage_sql("buy", 30.0))
def slippage(spark, d):
    return r6(dp.slippage(book_table(spark, d).where("is_snapshot"), "buy", 30.0), *SLIP)


@query("slippage_sell", _slippage_sql("sell", 60.0))
def slippage_sell(spark, d):
    return r6(dp.slippage(book_table(spark, d).where("is_snapshot"), "sell", 60.0), *SLIP)


@query(
    "depth_from_quote",
    f"""WITH {FILLS}, q AS (
  SELECT symbol, bid_px, bid_sz, ask_px, ask_sz, row_number() OVER (PARTITION BY symbol ORDER BY local_ts DESC, id DESC, bid_px DESC, ask_px DESC) AS r FROM fills)
SELECT symbol, {rnd('bid_px')} AS bid_px, bid_sz, {rnd('ask_px')} AS ask_px, ask_sz, {rnd('(bid_px + ask_px) / 2')} AS reference_price,
       CAST(2 AS BIGINT) AS depth, 'quote_l1' AS basis, false AS is_synthetic FROM q WHERE r = 1""",
)
def depth_from_quote(spark, d):
    out = dp.depth_from_quote(fills(spark, d), tie=["id", "bid_px", "ask_px"])
    first = [
        F.get(side, F.lit(0))[field].alias(name)
        for side, field, name in (
            ("bids", "price", "bid_px"),
            ("bids", "size", "bid_sz"),
            ("asks", "price", "ask_px"),
            ("asks", "size", "ask_sz"),
        )
    ]
    out = out.select("symbol", *first, "reference_price", "depth", "basis", "is_synthetic")
    return r6(out, "bid_px", "ask_px", "reference_price")


REBUILT = f"""{LAST_SNAP}, rebuilt AS (
  SELECT l.symbol, side, price, last(size ORDER BY local_ts) AS size
  FROM levels l JOIN last_snap s ON l.symbol = s.symbol AND l.local_ts >= s.at GROUP BY 1, 2, 3 HAVING last(size ORDER BY local_ts) > 0)"""


@query("book_rebuild", f"WITH {REBUILT} SELECT symbol, side, price, size FROM rebuilt")
def book_rebuild(spark, d):
    return bk.book_rebuild(book_table(spark, d))


@query(
    "book_best",
    f"WITH {REBUILT} SELECT symbol, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask FROM rebuilt GROUP BY 1",
)
def book_best(spark, d):
    return bk.best_prices(bk.book_rebuild(book_table(spark, d)))


SAMPLED = f"""{BOOK}, spans AS (
  SELECT l.symbol, min(local_ts) FILTER (is_snapshot) AS t0, max(local_ts) AS t1 FROM levels l GROUP BY 1),
grid AS (
  SELECT symbol, unnest(generate_series(t0 - t0 % {FOUR_WEEKS} + {FOUR_WEEKS}, t1 - t1 % {FOUR_WEEKS}, {FOUR_WEEKS})) AS at
  FROM spans WHERE t0 IS NOT NULL),
held AS (
  SELECT g.symbol, g.at, max(l.local_ts) AS snap FROM grid g JOIN levels l
  ON l.symbol = g.symbol AND l.is_snapshot AND l.local_ts <= g.at GROUP BY 1, 2),
sampled AS (
  SELECT h.symbol, h.at AS local_ts, side, price, last(size ORDER BY l.local_ts) AS size
  FROM held h JOIN levels l ON l.symbol = h.symbol AND l.local_ts BETWEEN h.snap AND h.at
  GROUP BY 1, 2, 3, 4 HAVING last(size ORDER BY l.local_ts) > 0)"""


@query("book_resample", f"WITH {SAMPLED} SELECT symbol, local_ts, side, price, size FROM sampled")
def book_resample(spark, d):
    return bk.book_resample(book_table(spark, d), FOUR_WEEKS, as_levels=True)


@query(
    "book_resample_top",
    f"""WITH {SAMPLED}, top AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, local_ts, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS r FROM sampled)
SELECT g.symbol, g.at AS local_ts, count(t.r) AS depth, max(CASE WHEN side = 'bid' THEN price END) AS best_bid,
       min(CASE WHEN side = 'ask' THEN price END) AS best_ask
FROM grid g LEFT JOIN (SELECT * FROM top WHERE r <= 3) t ON t.symbol = g.symbol AND t.local_ts = g.at GROUP BY 1, 2""",
)
def book_resample_top(spark, d):
    out = bk.book_resample(book_table(spark, d), FOUR_WEEKS, top_n=3)
    return out.select(
        "symbol",
        "local_ts",
        "depth",
        F.get("bids", F.lit(0))["price"].alias("best_bid"),
        F.get("asks", F.lit(0))["price"].alias("best_ask"),
    )


# -- sequences --------------------------------------------------------------------

RECEIVED = f"""{TRADES}, received AS (SELECT * FROM trades WHERE provider <> 'error')"""


def received(spark, d):
    """The trades of one feed with the ``error`` messages lost."""
    return trades(spark, d).where("provider <> 'error'").withColumn("symbol", F.lit("feed"))


def _gap_sql(part: str, order: str) -> str:
    return f"""WITH {RECEIVED}, based AS (
  SELECT id, max(id) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM received)
SELECT id, base + 1 AS expected, coalesce(base IS NOT NULL AND id <> base + 1, false) AS is_gap,
       CASE WHEN id <> base + 1 THEN id - base - 1 END AS skipped,
       CASE WHEN id > base + 1 THEN 'forward' WHEN id <= base THEN 'backward' END AS kind FROM based"""


GAP_COLS = ["id", "expected", "is_gap", "skipped", "kind"]


@query("seq_gap", _gap_sql("1", "local_ts, id"))
def seq_gap(spark, d):
    """One feed that holds every row, so that a single key owns the whole table."""
    return sq.seq_gap(received(spark, d), seq="id", order=["local_ts", "id"]).select(*GAP_COLS)


@query("seq_gap_shuffled", _gap_sql("provider", "price, id"))
def seq_gap_shuffled(spark, d):
    """Arrival out of order: backward numbers must not move the baseline."""
    out = sq.seq_gap(received(spark, d), seq="id", keys=["provider"], order=["price", "id"])
    return out.select(*GAP_COLS)


def feed_records(spark, d):
    """The feed as book records: sign-ups are snapshots, clicks name their predecessor."""
    snap = F.col("provider") == "signup"
    return received(spark, d).select(
        "symbol",
        "local_ts",
        F.col("id").alias("ord"),
        snap.alias("is_snapshot"),
        F.col("id").alias("seq"),
        F.when(F.col("provider") == "click", F.col("id") - 1).alias("prev_seq"),
        F.col("provider").alias("content"),
    )


FEED_STATUS = f"""{RECEIVED}, seen AS (
  SELECT id, local_ts, provider, provider = 'signup' AS snap, CASE WHEN provider = 'click' THEN id - 1 END AS prev,
         lag(id) OVER w AS last, lag(provider) OVER w = 'signup' AS fresh,
         count(*) FILTER (provider = 'signup') OVER (ORDER BY local_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS snaps
  FROM received WINDOW w AS (ORDER BY local_ts, id)),
status AS (
  SELECT id, local_ts, CASE WHEN snap THEN 'ok' WHEN snaps = 0 THEN NULL
    WHEN prev IS NOT NULL THEN CASE WHEN fresh THEN CASE WHEN prev < last AND last <= id THEN 'ok' ELSE 'gap' END
                                    WHEN prev = last THEN 'ok' ELSE 'gap' END
    WHEN id <> last + 1 THEN 'gap' ELSE 'ok' END AS status FROM seen)"""


@query("book_gap", f"WITH {FEED_STATUS} SELECT id AS ord, status FROM status")
def book_gap(spark, d):
    return sq.book_gap(feed_records(spark, d)).select("ord", "status")


def blocks(spark, d):
    """orders as blocks in key order; urgent ones name a parent that never came."""
    key = F.col("o_orderkey")
    odd = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").select(
        F.lit("c").alias("chain"),
        key.alias("ord"),
        key.alias("arrival"),
        key.alias("block_number"),
        F.concat(F.lit("h"), key.cast("string")).alias("block_hash"),
        F.concat(F.when(odd, "x").otherwise("h"), (key - 1).cast("string")).alias("parent_hash"),
    )


@query(
    "reorg_detect",
    """WITH runs AS (
  SELECT o_orderkey AS n, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS run FROM orders WHERE o_orderpriority = '1-URGENT'),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n) AS place, min(n) OVER (PARTITION BY run) AS first_n FROM runs)
SELECT 'c' AS chain, n AS block_number, n - 1 AS fork_point, 'h' || (n - 1) AS expected, 'x' || (n - 1) AS got
FROM placed LEFT JOIN orders p ON p.o_orderkey = first_n - 1
WHERE (place + CASE WHEN p.o_orderkey IS NULL THEN 1 ELSE 0 END) % 2 = 1""",
)
def reorg_detect(spark, d):
    return ro.reorg_detect(blocks(spark, d))


@query(
    "reorg_chains",
    """WITH b AS (
  SELECT o_orderkey AS n, 'all' AS chain, o_orderpriority = '1-URGENT' AS odd FROM orders
  UNION ALL SELECT o_orderkey, 'c' || CAST(floor(sqrt(o_orderkey) / 40) AS BIGINT), o_orderpriority = '1-URGENT' FROM orders),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY chain ORDER BY n) AS run FROM b WHERE odd),
placed AS (SELECT *, row_number() OVER (PARTITION BY chain, run ORDER BY n) AS place,
                  min(n) OVER (PARTITION BY chain, run) AS first_n FROM runs)
SELECT r.chain, r.n AS block_number, r.n - 1 AS fork_point, 'h' || (r.n - 1) AS expected, 'x' || (r.n - 1) AS got
FROM placed r LEFT JOIN b p ON p.chain = r.chain AND p.n = first_n - 1
WHERE (place + CASE WHEN p.n IS NULL THEN 1 ELSE 0 END) % 2 = 1""",
)
def reorg_chains(spark, d):
    """Chains of unequal length, and one that holds every block."""
    every = blocks(spark, d)
    own = F.floor(F.sqrt("block_number") / 40).cast("string")
    cut = every.withColumn("chain", F.concat(F.lit("c"), own))
    return ro.reorg_detect(every.withColumn("chain", F.lit("all")).unionByName(cut))


# -- order, replay, projections ---------------------------------------------------


@query(
    "replay_merge",
    f"""WITH {TRADES}, {FILLS}
SELECT local_ts, CAST(-1 AS BIGINT) AS source_ts, CAST(0 AS BIGINT) AS seq, provider, symbol, 'trade' AS channel FROM trades
UNION ALL SELECT local_ts, -1, 0, provider, symbol, 'quote' FROM fills
UNION ALL SELECT local_ts, -1, id, provider, symbol, 'book_delta' FROM fills""",
)
def replay_merge(spark, d):
    f = fills(spark, d)
    merged = rp.replay_merge(
        {
            "trade": trades(spark, d),
            "quote": f.select("provider", "symbol", "local_ts", "bid_px", "ask_px"),
            "book_delta": f.select("provider", "symbol", "local_ts", F.col("id").alias("seq_id")),
        }
    )
    return merged.drop("payload")


@query("order_by_time", f"WITH {TRADES} SELECT symbol, local_ts, id, price FROM trades ORDER BY local_ts")
def order_by_time(spark, d):
    return trades(spark, d).select("symbol", "local_ts", "id", "price").orderBy("local_ts")


@query("limit_rows", f"WITH {TRADES} SELECT symbol, local_ts, id FROM trades ORDER BY local_ts LIMIT 500")
def limit(spark, d):
    return limit_rows(trades(spark, d).select("symbol", "local_ts", "id"), 500)


@query(
    "union_diagonal",
    f"""WITH {TRADES}, {FILLS}
SELECT symbol, local_ts, price, id, NULL::DOUBLE AS bid_px FROM trades
UNION ALL SELECT symbol, local_ts, NULL, NULL, {rnd('bid_px')} FROM fills""",
)
def union_diagonal(spark, d):
    t = trades(spark, d).select("symbol", "local_ts", "price", "id")
    q = r6(fills(spark, d).select("symbol", "local_ts", "bid_px"), "bid_px")
    return t.unionByName(q, allowMissingColumns=True)


@query("distinct_symbols", f"WITH {TRADES} SELECT DISTINCT symbol FROM trades")
def distinct_symbols(spark, d):
    return trades(spark, d).select("symbol").distinct()


def mixed(spark, d):
    """Trades, quotes and bars of the same symbols in one table."""
    t = trades(spark, d).select("symbol", "local_ts", "id", "price").withColumn("channel", F.lit("trade"))
    q = fills(spark, d).select("symbol", "local_ts", "id", "bid_px", "ask_px").withColumn("channel", F.lit("quote"))
    b = hourly(spark, d).select("symbol", "local_ts", F.lit(0).cast("long").alias("id"), "close").withColumn("channel", F.lit("bar"))
    both = t.unionByName(q, allowMissingColumns=True)
    return both.unionByName(b, allowMissingColumns=True)


MIXED = f"""{HOURLY}, {FILLS}, mixed AS (
  SELECT symbol, local_ts, id, 'trade' AS channel, price AS value FROM trades
  UNION ALL SELECT symbol, local_ts, id, 'quote', (bid_px + ask_px) / 2 FROM fills
  UNION ALL SELECT symbol, bar, 0, 'bar', close FROM hourly)"""


@query("value_projection", f"WITH {MIXED} SELECT symbol, channel, local_ts, id, {rnd('value')} AS value FROM mixed")
def value_projection(spark, d):
    m = mixed(spark, d)
    value = st.value_projection(m.columns)
    return r6(m.select("symbol", "channel", "local_ts", "id", value.alias("value")), "value")


@query(
    "ingest_stats",
    f"""WITH {MIXED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, channel ORDER BY local_ts DESC, id DESC, value DESC) AS r FROM mixed),
s AS (
  SELECT symbol, channel, count(*) AS count, max(value) FILTER (r = 1) AS last_value, min(local_ts) AS t0, max(local_ts) AS t1,
         arg_max(value, r) FILTER (r <= 30) AS first_kept, sum(value) FILTER (r <= 30) AS kept_sum, count(*) FILTER (r <= 30) AS kept
  FROM ranked GROUP BY 1, 2)
SELECT symbol, channel, count, {rnd('last_value')} AS last_value, {rnd('kept_sum')} AS kept_sum, kept,
       {rnd('(last_value - first_kept) / first_kept * 100')} AS change_pct,
       {rnd('count / nullif((t1 - t0) / 1e9, 0)')} AS rows_per_second FROM s""",
)
def ingest_stats(spark, d):
    m = mixed(spark, d)
    m = m.withColumn("v", st.value_projection(m.columns))
    out = st.ingest_stats(m, order=["local_ts", "id", "v"], ieee=True)
    total = F.aggregate("last_values", F.lit(0.0), lambda a, v: a + v)
    out = out.select(
        "symbol",
        "channel",
        "count",
        "last_value",
        total.alias("kept_sum"),
        F.size("last_values").cast("long").alias("kept"),
        "change_pct",
        "rows_per_second",
    )
    return r6(out, "last_value", "kept_sum", "change_pct", "rows_per_second", keep_nan=True)
