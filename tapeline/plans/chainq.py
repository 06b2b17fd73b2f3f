"""Queries: on-chain logs, rendered as hex from the driver tables and decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.timefns import micros_to_ns
from tapeline.operators import onchain as oc
from tapeline.plans.registry import query, r6, rnd, table
from tapeline.sources import onchain as src

UNIT = 10**12


def padded(digits, width, digit="0"):
    """At most ``width`` digits, filled up from the left; ``lpad`` copies byte by byte."""
    return F.right(F.concat(F.lit(digit * width), digits), F.lit(width))


def word(value):
    """A BIGINT column as a 256-bit two's complement word."""
    low = F.lower(F.hex(value.cast("long")))
    return F.when(value < 0, padded(low, 64, "f")).otherwise(padded(low, 64))


def wide(high, low):
    """high * 2^64 + low as a word."""
    return F.concat(
        F.lit("0" * 32), F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0")
    )


def addr(col):
    """An address word for a key."""
    return padded(F.lower(F.hex(col.cast("long"))), 64)


def items(spark, d):
    """lineitem as transactions; a supplier is a pool."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("pool"),
        F.concat_ws("-", F.lit("tx"), "l_orderkey", "l_partkey").alias("tx_hash"),
        F.col("l_linenumber").alias("log_index"),
        F.col("l_orderkey").alias("block"),
        (micros_to_ns(F.col("l_shipdate")) / 1_000_000_000).cast("long").alias("block_ts"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
        F.round(F.col("l_quantity") * UNIT).cast("long").alias("base_raw"),
        F.round(F.col("l_extendedprice") * 1_000_000).cast("long").alias("quote_raw"),
        (F.col("l_linestatus") == "O").alias("buy"),
    )


def pools(spark, d):
    """Suppliers as pools; some of them hold their tokens the other way round."""
    return table(spark, d, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("pool"),
        F.lit(12).alias("decimals0"),
        F.lit(6).alias("decimals1"),
        (F.col("s_nationkey") < 12).alias("is_flipped"),
    )


SWAP = f"""SELECT 'base_onchain:P' || l_suppkey AS symbol, 'tx-' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS id,
       epoch_us(l_shipdate) * 1000 AS source_ts, {rnd('l_extendedprice / l_quantity')} AS price, {rnd('l_quantity')} AS size,
       {rnd('l_extendedprice')} AS quote_size, l_linestatus = 'O' AS is_buy FROM lineitem"""
SWAP_COLS = ["symbol", "id", "source_ts", "price", "size", "quote_size", "is_buy"]


def v3_swaps(spark, d):
    base = F.when(F.col("buy"), -F.col("base_raw")).otherwise(F.col("base_raw"))
    quote = F.when(F.col("buy"), F.col("quote_raw")).otherwise(-F.col("quote_raw"))
    flip = F.col("is_flipped")
    data = F.concat(
        F.lit("0x"),
        F.when(flip, word(quote)).otherwise(word(base)),
        F.when(flip, word(base)).otherwise(word(quote)),
    )
    p = pools(spark, d)
    logs = items(spark, d).join(p, "pool").withColumn("data", data).drop("decimals0", "decimals1", "is_flipped")
    return src.src_swap_logs_v3(logs, p)


def v2_swaps(spark, d):
    zero = F.lit(0).cast("long")
    buy, flip = F.col("buy"), F.col("is_flipped")
    base_in = F.when(buy, zero).otherwise(F.col("base_raw"))
    base_out = F.when(buy, F.col("base_raw")).otherwise(zero)
    quote_in = F.when(buy, F.col("quote_raw")).otherwise(zero)
    quote_out = F.when(buy, zero).otherwise(F.col("quote_raw"))

    def pick(flipped, plain):
        return F.when(flip, word(flipped)).otherwise(word(plain))

    data = F.concat(pick(quote_in, base_in), pick(base_in, quote_in), pick(quote_out, base_out), pick(base_out, quote_out))
    p = pools(spark, d)
    logs = items(spark, d).join(p, "pool").withColumn("data", data).drop("decimals0", "decimals1", "is_flipped")
    return src.src_swap_logs_v2(logs, p)


@query("src_swap_logs_v3", SWAP)
def src_swap_logs_v3(spark, d):
    return r6(v3_swaps(spark, d).select(*SWAP_COLS), "price", "size", "quote_size")


@query("src_swap_logs_v2", SWAP)
def src_swap_logs_v2(spark, d):
    return r6(v2_swaps(spark, d).select(*SWAP_COLS), "price", "size", "quote_size")


@query(
    "pool_volume",
    f"""SELECT 'P' || l_suppkey AS pool, {rnd('sum(l_quantity)')} AS volume_base, {rnd('sum(l_extendedprice)')} AS volume_quote, count(*) AS num_swaps
FROM lineitem WHERE l_orderkey >= 100 GROUP BY 1""",
)
def pool_volume(spark, d):
    out = src.pool_volume(v3_swaps(spark, d), from_block=100)
    return r6(out, "volume_base", "volume_quote")


def states(spark, d):
    """lineitem as pool states; open items are concentrated pools."""
    price = F.col("l_extendedprice") / F.col("l_quantity") / 10_000.0
    return items(spark, d).select(
        "pool",
        F.concat_ws("-", "tx_hash", "log_index").alias("id"),
        F.when(F.col("buy"), "uniswap_v3").otherwise("aerodrome_v2").alias("pool_type"),
        (F.sqrt(price) * float(2**96)).alias("sqrt_price_x96"),
        (F.col("l_quantity") * 1e9).alias("liquidity"),
        (F.col("l_quantity") * 1e12).alias("reserve0_raw"),
        (F.col("l_extendedprice") * 1e6).alias("reserve1_raw"),
        (F.col("l_linenumber") * 10).alias("tick_spacing"),
    )


STATE = f"""base AS (
  SELECT 'tx-' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS id, l_linestatus = 'O' AS v3, s_nationkey < 12 AS flip,
         l_quantity AS qty, l_extendedprice AS ext, l_linenumber * 10 AS gap, l_extendedprice / l_quantity / 10000.0 AS ratio
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
amounts AS (
  SELECT *, CASE WHEN v3 THEN qty * 1e9 / sqrt(ratio) ELSE qty * 1e12 END AS x, CASE WHEN v3 THEN qty * 1e9 * sqrt(ratio) ELSE ext * 1e6 END AS y FROM base),
state AS (
  SELECT *, CASE WHEN flip THEN y ELSE x END / 1e12 AS reserve0, CASE WHEN flip THEN x ELSE y END / 1e6 AS reserve1 FROM amounts),
priced AS (
  SELECT *, CASE WHEN v3 THEN CASE WHEN flip THEN 1e6 / ratio ELSE ratio * 1e6 END ELSE reserve1 / reserve0 END AS price FROM state)"""


@query(
    "src_pool_state",
    f"WITH {STATE} SELECT id, {rnd('price', 4)} AS price, {rnd('reserve0', 8)} AS reserve0, {rnd('reserve1', 4)} AS reserve1 FROM priced",
)
def src_pool_state(spark, d):
    out = src.src_pool_state(states(spark, d), pools(spark, d)).select("id", "price", "reserve0", "reserve1")
    return r6(r6(out, "price", "reserve1", digits=4), "reserve0", digits=8)


def _flat(df, digits=9):
    """Relative prices and sizes of the first and the last level."""
    cols = []
    for side in ("bids", "asks"):
        for name, at in (("near", 0), ("far", src.LADDER_LEVELS - 1)):
            cols.append((F.get(side, F.lit(at))["price"] / F.col("price")).alias(f"{side}_{name}"))
            cols.append((F.get(side, F.lit(at))["size"]).alias(f"{side}_{name}_size"))
    names = [f"{s}_{n}{x}" for s in ("bids", "asks") for n in ("near", "far") for x in ("", "_size")]
    return r6(df.select("id", "depth", *cols), *names, digits=6)


def _ladder_sql(ask_px, bid_px, ask_sz, bid_sz, where):
    parts = []
    for name, i in (("near", 1), ("far", 5)):
        for side, px, sz in (("bids", bid_px, bid_sz), ("asks", ask_px, ask_sz)):
            parts.append(f"{rnd(px.replace('#', str(i)))} AS {side}_{name}")
            parts.append(f"{rnd('greatest(' + sz.replace('#', str(i)) + ', 0.0001)')} AS {side}_{name}_size")
    return f"WITH {STATE} SELECT id, CAST(5 AS BIGINT) AS depth, {', '.join(parts)} FROM priced WHERE {where}"


def _r(ticks: str) -> str:
    """sqrt(1.0001) to a number of ticks away from the price."""
    return f"pow(1.0001::DOUBLE, ({ticks}) / 2.0)"


_UP = f"(1 / {_r('(# - 1) * gap')} - 1 / {_r('# * gap')})"
_DOWN = f"({_r('-(# - 1) * gap')} - {_r('-# * gap')})"
# amounts at tick t scale with 1/sqrt(ratio) above and sqrt(ratio) below the price
_V3_ASK = f"qty * 1e9 * CASE WHEN flip THEN sqrt(ratio) * {_DOWN} / 1e6 ELSE {_UP} / sqrt(ratio) / 1e12 END"
_V3_BID = f"qty * 1e9 * CASE WHEN flip THEN {_UP} / sqrt(ratio) / 1e12 ELSE sqrt(ratio) * {_DOWN} / 1e6 END / (price * pow(1.0001::DOUBLE, -# * gap))"


@query(
    "src_pool_ladder_v3",
    _ladder_sql("pow(1.0001::DOUBLE, # * gap)", "pow(1.0001::DOUBLE, -# * gap)", _V3_ASK, _V3_BID, "v3"),
)
def src_pool_ladder_v3(spark, d):
    s = src.src_pool_state(states(spark, d), pools(spark, d)).where("pool_type = 'uniswap_v3'")
    return _flat(src.src_pool_ladder_v3(s))


_CP_BASE = "CASE WHEN flip THEN reserve1 ELSE reserve0 END"


_CP = _ladder_sql(
    "1 + 0.0005 * #",
    "1 - 0.0005 * #",
    f"({_CP_BASE}) * (1 / sqrt(1 + 0.0005 * (# - 1)) - 1 / sqrt(1 + 0.0005 * #))",
    f"({_CP_BASE}) * (1 / sqrt(1 - 0.0005 * #) - 1 / sqrt(1 - 0.0005 * (# - 1)))",
    "NOT v3",
)


@query("src_pool_ladder_cp", _CP)
def src_pool_ladder_cp(spark, d):
    s = src.src_pool_state(states(spark, d), pools(spark, d)).where("pool_type <> 'uniswap_v3'")
    return _flat(src.src_pool_ladder_cp(s))


@query(
    "ladder_quote",
    f"""SELECT id, bids_near AS bid_px, bids_near_size AS bid_sz, asks_near AS ask_px, asks_near_size AS ask_sz FROM ({_CP})""",
)
def ladder_quote(spark, d):
    """The best levels of constant-product ladders as quotes, prices relative to the pool's."""
    s = src.src_pool_state(states(spark, d), pools(spark, d)).where("pool_type <> 'uniswap_v3'")
    quotes = src.ladder_quote(src.src_pool_ladder_cp(s))
    quotes = quotes.withColumns({c: F.col(c) / F.col("price") for c in ("bid_px", "ask_px")})
    return r6(quotes.select("id", "bid_px", "bid_sz", "ask_px", "ask_sz"), "bid_px", "bid_sz", "ask_px", "ask_sz")


@query(
    "src_lending_logs",
    f"""SELECT 'lending:P' || l_suppkey AS symbol, 'update' AS kind, '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS asset,
       {rnd('(l_quantity * 1e6 * 18446744073709551616.0::DOUBLE + l_orderkey) / 1e27')} AS rate,
       CAST(CAST(l_quantity * 1000 AS HUGEINT) * 18446744073709551616 + l_orderkey AS VARCHAR) AS idx, NULL::BOOLEAN AS receive
FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'lending:P' || l_suppkey, 'call', '0x' || lpad(lower(to_hex(l_partkey)), 40, '0'), {rnd('l_quantity')}, NULL, l_returnflag = 'R'
FROM lineitem WHERE l_linestatus <> 'O'""",
)
def src_lending_logs(spark, d):
    """Open items update a reserve, the others are liquidations."""
    i = items(spark, d)
    qty, key = F.col("l_quantity"), F.col("l_orderkey")
    rate = wide((qty * 1_000_000).cast("long"), key)
    index = wide((qty * 1000).cast("long"), key)
    update = F.concat(F.lit("0x"), rate, rate, rate, index, index)
    flag = word(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    call = F.concat(F.lit("0x"), word(qty.cast("long")), word(qty.cast("long")), addr(F.col("l_suppkey")), flag)
    asset = F.concat(F.lit("0x"), addr(F.col("l_partkey")))
    logs = i.select(
        "pool",
        "block_ts",
        F.when(F.col("buy"), F.array(F.lit(src.RESERVE_DATA_UPDATED), asset))
        .otherwise(F.array(F.lit(src.LIQUIDATION_CALL), asset, asset, asset))
        .alias("topics"),
        F.when(F.col("buy"), update).otherwise(call).alias("data"),
    )
    updates, calls = src.src_lending_logs(logs)
    updates = updates.select(
        "symbol",
        F.lit("update").alias("kind"),
        F.col("reserve").alias("asset"),
        F.col("liquidity_rate").alias("rate"),
        F.col("liquidity_index").cast("string").alias("idx"),
        F.lit(None).cast("boolean").alias("receive"),
    )
    calls = calls.select(
        "symbol",
        F.lit("call").alias("kind"),
        F.col("collateral_asset").alias("asset"),
        F.col("debt_to_cover").alias("rate"),
        F.lit(None).cast("string").alias("idx"),
        F.col("receive_a_token").alias("receive"),
    )
    return r6(updates.unionByName(calls), "rate")


def _hex40(sql: str) -> str:
    return f"'0x' || lpad(lower(to_hex({sql})), 40, '0')"


@query(
    "src_limit_order_logs",
    f"""WITH l AS (SELECT *, 'tx-' || l_orderkey || '-' || l_partkey AS tx FROM lineitem)
SELECT tx AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index, CASE WHEN l_returnflag = 'R' THEN '0x' ELSE '1inch' END AS protocol,
       '0x' || lpad(lower(to_hex(l_orderkey)), 64, '0') AS order_hash, {_hex40('l_partkey')} AS maker, {_hex40('l_suppkey')} AS taker,
       CASE WHEN l_returnflag = 'R' THEN {_hex40('l_partkey + 1')} ELSE {_hex40('max(l_linenumber) OVER (PARTITION BY tx) + 7')} END AS maker_token,
       CASE WHEN l_returnflag = 'R' THEN {_hex40('l_partkey + 2')} ELSE '0x{"0" * 40}' END AS taker_token,
       {rnd('l_quantity')} AS maker_amount, {rnd('l_quantity + 1')} AS taker_amount
FROM l""",
)
def src_limit_order_logs(spark, d):
    """Every layout of both protocols. A transaction may hold several fills of a maker; of
    the transfers that leave the maker in it the last one counts."""
    i = items(spark, d)
    hash_, maker, taker = addr(F.col("l_orderkey")), addr(F.col("l_partkey")), addr(F.col("l_suppkey"))
    gave, got = addr(F.col("l_partkey") + 1), addr(F.col("l_partkey") + 2)
    n, m = word(F.col("l_quantity").cast("long")), word(F.col("l_quantity").cast("long") + 1)
    zero = word(F.lit(0))
    line = F.col("l_linenumber")
    first, second = F.lit(src.ORDER_FILLED), F.lit(src.LIMIT_ORDER_FILLED)

    def topic(w):
        return F.concat(F.lit("0x"), w)

    is_second = F.col("l_returnflag") == "R"
    topics = (
        F.when(is_second & (line > 3), F.array(second, topic(maker), topic(taker)))
        .when(is_second, F.array(second))
        .when(line == 1, F.array(first))
        .when(line == 2, F.array(first, topic(hash_)))
        .otherwise(F.array(first, topic(hash_), topic(maker), topic(taker)))
    )
    data = (
        F.when(is_second & (line > 3), F.concat(gave, got, n, m, hash_))
        .when(is_second, F.concat(maker, taker, gave, got, n, m, hash_))
        .when(line == 1, F.concat(hash_, maker, taker, zero, n, m))
        .when(line == 2, F.concat(maker, taker, zero, n, m))
        .otherwise(F.concat(zero, n, m))
    )
    logs = i.select("tx_hash", "log_index", "block_ts", topics.alias("topics"), F.concat(F.lit("0x"), data).alias("data"))
    token = F.concat(F.lit("0x"), padded(F.lower(F.hex(line.cast("long") + 7)), 40))
    transfers = i.select(
        "tx_hash",
        "log_index",
        token.alias("address"),
        F.array(F.lit(src.TRANSFER), topic(maker), topic(word(F.lit(2**40)))).alias("topics"),
    )
    out = src.src_limit_order_logs(logs, transfers)
    cols = ["tx_hash", "log_index", "protocol", "order_hash", "maker", "taker", "maker_token", "taker_token", "maker_amount", "taker_amount"]
    return r6(out.select(*cols), "maker_amount", "taker_amount")


def calls(spark, d):
    """An order as a transaction whose line n is called by line n - 1."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    path = F.when(n > 1, F.array_repeat(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    selector = F.when(F.col("l_discount") == 0.05, "0x5cffe9de").when(F.col("l_discount") == 0.03, "0x128acb08").otherwise("0xa9059cbb")
    return li.select(
        F.concat(F.lit("tx"), F.col("l_orderkey").cast("string")).alias("tx_hash"),
        n.alias("ord"),
        F.when(F.col("l_linestatus") == "O", "staticcall").otherwise("call").alias("call_type"),
        F.lit("0xF").alias("from_addr"),
        F.concat(F.lit("0xA"), F.col("l_returnflag")).alias("to_addr"),
        F.concat(selector, F.lit("00ff")).alias("input"),
        path.alias("path"),
    )


AGAIN = """c AS (SELECT 'tx' || l_orderkey AS tx_hash, l_linenumber AS n, l_returnflag AS target, l_linestatus <> 'O' AS live, l_discount FROM lineitem),
again AS (
  SELECT DISTINCT b.tx_hash, b.n AS ord FROM c b JOIN c a ON a.tx_hash = b.tx_hash AND a.target = b.target AND a.live AND b.live AND a.n < b.n)"""


@query("trace_ancestor_join", f"WITH {AGAIN} SELECT tx_hash, ord FROM again")
def trace_ancestor_join(spark, d):
    return oc.trace_ancestor_join(calls(spark, d))


@query(
    "trace_summary",
    f"""WITH {AGAIN} SELECT c.tx_hash, bool_or(l_discount = 0.05) AS flashloans, c.tx_hash IN (SELECT tx_hash FROM again) AS reentrancy_detected,
       count(*) FILTER (l_discount = 0.03) AS internal_swaps FROM c GROUP BY 1""",
)
def trace_summary(spark, d):
    return oc.trace_summary(calls(spark, d))


@query(
    "internal_swaps",
    """SELECT 'tx' || l_orderkey AS tx_hash, l_linenumber AS ord, '0xA' || l_returnflag AS pool, 'uniswap_v3' AS protocol FROM lineitem WHERE l_discount = 0.03""",
)
def internal_swaps(spark, d):
    return oc.internal_swaps(calls(spark, d)).select("tx_hash", "ord", "pool", "protocol")


def balances(spark, d):
    """Order totals as local balances against account balances on chain."""
    o = table(spark, d, "orders")
    local = o.groupBy(
        F.lit("0xT").alias("token_address"),
        F.concat(F.lit("0xabc"), F.col("o_custkey").cast("string")).alias("holder_address"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("local_balance"))
    c = table(spark, d, "customer")
    seen = c.select(
        F.lit("0xT").alias("token_address"),
        F.concat(F.lit("0xABC"), F.col("c_custkey").cast("string")).alias("holder_address"),
        F.round(F.col("c_acctbal") * 100).alias("raw_balance"),
        F.lit(2).alias("decimals"),
    )
    return local, seen


BALANCE = """diff AS (
  SELECT '0xABC' || c_custkey AS holder_address, coalesce(round(sum(o_totalprice), 2), 0.0) AS local_balance, round(c_acctbal * 100) / 100 AS onchain_balance
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)"""


@query(
    "balance_diff_join",
    f"WITH {BALANCE} SELECT holder_address, {rnd('local_balance', 4)} AS local_balance, {rnd('onchain_balance', 4)} AS onchain_balance FROM diff",
)
def balance_diff_join(spark, d):
    out = oc.balance_diff_join(*balances(spark, d))
    return r6(out.select("holder_address", "local_balance", "onchain_balance"), "local_balance", "onchain_balance", digits=4)


@query(
    "balance_correction",
    f"""WITH {BALANCE} SELECT holder_address, {rnd('onchain_balance - local_balance', 4)} AS correction_amount FROM diff
WHERE abs(onchain_balance - local_balance) > 0.01""",
)
def balance_correction(spark, d):
    out = oc.balance_correction(*balances(spark, d))
    return r6(out.select("holder_address", "correction_amount"), "correction_amount", digits=4)


@query(
    "backing_ratio",
    f"""WITH r AS (SELECT o_custkey, last(o_totalprice ORDER BY o_orderkey) AS reserves, max(o_orderkey) AS exchange_ts FROM orders GROUP BY 1),
s AS (SELECT c_custkey, greatest(c_acctbal, 0) AS supply FROM customer)
SELECT 'T' || c_custkey AS token_address, exchange_ts, {rnd('reserves')} AS reserves, {rnd('supply')} AS total_supply,
       {rnd('CASE WHEN supply > 0 THEN reserves / supply ELSE 1 END')} AS backing_ratio, CASE WHEN supply > 0 THEN reserves / supply >= 1 ELSE true END AS is_backed
FROM r JOIN s ON c_custkey = o_custkey""",
)
def backing_ratio(spark, d):
    """The last order of a customer backs the positive account balance."""
    token = F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("token_address")
    reserves = table(spark, d, "orders").select(
        token, F.col("o_orderkey").alias("ts"), (F.col("o_totalprice") * 100).alias("raw_reserves"), F.lit(2).alias("feed_decimals")
    )
    supplies = table(spark, d, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("token_address"),
        F.lit(0).alias("ts"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10_000).alias("raw_supply"),
        F.lit(4).alias("token_decimals"),
    )
    out = oc.backing_ratio(reserves, supplies)
    return r6(out.select("token_address", "exchange_ts", "reserves", "total_supply", "backing_ratio", "is_backed"), "reserves", "total_supply", "backing_ratio")
