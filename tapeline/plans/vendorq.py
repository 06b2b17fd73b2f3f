"""Queries: vendor payloads, rendered from the driver tables by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.timefns import micros_to_ns
from tapeline.operators.facts import facts_latest
from tapeline.plans.registry import query, r6, rnd, table
from tapeline.session import scratch_path
from tapeline.sources import vendors as vn

OHLC = ["open", "high", "low", "close", "volume"]


def text(col):
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def iso(col, days: int = 0):
    return F.date_format(F.date_add(col, days), "yyyy-MM-dd")


def obj(**fields):
    """A JSON object of the given columns."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def json_list(*items):
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def orders(spark, d):
    return table(spark, d, "orders")


def lineitem(spark, d):
    return table(spark, d, "lineitem")


@query(
    "src_eod_csv",
    f"""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '^IDX' ELSE 'S' || o_custkey END AS symbol, o_orderpriority = '1-URGENT' AS is_index,
       epoch_us(o_orderdate) * 1000 AS source_ts, CASE WHEN o_orderpriority <> '1-URGENT' THEN {rnd('o_totalprice + 1')} END AS high,
       {rnd('o_totalprice')} AS close, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'P' THEN 0.0 ELSE CAST(o_orderkey AS DOUBLE) END AS volume
FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def src_eod_csv(spark, d):
    """Finished orders use the compact date, low priorities an unreadable one."""
    pri = F.col("o_orderpriority")
    price = F.col("o_totalprice")
    date = (
        F.when(pri == "5-LOW", "n/a")
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMMdd"))
        .otherwise(iso("o_orderdate"))
    )
    rows = orders(spark, d).select(
        F.when(pri == "1-URGENT", "^IDX").otherwise(F.concat(F.lit("S"), text("o_custkey"))).alias("symbol"),
        date.alias("date"),
        text(price).alias("open"),
        text(price + 1).alias("high"),
        text(price - 1).alias("low"),
        text(price).alias("close"),
        F.when(F.col("o_orderstatus") != "P", text("o_orderkey")).alias("volume"),
    )
    bars, index = vn.src_eod_csv(rows)
    bars = bars.select("symbol", F.lit(False).alias("is_index"), "source_ts", "high", "close", "volume")
    index = index.select("symbol", F.lit(True).alias("is_index"), "source_ts", F.col("value").alias("close"))
    return r6(bars.unionByName(index, allowMissingColumns=True), "high", "close", "volume")


@query(
    "src_eod_csv_files",
    """SELECT 'PART' AS symbol, epoch_us(o_orderdate) * 1000 AS source_ts, round(o_totalprice + 2.7e-8, 6) AS close,
       round(CAST(o_orderkey AS DOUBLE) + 2.7e-8, 6) AS volume FROM orders""",
)
def src_eod_csv_files(spark, d):
    """Files of both header styles in one folder."""
    path = scratch_path(spark, "eod")
    rows = orders(spark, d)
    price = F.col("o_totalprice")

    def write(status, date, names):
        cols = [date, price, price + 1, price - 1, price, F.col("o_orderkey")]
        part = rows.where(status).select(*[c.alias(n) for c, n in zip(cols, names)])
        part.write.mode("append").option("header", True).csv(path)

    finished = F.col("o_orderstatus") == "F"
    write(finished, F.date_format("o_orderdate", "yyyyMMdd"), [h[0] for h in vn.EOD_HEADERS.values()])
    write(~finished, iso("o_orderdate"), [h[1] for h in vn.EOD_HEADERS.values()])
    bars, _ = vn.src_eod_csv(vn.read_eod_csv(spark, path))
    # the file names are Spark's own: part-...
    symbol = F.substring_index("symbol", "-", 1).alias("symbol")
    return r6(bars.select(symbol, "source_ts", "close", "volume"), "close", "volume")


def _fact(val, end, filed, **more):
    return obj(val=val, end=end, fy=F.year("o_orderdate"), fp=F.lit("FY"), form=F.lit("10-K"), filed=filed, **more)


def facts_payloads(spark, d):
    """One facts file per order: a value, its restatement and one in a bad shape."""
    o = orders(spark, d)
    end = F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31"))
    first = _fact(F.col("o_totalprice"), end, iso("o_orderdate"))
    again = _fact(F.col("o_totalprice") * 2, end, iso("o_orderdate", 30), frame=F.lit("CY"))
    odd = obj(val=F.lit("n/a"), end=end, fp=F.lit("H1"))
    values = json_list(first, again)
    payload = F.concat(
        F.lit('{"cik":1,"facts":{"us-gaap":{"Revenues":{"units":{"USD":'),
        values,
        F.lit('}}},"dei":{"Shares":{"units":{"shares":'),
        json_list(odd),
        F.lit("}}}}}"),
    )
    broken = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_orderkey").alias("cik"),
        F.when(broken, F.left(payload, F.lit(25))).otherwise(payload).alias("payload"),
    )


FACT_ROWS = """f AS (SELECT 'CIK' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS symbol, o_totalprice, o_orderdate,
  year(o_orderdate) || '-12-31' AS "end" FROM orders WHERE o_orderpriority <> '5-LOW')"""


@query(
    "src_company_facts",
    f"""WITH {FACT_ROWS}
SELECT symbol, 'us-gaap' AS taxonomy, 'Revenues' AS tag, 'USD' AS unit, {rnd('o_totalprice')} AS val, "end", 'FY' AS fp,
       strftime(o_orderdate, '%Y-%m-%d') AS filed, NULL AS frame FROM f
UNION ALL SELECT symbol, 'us-gaap', 'Revenues', 'USD', {rnd('o_totalprice * 2')}, "end", 'FY', strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d'), 'CY' FROM f
UNION ALL SELECT symbol, 'dei', 'Shares', 'shares', {rnd('0.0::DOUBLE')}, "end", NULL, NULL, NULL FROM f""",
)
def src_company_facts(spark, d):
    out = vn.src_company_facts(facts_payloads(spark, d))
    return r6(out.select("symbol", "taxonomy", "tag", "unit", "val", "end", "fp", "filed", "frame"), "val")


@query(
    "company_facts_latest",
    f"""WITH {FACT_ROWS} SELECT symbol, 'Revenues' AS tag, {rnd('o_totalprice * 2')} AS val FROM f
UNION ALL SELECT symbol, 'Shares', {rnd('0.0::DOUBLE')} FROM f""",
)
def company_facts_latest(spark, d):
    """Decoding and restatement in one plan."""
    latest = facts_latest(vn.src_company_facts(facts_payloads(spark, d)), ord="ord")
    return r6(latest.select("symbol", "tag", "val"), "val")


@query(
    "src_filings",
    """SELECT 'S' || o_custkey AS symbol, 'A-' || o_orderkey || '-' || k AS accession_number, CASE WHEN k = 1 THEN '10-K' ELSE '' END AS form,
       strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CASE WHEN k = 1 THEN o_orderkey || '.htm' ELSE '' END AS primary_document,
       CASE WHEN k = 1 THEN 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/A' || o_orderkey || k || '/' || o_orderkey || '.htm' ELSE '' END AS document_url,
       CASE WHEN k = 1 THEN o_orderstatus = 'F' END AS is_xbrl FROM orders, (VALUES (1), (2)) v(k)""",
)
def src_filings(spark, d):
    """Two filings per order; the arrays of forms, documents and flags stop after one."""
    key = text("o_orderkey")
    accession = [F.concat(F.lit("A-"), key, F.lit(f"-{k}")) for k in (1, 2)]
    o = orders(spark, d).select(
        F.concat(F.lit("S"), text("o_custkey")).alias("symbol"),
        F.col("o_custkey").alias("cik"),
        obj(
            accessionNumber=F.array(*accession),
            form=F.array(F.lit("10-K")),
            filingDate=F.array(iso("o_orderdate"), iso("o_orderdate")),
            primaryDocument=F.array(F.concat(key, F.lit(".htm"))),
            isXBRL=F.array((F.col("o_orderstatus") == "F").cast("int")),
        ).alias("payload"),
    )
    return vn.src_filings(o).select(
        "symbol", "accession_number", "form", "filing_date", "primary_document", "document_url", "is_xbrl"
    )


@query(
    "src_ticker_map",
    """SELECT c_custkey AS cik, upper(t) AS ticker, k = 0 AS is_primary
FROM customer, LATERAL (VALUES (0, 'a' || c_custkey), (1, 'b' || c_custkey)) v(k, t)""",
)
def src_ticker_map(spark, d):
    """Two tickers per customer; the first is primary."""
    key = F.col("c_custkey")

    def entry(mark):
        return obj(cik_str=key, ticker=F.concat(F.lit(mark), text(key)))

    payload = F.concat(F.lit('{"0":'), entry("a"), F.lit(',"1":'), entry("b"), F.lit("}"))
    rows = table(spark, d, "customer").select(payload.alias("payload"))
    return vn.src_ticker_map(rows).select("cik", "ticker", "is_primary")


@query(
    "src_eod_json",
    f"""SELECT 'S' || o_orderkey AS symbol, 'bar' AS kind, epoch_us(o_orderdate) * 1000 AS source_ts, '1w' AS label, {rnd('o_totalprice')} AS value FROM orders
UNION ALL SELECT 'S' || o_orderkey, 'dividend_cash', epoch_us(o_orderdate) * 1000, strftime(o_orderdate, '%Y-%m-%d'), {rnd('0.25::DOUBLE')} FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'S' || o_orderkey, 'split', epoch_us(o_orderdate) * 1000, strftime(o_orderdate, '%Y-%m-%d'), {rnd('2.0::DOUBLE')} FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def src_eod_json(spark, d):
    price = F.col("o_totalprice")
    row = obj(
        date=F.concat(iso("o_orderdate"), F.lit("T00:00:00.000Z")),
        open=price,
        high=price,
        low=price,
        close=price,
        volume=F.lit(1.0),
        divCash=F.when(F.col("o_orderstatus") == "F", 0.25).otherwise(0.0),
        splitFactor=F.when(F.col("o_orderpriority") == "2-HIGH", 2.0).otherwise(1.0),
    )
    payloads = orders(spark, d).select(
        F.concat(F.lit("s"), text("o_orderkey")).alias("ticker"), json_list(row).alias("payload")
    )
    bars, actions = vn.src_eod_json(payloads, frequency="weekly")
    bars = bars.select("symbol", F.lit("bar").alias("kind"), "source_ts", F.col("interval").alias("label"), F.col("close").alias("value"))
    actions = actions.select("symbol", F.col("type").alias("kind"), "source_ts", F.col("ex_date").alias("label"), "value")
    return r6(bars.unionByName(actions), "value")


def price_frame(spark, d):
    """orders as a price frame; pending ones have no volume."""
    price = F.col("o_totalprice")
    nan = F.lit(float("nan"))
    return orders(spark, d).select(
        F.concat(F.lit("S"), text("o_orderkey")).alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        price.alias("Open"),
        (price + 1).alias("High"),
        (price - 1).alias("Low"),
        price.alias("Close"),
        F.when(F.col("o_orderstatus") == "P", nan).otherwise(F.col("o_orderkey").cast("double")).alias("Volume"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).otherwise(0.0).alias("Dividends"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 3.0).otherwise(nan).alias("Stock Splits"),
    )


@query(
    "src_eod_actions",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT 'S' || o_orderkey AS symbol, 'bar' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS date, {rnd('o_totalprice')} AS value FROM o
UNION ALL SELECT 'S' || o_orderkey, 'dividend_cash', strftime(o_orderdate, '%Y-%m-%d'), {rnd('0.5::DOUBLE')} FROM o WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'S' || o_orderkey, 'split', strftime(o_orderdate, '%Y-%m-%d'), {rnd('3.0::DOUBLE')} FROM o WHERE o_orderpriority = '2-HIGH'""",
)
def src_eod_actions(spark, d):
    from tapeline.functions.timefns import date_from_ns

    bars, actions = vn.src_eod_actions(price_frame(spark, d))
    bars = bars.select("symbol", F.lit("bar").alias("kind"), date_from_ns(F.col("source_ts")).alias("date"), F.col("close").alias("value"))
    actions = actions.select("symbol", F.col("type").alias("kind"), F.col("ex_date").alias("date"), "value")
    return r6(bars.unionByName(actions), "value")


@query(
    "src_intraday_bars",
    f"""SELECT 'S' || o_orderkey AS symbol, epoch_us(o_orderdate) * 1000 AS source_ts, '5m' AS interval, {rnd('o_totalprice + 1')} AS high,
       {rnd('CAST(o_orderkey AS DOUBLE)')} AS volume FROM orders WHERE o_orderstatus <> 'P'""",
)
def src_intraday_bars(spark, d):
    bars = vn.src_intraday_bars(price_frame(spark, d), "5m")
    return r6(bars.select("symbol", "source_ts", "interval", "high", "volume"), "high", "volume")


@query(
    "src_option_chain",
    f"""SELECT 'C-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS symbol, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS type,
       {rnd('l_quantity')} AS strike, CASE WHEN l_discount > 0 THEN {rnd('l_discount')} END AS bid, {rnd('l_tax')} AS ask,
       epoch_us(l_shipdate) * 1000 AS source_ts FROM lineitem WHERE l_returnflag <> 'R'""",
)
def src_option_chain(spark, d):
    """Returned items have no strike and undiscounted ones no bid."""
    nan = F.lit(float("nan"))
    frame = lineitem(spark, d).select(
        F.concat_ws("-", F.lit("C"), "l_orderkey", "l_linenumber", "l_partkey").alias("contractSymbol"),
        F.col("l_shipdate").alias("lastTradeDate"),
        F.lit("U").alias("underlying"),
        F.lit("2024-01-19").alias("expiry"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(nan).alias("strike"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(nan).alias("bid"),
        F.col("l_tax").alias("ask"),
        *[F.lit(1.0).alias(c) for c in ("lastPrice", "volume", "openInterest", "impliedVolatility")],
        "l_linestatus",
    )
    calls = frame.where("l_linestatus = 'O'").drop("l_linestatus")
    puts = frame.where("l_linestatus <> 'O'").drop("l_linestatus")
    out = vn.src_option_chain(calls, puts)
    return r6(out.select("symbol", "type", "strike", "bid", "ask", "source_ts"), "strike", "bid", "ask")


STATEMENT_DATES = ("2023-12-31", "2024-05-31")


@query(
    "src_statements",
    f"""WITH cells AS (
  SELECT 'S' || c_custkey AS symbol, c_mktsegment AS tag, e, CASE WHEN e = DATE '2023-12-31' OR c_nationkey < 20 THEN c_acctbal END AS val
  FROM customer, (VALUES (DATE '2023-12-31'), (DATE '2024-05-31')) v(e)),
rows AS (SELECT * FROM cells WHERE val IS NOT NULL)
SELECT symbol, tag, '10-K' AS form, 'FY' AS fp, CAST(e AS VARCHAR) AS "end", CAST(CAST(e - INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS start, {rnd('val')} AS val FROM rows
UNION ALL SELECT symbol, tag, '10-Q', 'Q' || quarter(e), CAST(e AS VARCHAR), NULL, {rnd('val')} FROM rows
UNION ALL SELECT symbol, tag, '10-Q', 'Q' || quarter(e), CAST(e AS VARCHAR), CAST(CAST(e - INTERVAL 3 MONTH AS DATE) AS VARCHAR), {rnd('val')} FROM rows""",
)
def src_statements(spark, d):
    """Customers as statement lines of two period ends, one of them with holes."""
    bal = F.col("c_acctbal")
    frame = table(spark, d, "customer").select(
        F.concat(F.lit("S"), text("c_custkey")).alias("symbol"),
        F.col("c_mktsegment").alias("tag"),
        bal.alias(STATEMENT_DATES[0]),
        F.when(F.col("c_nationkey") < 20, bal).otherwise(F.lit(float("nan"))).alias(STATEMENT_DATES[1]),
    )
    out = vn.src_statements(
        {"annual_financials": frame, "quarterly_balance_sheet": frame, "quarterly_cashflow": frame}
    )
    return r6(out.select("symbol", "tag", "form", "fp", "end", "start", "val"), "val")


@query(
    "src_insider",
    f"""SELECT 'S' || o_custkey AS symbol, 'N' || o_orderkey AS insider_name, CASE WHEN o_orderpriority = '2-HIGH' THEN 'Unknown' ELSE o_orderpriority END AS position,
       strftime(o_orderdate, '%Y-%m-%d') AS transaction_date, {rnd('CAST(o_orderkey AS DOUBLE)')} AS shares,
       CASE WHEN o_orderkey > 0 THEN {rnd('o_totalprice / o_orderkey')} END AS price FROM orders WHERE o_orderstatus <> 'P'""",
)
def src_insider(spark, d):
    """Pending orders lack the kind of transaction, high priorities the position."""
    pri = F.col("o_orderpriority")
    frame = orders(spark, d).select(
        F.concat(F.lit("S"), text("o_custkey")).alias("symbol"),
        F.concat(F.lit(" N"), text("o_orderkey")).alias("Insider"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("Transaction"),
        F.when(pri != "2-HIGH", pri).alias("Position"),
        F.col("o_orderdate").alias("Start Date"),
        F.col("o_orderkey").cast("double").alias("Shares"),
        F.col("o_totalprice").alias("Value"),
        F.lit("D").alias("Ownership"),
    )
    out = vn.src_insider(frame)
    return r6(out.select("symbol", "insider_name", "position", "transaction_date", "shares", "price"), "shares", "price")


def message_frames(spark, d):
    """Each event as a frame with a trade, a quote, a bar and an item without a price."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    sym = F.concat(F.lit("U"), text("user_id"))
    value = F.col("value")
    tape = F.when(F.col("event_type") == "click", "A").otherwise("Q")
    trade = obj(T=F.lit("t"), S=sym, t=stamp, i=F.col("event_id"), p=value, s=F.lit(2.0), x=F.lit("V"), c=F.array(F.lit("@")), z=tape)
    quote = obj(T=F.lit("q"), S=sym, t=stamp, bp=value, bs=F.lit(1.0), ap=value + 1, **{"as": F.lit(3.0)}, z=tape)
    bar = obj(T=F.lit("b"), S=sym, t=stamp, o=value, h=value + 1, l=value - 1, c=value, v=F.lit(5.0), n=F.lit(4))
    bad = obj(T=F.lit("t"), S=sym, t=stamp, s=F.lit(2.0))
    ev = table(spark, d, "events")
    return ev.select(micros_to_ns(F.col("ts")).alias("local_ts"), json_list(trade, quote, bar, bad).alias("payload"))


@query(
    "src_trade_quote_bar_frames",
    f"""WITH e AS (SELECT 'U' || user_id AS symbol, epoch_us(ts) * 1000 AS source_ts, value, CASE WHEN event_type = 'click' THEN 'A' ELSE 'unknown' END AS tape, event_id FROM events)
SELECT 'trade' AS channel, symbol, source_ts, CAST(event_id AS VARCHAR) AS id, {rnd('value')} AS a, {rnd('2.0::DOUBLE')} AS b, tape, '@' AS cond FROM e
UNION ALL SELECT 'quote', symbol, source_ts, NULL, {rnd('value')}, {rnd('value + 1')}, tape, NULL FROM e
UNION ALL SELECT 'bar', symbol, source_ts, NULL, {rnd('value + 1')}, {rnd('value')}, NULL, NULL FROM e""",
)
def src_trade_quote_bar_frames(spark, d):
    records = vn.trade_quote_bar_records(message_frames(spark, d))
    out = records.select(
        "channel",
        "symbol",
        "source_ts",
        "id",
        F.coalesce("price", "bid_px", "high").alias("a"),
        F.coalesce("size", "ask_px", "close").alias("b"),
        "tape",
        F.array_join("conditions", ",").alias("cond"),
    )
    return r6(out, "a", "b")


@query(
    "src_trade_frames",
    f"""SELECT 'U' || user_id AS symbol, (epoch_us(ts) // 1000 + k) * 1000000 AS source_ts, {rnd('value + k')} AS price
FROM events, (VALUES (0), (1)) v(k) WHERE event_type <> 'view'""",
)
def src_trade_frames(spark, d):
    """Two prints per frame; views are quote frames and yield nothing."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)

    def item(k):
        return F.struct(
            F.concat(F.lit("U"), text("user_id")).alias("s"), (F.col("value") + k).alias("p"), F.lit(1.0).alias("v"), (ms + k).alias("t")
        )

    kind = F.when(F.col("event_type") == "view", "quote").otherwise("trade")
    frames = table(spark, d, "events").select(
        micros_to_ns(F.col("ts")).alias("local_ts"), obj(type=kind, data=F.array(item(0), item(1))).alias("payload")
    )
    return r6(vn.src_trade_frames(frames).select("symbol", "source_ts", "price"), "price")


@query(
    "src_chart_series",
    f"""SELECT 'S' || o_orderkey AS symbol, epoch_us(o_orderdate) * 1000 + CAST(k AS BIGINT) * 86400000000000 * CASE WHEN o_orderpriority = '2-HIGH' THEN 7 ELSE 1 END AS source_ts,
       CASE o_orderstatus WHEN 'F' THEN '15m' WHEN 'O' THEN '1d' ELSE '1d' END AS interval, {rnd('CASE WHEN k < 2 THEN o_totalprice + k ELSE 0 END')} AS close,
       {rnd("CASE WHEN k = 0 THEN 1234.5 ELSE 0.0 END::DOUBLE")} AS volume
FROM orders, (VALUES (0), (1), (2)) v(k)""",
)
def src_chart_series(spark, d):
    """Three stamps, two prices and one volume per order; gaps of a week are ignored."""
    step = F.when(F.col("o_orderpriority") == "2-HIGH", 7).otherwise(1)
    stamps = F.array(
        *[F.concat(F.date_format(F.date_add("o_orderdate", step * k), "yyyy-MM-dd"), F.lit("T00:00:00Z")) for k in range(3)]
    )
    price = F.col("o_totalprice")
    series = obj(
        timeStamps=stamps,
        openPrices=F.array(text(price)),
        prices=F.array(text(price), text(price + 1)),
        pricesHigh=F.array(text(price)),
        pricesLow=F.array(text(price)),
        volumes=F.array(F.lit("1,234.5"), F.lit("N/A")),
    )
    kind = F.when(F.col("o_orderstatus") == "F", "5D").when(F.col("o_orderstatus") == "O", "1Y").otherwise("3M")
    charts = orders(spark, d).select(
        F.concat(F.lit("s"), text("o_orderkey")).alias("symbol"), kind.alias("chart_type"), series.alias("payload")
    )
    return r6(vn.src_chart_series(charts).select("symbol", "source_ts", "interval", "close", "volume"), "close", "volume")


@query(
    "src_split_text",
    f"""SELECT 'S' || o_orderkey AS symbol, 'dividend_cash' AS type, strftime(o_orderdate, '%Y-%m-%d') AS ex_date, {rnd('o_totalprice')} AS value FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'S' || o_orderkey, 'split', strftime(o_orderdate, '%Y-%m-%d'), {rnd("CASE o_orderpriority WHEN '1-URGENT' THEN 4.0 WHEN '2-HIGH' THEN 1.5 WHEN '3-MEDIUM' THEN 3.0 ELSE 2.0 END::DOUBLE")}
FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def src_split_text(spark, d):
    pri = F.col("o_orderpriority")
    factor = (
        F.when(pri == "1-URGENT", "4:1").when(pri == "2-HIGH", "3:2").when(pri == "3-MEDIUM", "3:0").when(pri == "5-LOW", "").otherwise("2")
    )
    stamp = F.concat(iso("o_orderdate"), F.lit("T00:00:00"))
    stats = orders(spark, d).select(
        F.concat(F.lit("s"), text("o_orderkey")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", F.format_number("o_totalprice", 2)).alias("exDividendAmount"),
        stamp.alias("exDividendDate"),
        factor.alias("lastSplitFactor"),
        stamp.alias("lastSplitDate"),
    )
    return r6(vn.src_split_text(stats).select("symbol", "type", "ex_date", "value"), "value")


METRIC_LABELS = {
    "1-URGENT": "Mkt. cap",
    "2-HIGH": "Dividend",
    "3-MEDIUM": "P/E ratio",
    "4-NOT SPECIFIED": "Ex-dividend date",
    "5-LOW": "No such label",
}


@query(
    "src_metric_text",
    f"""SELECT 'S' || o_orderkey AS symbol, CASE o_orderpriority WHEN '1-URGENT' THEN 'market_cap' WHEN '2-HIGH' THEN 'dividend_yield' WHEN '3-MEDIUM' THEN 'pe_ratio' ELSE 'ex_dividend_date' END AS tag,
       CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END WHEN '2-HIGH' THEN 'percent' WHEN '3-MEDIUM' THEN 'ratio' ELSE 'date' END AS unit,
       CASE o_orderpriority WHEN '1-URGENT' THEN round(o_totalprice, 2) * 1e6 WHEN '4-NOT SPECIFIED' THEN 0.0 ELSE round(o_totalprice, 2) END AS val,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS "end"
FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')""",
)
def src_metric_text(spark, d):
    pri, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    number = F.format_number("o_totalprice", 2)
    label = F.lit(None).cast("string")
    for name, shown in METRIC_LABELS.items():
        label = F.when(pri == name, shown).otherwise(label)
    body = (
        F.when(pri == "1-URGENT", F.concat(F.when(status == "F", "€").otherwise("$"), number, F.lit("M")))
        .when(pri == "2-HIGH", F.concat(number, F.lit("%")))
        .when(pri == "3-MEDIUM", F.when(status == "P", "—").otherwise(number))
        .otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    )
    metrics = orders(spark, d).select(
        F.concat(F.lit("s"), text("o_orderkey")).alias("symbol"), label.alias("label"), body.alias("text")
    )
    return r6(vn.src_metric_text(metrics).select("symbol", "tag", "unit", "val", "end"), "val", digits=2)


@query(
    "src_ticker_universe",
    "SELECT upper(c_name) AS ticker, c_mktsegment AS exchange FROM customer",
)
def src_ticker_universe(spark, d):
    path = scratch_path(spark, "universe")
    none = F.lit("x")
    table(spark, d, "customer").select(
        F.lower("c_name").alias("ticker"),
        F.col("c_mktsegment").alias("exchange"),
        *[none.alias(c) for c in ("assetType", "priceCurrency", "startDate", "endDate")],
    ).write.option("header", True).csv(path)
    return vn.src_ticker_universe(spark, path).select("ticker", "exchange")


@query(
    "src_identifier_map",
    """SELECT l.l_orderkey * 8 + l.l_linenumber AS ord, l.l_partkey, p.p_partkey AS figi_key
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size < 25 AND l.l_linestatus = CASE WHEN p.p_size < 10 THEN 'O' ELSE 'F' END""",
)
def src_identifier_map(spark, d):
    """Line items ask for their part; small parts are listed only without a qualifier."""
    none = F.lit(None).cast("string")
    rest = [none.alias(q) for q in vn.QUALIFIERS[1:]]
    open_ = F.col("l_linestatus") == "O"
    jobs = lineitem(spark, d).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.lit("ID").alias("id_type"),
        text("l_partkey").alias("id_value"),
        F.when(~open_, "US").alias("exch_code"),
        *rest,
    )
    mapping = table(spark, d, "part").where("p_size < 25").select(
        F.lit("ID").alias("id_type"),
        text("p_partkey").alias("id_value"),
        F.when(F.col("p_size") >= 10, "US").alias("exch_code"),
        *rest,
        F.col("p_partkey").alias("figi_key"),
    )
    out = vn.src_identifier_map(jobs, mapping)
    return out.select("ord", F.col("id_value").cast("long").alias("l_partkey"), "figi_key")


