"""Queries: coverage, facts, ratios, security master, symbols, calendar and schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import calendar as cal
from tapeline.functions import ratios as rt
from tapeline.functions import text as tx
from tapeline.functions.timefns import bucket_ns
from tapeline.operators import coverage as cov
from tapeline.operators import facts as fc
from tapeline.operators import schedule as sch
from tapeline.operators import security as sec
from tapeline.operators.symbols import symbol_resolve
from tapeline.plans.registry import query, r6, rnd, table
from tapeline.plans.roles import HOUR, TRADES, bucket_sql, trades

DAY = 24 * HOUR

# -- coverage ---------------------------------------------------------------------

PRIORITY = ["purchase", "click", "view"]


def provider_bars(spark, d):
    """One daily row per symbol and event type; clicks carry no volume, views no high."""
    p = F.col("provider")
    bars = trades(spark, d).groupBy("symbol", "provider", bucket_ns(F.col("local_ts"), DAY).alias("local_ts")).agg(
        F.max_by("price", "id").alias("close"), F.max("price").alias("high"), F.sum("size").alias("volume")
    )
    return bars.withColumns(
        {"high": F.when(p != "view", F.col("high")), "volume": F.when(~p.isin("click", "purchase"), F.col("volume"))}
    )


COVER = f"""{TRADES}, pb AS (
  SELECT symbol, provider, {bucket_sql('local_ts', DAY)} AS local_ts, last(price ORDER BY id) AS close,
         CASE WHEN provider <> 'view' THEN max(price) END AS high,
         CASE WHEN provider NOT IN ('click', 'purchase') THEN sum(size) END AS volume,
         CASE provider WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS rk
  FROM trades GROUP BY 1, 2, 3)"""


@query(
    "coverage_priority",
    f"""WITH {COVER} SELECT symbol, local_ts, provider, {rnd('close')} AS close, {rnd('high')} AS high, {rnd('volume')} AS volume
FROM pb QUALIFY row_number() OVER (PARTITION BY symbol, local_ts ORDER BY rk, provider) = 1""",
)
def coverage_priority(spark, d):
    return r6(cov.coverage_priority(provider_bars(spark, d), PRIORITY), "close", "high", "volume")


@query(
    "coverage_fill_nulls",
    f"""WITH {COVER} SELECT symbol, local_ts, first(provider ORDER BY rk, provider) AS provider,
       {rnd('first(close ORDER BY rk, provider) FILTER (close IS NOT NULL)')} AS close,
       {rnd('first(high ORDER BY rk, provider) FILTER (high IS NOT NULL)')} AS high,
       {rnd('first(volume ORDER BY rk, provider) FILTER (volume IS NOT NULL)')} AS volume
FROM pb GROUP BY 1, 2""",
)
def coverage_fill_nulls(spark, d):
    return r6(cov.coverage_fill_nulls(provider_bars(spark, d), PRIORITY), "close", "high", "volume")


# -- facts and ratios -------------------------------------------------------------


def order_facts(spark, d):
    """orders as facts of a customer: yearly values, restated by every later order."""
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    return o.select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.lit("orders").alias("taxonomy"),
        F.col("o_orderpriority").alias("tag"),
        F.lit("USD").alias("unit"),
        F.col("o_totalprice").alias("val"),
        F.concat(year.cast("string"), F.lit("-12-31")).alias("end"),
        year.cast("long").alias("fy"),
        F.when(F.col("o_orderstatus") == "F", "Q4").otherwise("FY").alias("fp"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM")).alias("filed"),
        F.when(F.col("o_orderstatus") == "O", F.lit("CY")).alias("frame"),
        F.col("o_orderkey").alias("ord"),
    )


FACTS = """facts AS (
  SELECT 'cust:' || o_custkey AS symbol, o_orderpriority AS tag, o_totalprice AS val, year(o_orderdate) || '-12-31' AS "end",
         year(o_orderdate) AS fy, CASE WHEN o_orderstatus = 'F' THEN 'Q4' ELSE 'FY' END AS fp, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m') END AS filed,
         CASE WHEN o_orderstatus = 'O' THEN 'CY' END AS frame, o_orderkey AS ord FROM orders),
latest AS (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY symbol, tag, "end", fp ORDER BY coalesce(filed, '') DESC, frame IS NOT NULL DESC, ord) = 1)"""


@query("facts_latest", f"""WITH {FACTS} SELECT symbol, tag, "end", fy, fp, val, filed, frame, ord FROM latest""")
def facts_latest(spark, d):
    out = fc.facts_latest(order_facts(spark, d), ord="ord")
    return out.select("symbol", "tag", "end", "fy", "fp", "val", "filed", "frame", "ord")


RATIO_TAGS = {
    "price": "1-URGENT",
    "eps": "2-HIGH",
    "book_value_per_share": "3-MEDIUM",
    "net_income": "2-HIGH",
    "book_value": "4-NOT SPECIFIED",
    "gross_profit": "3-MEDIUM",
    "operating_income": "4-NOT SPECIFIED",
    "revenue": "5-LOW",
}


def _tag(name):
    return f"max(val) FILTER (tag = '{RATIO_TAGS[name]}')"


@query(
    "ratios",
    f"""WITH {FACTS} SELECT symbol, "end", fy, fp, """
    + ", ".join(f"{rnd(f'{_tag(a)} / {_tag(b)}')} AS {n}" for n, (_, a, b) in rt.RATIOS.items())
    + """ FROM latest GROUP BY 1, 2, 3, 4""",
)
def ratios(spark, d):
    facts = order_facts(spark, d)
    latest = fc.facts_latest(facts, ord="ord")
    out = fc.ratios(latest, RATIO_TAGS, ord="ord")
    return r6(out.select("symbol", "end", "fy", "fp", *rt.RATIOS), *rt.RATIOS)


# -- security master --------------------------------------------------------------


def securities(spark, d):
    """part as the security master; many parts share a ticker."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    none = F.lit(None).cast("string")
    return p.select(
        F.concat(F.lit("SEC:"), key).alias("symbol"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("ticker"),
        F.col("p_brand").alias("exchange"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "CS").otherwise("unknown").alias("security_type"),
        tx.normalize_cik(F.col("p_size").cast("string")).alias("cik"),
        F.concat(F.lit("F"), key).alias("figi"),
        F.concat(F.lit("C"), key).alias("cusip"),
        none.alias("isin"),
        (F.col("p_size") < 40).alias("is_active"),
        F.lit("2024-01-01T00:00:00").alias("created_at"),
        F.lit("2024-01-01T00:00:00").alias("updated_at"),
    )


SEC = """master AS (
  SELECT 'SEC:' || p_partkey AS symbol, upper(replace(p_name, ' ', '_')) AS ticker, p_brand AS exchange, p_name AS name,
         CASE WHEN p_type = 'ECONOMY' THEN 'CS' ELSE 'unknown' END AS security_type, lpad(CAST(p_size AS VARCHAR), 10, '0') AS cik,
         'F' || p_partkey AS figi, 'C' || p_partkey AS cusip, p_size < 40 AS is_active,
         '2024-01-01T00:00:00' AS created_at, '2024-01-01T00:00:00' AS updated_at, p_size FROM part)"""


def security_changes(spark, d):
    """Small parts change their name and move to a supplier's venue; suppliers are new."""
    old = securities(spark, d).join(
        table(spark, d, "part").where("p_size < 10").select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("figi")),
        "figi",
        "left_semi",
    )
    late = F.lit("2024-06-01T00:00:00")
    changed = old.withColumns(
        {"symbol": F.lower("symbol"), "name": F.upper("name"), "created_at": late, "updated_at": late}
    )
    s = table(spark, d, "supplier")
    none = F.lit(None).cast("string")
    new = s.select(
        F.concat(F.lit("NEW:"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("ticker"),
        none.alias("exchange"),
        F.col("s_name").alias("name"),
        F.lit("ETF").alias("security_type"),
        *[none.alias(c) for c in ("cik", "figi", "cusip", "isin")],
        F.lit(True).alias("is_active"),
        late.alias("created_at"),
        late.alias("updated_at"),
    )
    return changed.unionByName(new)


@query(
    "security_upsert",
    f"""WITH {SEC} SELECT symbol, ticker, exchange, CASE WHEN p_size < 10 THEN upper(name) ELSE name END AS name, security_type, is_active,
       created_at, CASE WHEN p_size < 10 THEN '2024-06-01T00:00:00' ELSE updated_at END AS updated_at FROM master
UNION ALL SELECT 'NEW:' || s_suppkey, s_name, NULL, s_name, 'ETF', true, '2024-06-01T00:00:00', '2024-06-01T00:00:00' FROM supplier""",
)
def security_upsert(spark, d):
    out = sec.security_upsert(securities(spark, d), security_changes(spark, d))
    return out.select("symbol", "ticker", "exchange", "name", "security_type", "is_active", "created_at", "updated_at")


@query(
    "mapping_add",
    f"""WITH {SEC} SELECT ticker, symbol, exchange FROM master
UNION ALL SELECT 'ALT_' || ticker, symbol, CAST(NULL AS VARCHAR) FROM master""",
)
def mapping_add(spark, d):
    m = sec.mappings_of(securities(spark, d))
    alt = m.select(F.concat(F.lit("ALT_"), F.col("ticker")).alias("ticker"), "symbol", F.lit(None).cast("string").alias("exchange"))
    same = m.select(F.lower("ticker").alias("ticker"), F.lower("symbol").alias("symbol"), "exchange")
    return sec.mapping_add(sec.mapping_add(m, alt), same)


@query("mapping_remove", f"WITH {SEC} SELECT ticker, symbol, exchange FROM master WHERE is_active")
def mapping_remove(spark, d):
    s = securities(spark, d)
    gone = s.where("NOT is_active").select(F.lower("ticker").alias("ticker"), "symbol")
    return sec.mapping_remove(sec.mappings_of(s), gone)


@query(
    "security_lookup",
    f"""WITH {SEC}
SELECT 'cik' AS field, c.cik AS request, m.symbol FROM (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik FROM customer) c JOIN master m USING (cik)
UNION ALL SELECT 'symbol', lower('SEC:' || s_suppkey), m.symbol FROM supplier JOIN master m ON m.symbol = 'SEC:' || s_suppkey
UNION ALL SELECT 'figi', m.figi, m.symbol FROM supplier JOIN master m ON m.figi = 'F' || s_suppkey
UNION ALL SELECT 'cusip', m.cusip, m.symbol FROM supplier JOIN master m ON m.cusip = 'C' || s_suppkey""",
)
def security_lookup(spark, d):
    """Bulk lookups by every key: requests come from customers and suppliers."""
    m = securities(spark, d)
    key = F.col("s_suppkey").cast("string")
    supp = table(spark, d, "supplier").select(
        F.lower(F.concat(F.lit("SEC:"), key)).alias("symbol"),
        F.concat(F.lit("F"), key).alias("figi"),
        F.concat(F.lit("C"), key).alias("cusip"),
    )
    cik = table(spark, d, "customer").select(tx.normalize_cik(F.col("c_nationkey").cast("string")).alias("cik"))
    out = None
    for field, asked in (("cik", cik), ("symbol", supp), ("figi", supp), ("cusip", supp)):
        hit = sec.security_lookup(asked, m, field).select(F.lit(field).alias("field"), "request", "symbol")
        out = hit if out is None else out.unionByName(hit)
    return out


ASKED = """asked AS (
  SELECT DISTINCT lower(upper(replace(p_name, ' ', '_'))) AS ticker, CASE WHEN p_size < 25 THEN 'Brand#1' END AS want FROM part)"""


def ticker_requests(spark, d):
    return table(spark, d, "part").select(
        F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("ticker"),
        F.when(F.col("p_size") < 25, "Brand#1").alias("exchange"),
    ).distinct()


@query(
    "ticker_lookup",
    f"""WITH {SEC}, {ASKED} SELECT DISTINCT a.ticker AS request, m.symbol FROM asked a JOIN master m ON lower(m.ticker) = a.ticker
WHERE a.want IS NULL OR m.exchange = a.want""",
)
def ticker_lookup(spark, d):
    s = securities(spark, d)
    return sec.ticker_lookup(ticker_requests(spark, d), s, sec.mappings_of(s)).select("request", "symbol")


@query(
    "resolve_ticker",
    f"""WITH {SEC}, {ASKED}, maps AS (
  SELECT ticker, symbol, exchange FROM master WHERE p_size >= 5 UNION ALL SELECT ticker, symbol, NULL FROM master WHERE p_size < 5)
SELECT a.ticker, a.want AS exchange,
       first(m.symbol ORDER BY CASE WHEN m.exchange = a.want THEN 0 ELSE 1 END, m.symbol)
         FILTER (m.symbol IS NOT NULL AND (a.want IS NULL OR m.exchange IS NULL OR m.exchange = a.want)) AS symbol
FROM asked a LEFT JOIN maps m ON lower(m.ticker) = a.ticker GROUP BY 1, 2""",
)
def resolve_ticker(spark, d):
    p = table(spark, d, "part").select(
        F.concat(F.lit("SEC:"), F.col("p_partkey").cast("string")).alias("symbol"), "p_size"
    )
    m = sec.mappings_of(securities(spark, d)).join(p, "symbol")
    maps = m.select("ticker", "symbol", F.when(F.col("p_size") >= 5, F.col("exchange")).alias("exchange"))
    return sec.resolve_ticker(ticker_requests(spark, d), maps)


@query(
    "security_status",
    f"""WITH {SEC} SELECT symbol, CASE WHEN p_size < 10 THEN false ELSE is_active END AS is_active,
       CASE WHEN p_size < 10 THEN '2024-07-01' ELSE updated_at END AS updated_at FROM master""",
)
def security_status(spark, d):
    change = table(spark, d, "part").where("p_size < 10").select(
        F.lower(F.concat(F.lit("SEC:"), F.col("p_partkey").cast("string"))).alias("symbol"),
        F.lit(False).alias("is_active"),
        F.lit("2024-07-01").alias("updated_at"),
    )
    return sec.security_status(securities(spark, d), change).select("symbol", "is_active", "updated_at")


@query("security_list", f"WITH {SEC} SELECT symbol, name FROM master WHERE is_active")
def security_list(spark, d):
    return sec.security_list(securities(spark, d)).select("symbol", "name")


@query(
    "instrument_enrich",
    f"""WITH {SEC}, raw AS (SELECT DISTINCT l_returnflag AS provider, upper(replace(p_name, ' ', '_')) AS symbol_raw
  FROM lineitem JOIN part ON p_partkey = l_partkey),
first_of AS (SELECT ticker, min(symbol) AS symbol FROM master GROUP BY 1)
SELECT r.provider, r.symbol_raw, CASE WHEN r.provider = 'R' THEN 'own:' || r.symbol_raw ELSE f.symbol END AS symbol,
       CASE WHEN r.provider = 'R' THEN NULL ELSE m.figi END AS figi
FROM raw r LEFT JOIN first_of f ON f.ticker = r.symbol_raw LEFT JOIN master m ON m.symbol = f.symbol""",
)
def instrument_enrich(spark, d):
    """Returned items are known to their provider; the rest comes from the master."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    raw = li.join(p, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_returnflag").alias("provider"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("symbol_raw")
    ).distinct()
    none = F.lit(None).cast("string")
    known = raw.where("provider = 'R'").select(
        "provider",
        "symbol_raw",
        F.concat(F.lit("own:"), F.col("symbol_raw")).alias("symbol"),
        *[none.alias(c) for c in ("security_type", "name", "exchange", "cik", "figi", "cusip")],
    )
    s = securities(spark, d)
    return sec.instrument_enrich(raw, known, s, sec.mappings_of(s)).select("provider", "symbol_raw", "symbol", "figi")


TYPED = ["ev:17", "EV:17", "17", "SIGNUP", " ", "yahoo: msft ", "li:3", "zzz", "99"]


@query(
    "symbol_resolve",
    """WITH typed(ord, input) AS (VALUES (0, 'ev:17'), (1, 'EV:17'), (2, '17'), (3, 'SIGNUP'), (5, 'yahoo: msft'), (6, 'li:3'), (7, 'zzz'), (8, '99')),
symbols AS (SELECT DISTINCT 'ev:' || user_id AS symbol FROM events UNION SELECT DISTINCT event_type FROM events),
hits AS (
  SELECT ord, symbol, CASE WHEN symbol = input THEN 0 WHEN lower(symbol) = lower(input) THEN 1
         WHEN lower(split_part(symbol, ':', 2)) = lower(input) AND contains(symbol, ':') THEN 2
         WHEN contains(lower(symbol), lower(input)) THEN 3 END AS kind
  FROM typed, symbols WHERE NOT contains(input, ':')),
best AS (SELECT ord, symbol FROM hits WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY kind, symbol) = 1)
SELECT CAST(t.ord AS INTEGER) AS ord, input, CASE WHEN contains(input, ':') THEN split_part(input, ':', 1) || ':' || upper(trim(split_part(input, ':', 2)))
       ELSE coalesce(best.symbol, 'alpaca:' || upper(input)) END AS symbol FROM typed t LEFT JOIN best ON best.ord = t.ord""",
)
def symbols(spark, d):
    """What a user may type, resolved against all symbols of the events."""
    t = trades(spark, d)
    known = t.select("symbol").union(t.select("provider")).distinct()
    return symbol_resolve(spark, TYPED, known)


@query(
    "normalize_cik",
    """SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cik FROM orders""",
)
def normalize_cik(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("CIK 0"), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), tx.normalize_cik(text).alias("cik"))


@query(
    "safe_float",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE {rnd('o_totalprice')} END AS value FROM orders""",
)
def safe_float(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(
        F.concat(F.lit(" "), F.format_number("o_totalprice", 2))
    )
    return r6(o.select(F.col("o_orderkey").alias("id"), tx.safe_float(text).alias("value")), "value")


@query(
    "parse_date_text",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""",
)
def parse_date_text(spark, d):
    """Each priority writes the date its own way."""
    day, pri = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(pri == "1-URGENT", F.date_format(day, "MMM d, yyyy"))
        .when(pri == "2-HIGH", F.date_format(day, "MMMM d, yyyy"))
        .when(pri == "3-MEDIUM", F.date_format(day, "d MMMM yyyy"))
        .when(pri == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd"))
        .otherwise("soon")
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.parse_date_text(text).alias("date"))


# -- calendar ---------------------------------------------------------------------

# weekday with Monday 0, nth weekday of a month, observed date
_WD = "(isodow({0}) - 1)"


def _nth_sql(month: int, weekday: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + CAST(({weekday} - (isodow({first}) - 1) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


def _observed_sql(month: int, day: int) -> str:
    date = f"make_date(y, {month}, {day})"
    return f"{date} + CASE isodow({date}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END"


CALENDAR = f"""days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
e1 AS (SELECT DISTINCT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM days),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3),
easter AS (SELECT y, make_date(y, CAST(n // 31 AS INTEGER), CAST(n % 31 + 1 AS INTEGER)) AS day FROM e4),
holidays AS (
  SELECT y, day - 2 AS date FROM easter
  UNION ALL SELECT y, {_observed_sql(1, 1)} FROM easter
  UNION ALL SELECT y, make_date(y, 12, 31) FROM easter WHERE isodow(make_date(y + 1, 1, 1)) = 6
  UNION ALL SELECT y, {_nth_sql(1, 0, 3)} FROM easter WHERE y >= 1998
  UNION ALL SELECT y, {_nth_sql(2, 0, 3)} FROM easter
  UNION ALL SELECT y, make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM easter
  UNION ALL SELECT y, {_observed_sql(6, 19)} FROM easter WHERE y >= 2022
  UNION ALL SELECT y, {_observed_sql(7, 4)} FROM easter
  UNION ALL SELECT y, {_nth_sql(9, 0, 1)} FROM easter
  UNION ALL SELECT y, {_nth_sql(11, 3, 4)} FROM easter
  UNION ALL SELECT y, {_observed_sql(12, 25)} FROM easter),
marked AS (
  SELECT date, y, date IN (SELECT h.date FROM holidays h) AS is_holiday,
         date = {_nth_sql(11, 3, 4)} + 1
         OR (month(date) = 12 AND day(date) = 24 AND isodow(make_date(y, 12, 25)) <> 6 AND isodow(date) < 6)
         OR (month(date) = 7 AND day(date) = 3 AND isodow(make_date(y, 7, 4)) < 6) AS is_early_close
  FROM days)"""


def order_days(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


@query("holidays", f"WITH {CALENDAR} SELECT date FROM marked WHERE is_holiday")
def holidays(spark, d):
    return order_days(spark, d).where(cal.is_holiday(F.col("date")))


@query("early_close", f"WITH {CALENDAR} SELECT date FROM marked WHERE is_early_close")
def early_close(spark, d):
    return order_days(spark, d).where(cal.is_early_close(F.col("date")))


@query("trading_day", f"WITH {CALENDAR} SELECT date, isodow(date) < 6 AND NOT is_holiday AS is_trading_day FROM marked")
def trading_day(spark, d):
    return order_days(spark, d).select("date", cal.is_trading_day(F.col("date")).alias("is_trading_day"))


@query(
    "market_hours",
    f"""WITH {CALENDAR}, dst AS (
  SELECT date, y, is_early_close, isodow(date) < 6 AND NOT is_holiday AS trading,
         date >= {_nth_sql(4, 6, 1)} AND date < make_date(y, 10, 31) - CAST(isodow(make_date(y, 10, 31)) % 7 AS INTEGER) AS summer FROM marked)
SELECT date, CASE WHEN trading THEN 570 END AS open_minute, CASE WHEN trading THEN CASE WHEN is_early_close THEN 780 ELSE 960 END END AS close_minute,
       CASE WHEN trading THEN strftime(CAST(date AS TIMESTAMP) + to_minutes(570 + CASE WHEN summer THEN 240 ELSE 300 END), '%Y-%m-%d %H:%M') END AS open_utc,
       CASE WHEN trading THEN strftime(CAST(date AS TIMESTAMP) + to_minutes(CASE WHEN is_early_close THEN 780 ELSE 960 END + CASE WHEN summer THEN 240 ELSE 300 END), '%Y-%m-%d %H:%M') END AS close_utc
FROM dst""",
)
def market_hours(spark, d):
    """Daylight saving ran from April's first to October's last Sunday in these years."""
    c = order_days(spark, d).withColumns(cal.calendar_columns(F.col("date")))
    return c.select(
        "date",
        "open_minute",
        "close_minute",
        F.date_format("open_utc", "yyyy-MM-dd HH:mm").alias("open_utc"),
        F.date_format("close_utc", "yyyy-MM-dd HH:mm").alias("close_utc"),
    )


@query(
    "session_filter",
    """SELECT event_id AS id FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS et FROM events)
WHERE isodow(et) < 6 AND CAST(et AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')
  AND CAST(et AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'""",
)
def session_filter(spark, d):
    return cal.session_filter(trades(spark, d)).select("id")


PERIOD_SQL = {
    "daily": "CAST(date AS VARCHAR)",
    "weekly": "isoyear(date) || '-' || week(date)",
    "semi_monthly": "year(date) || '-' || month(date) || '-' || CASE WHEN day(date) < 15 THEN 1 ELSE 2 END",
    "monthly": "year(date) || '-' || month(date)",
    "bi_monthly": "year(date) || '-' || ((month(date) - 1) // 2)",
}


@query(
    "period_key",
    "WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, "
    + ", ".join(f"{sql} AS {name}" for name, sql in PERIOD_SQL.items())
    + " FROM days",
)
def period_key(spark, d):
    return order_days(spark, d).select(
        "date", *[cal.period_key(F.col("date"), name).alias(name) for name in PERIOD_SQL]
    )


SEGMENTS = {
    "AUTOMOBILE": "daily",
    "BUILDING": "weekly",
    "FURNITURE": "semi_monthly",
    "HOUSEHOLD": "monthly",
    "MACHINERY": "bi_monthly",
}
TODAY = "2024-03-15"


@query(
    "due_periods",
    f"""WITH tasks AS (
  SELECT c_name AS name, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())} END AS interval,
         CASE WHEN c_acctbal >= 0 THEN DATE '2024-01-01' + c_nationkey END AS last_run, DATE '2024-02-01' + c_nationkey AS start_date,
         c_nationkey < 12 AS every_day FROM customer),
days AS (
  SELECT name, interval, last_run, every_day, CAST(unnest(generate_series(coalesce(last_run + 1, start_date), DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS date FROM tasks),
open_days AS (
  SELECT * FROM days WHERE every_day OR (isodow(date) < 6 AND date NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19'))),
keyed AS (
  SELECT name, interval, date, last_run, CASE interval {' '.join(f"WHEN '{n}' THEN {s}" for n, s in PERIOD_SQL.items())} END AS p,
         CASE interval {' '.join(f"WHEN '{n}' THEN {s.replace('date)', 'last_run)').replace('CAST(date', 'CAST(last_run')}" for n, s in PERIOD_SQL.items())} END AS done
  FROM open_days)
SELECT name, interval, min(date) AS due_date FROM keyed WHERE done IS NULL OR p <> done GROUP BY name, interval, p""",
)
def due_periods(spark, d):
    """Customers as recurring pulls; those in debt have never run."""
    c = table(spark, d, "customer")
    interval = F.lit(None).cast("string")
    for segment, name in SEGMENTS.items():
        interval = F.when(F.col("c_mktsegment") == segment, name).otherwise(interval)
    tasks = c.select(
        F.col("c_name").alias("name"),
        interval.alias("interval"),
        F.when(F.col("c_acctbal") >= 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey"))).alias("last_run_date"),
        F.date_add(F.lit("2024-02-01").cast("date"), F.col("c_nationkey")).alias("start_date"),
        (F.col("c_nationkey") < 12).alias("run_on_non_trading_days"),
    )
    return sch.due_periods(tasks, TODAY)
