"""The driver tables in the roles of market data, in Spark and in SQL.

events -> trades of a user, lineitem -> trades and quotes of a supplier or part,
orders -> daily prices and corporate actions of a customer, part -> securities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.timefns import date_from_ns, micros_to_ns
from tapeline.operators.resample import ohlcv_trades
from tapeline.plans.registry import table

HOUR = 3600 * 10**9


def trades(spark: SparkSession, d: str) -> DataFrame:
    """events as trades; ``id`` is unique and rises with time."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select(
        F.col("event_type").alias("provider"),
        F.concat(F.lit("ev:"), F.col("user_id").cast("string")).alias("symbol"),
        F.col("user_id").cast("string").alias("symbol_raw"),
        micros_to_ns(F.col("ts")).alias("local_ts"),
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        (k + 1.0).alias("size"),
    )


TRADES = """trades AS (
  SELECT event_type AS provider, 'ev:' || user_id AS symbol, CAST(user_id AS VARCHAR) AS symbol_raw,
         epoch_us(ts) * 1000 AS local_ts, event_id AS id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size
  FROM events)"""


def fills(spark: SparkSession, d: str, key: str = "l_suppkey") -> DataFrame:
    """lineitem as trades and quotes of a supplier (or part), by ship date."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("li:"), F.col(key).cast("string")).alias("symbol"),
        micros_to_ns(F.col("l_shipdate")).alias("local_ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        price.alias("price"),
        F.col("l_quantity").alias("size"),
        (price * (1 - F.col("l_discount"))).alias("bid_px"),
        (price * (1 + F.col("l_tax"))).alias("ask_px"),
        F.col("l_quantity").alias("bid_sz"),
        (F.col("l_quantity") + 1).alias("ask_sz"),
        F.col("l_returnflag").alias("provider"),
    )


def fills_sql(key: str = "l_suppkey") -> str:
    return f"""fills AS (
  SELECT 'li:' || {key} AS symbol, epoch_us(l_shipdate) * 1000 AS local_ts,
         l_orderkey * 8 + l_linenumber AS id, l_extendedprice / l_quantity AS price,
         l_quantity AS size, l_extendedprice / l_quantity * (1 - l_discount) AS bid_px,
         l_extendedprice / l_quantity * (1 + l_tax) AS ask_px, l_quantity AS bid_sz,
         l_quantity + 1 AS ask_sz, l_returnflag AS provider
  FROM lineitem)"""


FILLS = fills_sql()
FILL_TIE = ["id", "price", "size"]


def bucket_sql(ts: str, width: int) -> str:
    """Start of the bucket; counted from Monday 2000-01-03 as in the engine."""
    origin = 946_857_600_000_000_000
    return f"({ts} - ((({ts} - {origin}) % {width}) + {width}) % {width})"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events; ``local_ts`` is the bar start."""
    bars = ohlcv_trades(trades(spark, d), "1h", tie=["id"])
    return bars.withColumn("local_ts", F.col("bar"))


HOURLY = f"""{TRADES}, hourly AS (
  SELECT symbol, {bucket_sql('local_ts', HOUR)} AS bar, first(price ORDER BY local_ts, id) AS open,
         max(price) AS high, min(price) AS low, last(price ORDER BY local_ts, id) AS close,
         sum(size) AS volume, sum(price * size) / sum(size) AS vwap, count(*) AS trade_count
  FROM trades GROUP BY 1, 2)"""


def daily_prices(spark: SparkSession, d: str) -> DataFrame:
    """orders as daily bars of a customer."""
    orders = table(spark, d, "orders")
    price = F.col("o_totalprice")
    return orders.groupBy(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("symbol"),
        date_from_ns(micros_to_ns(F.col("o_orderdate"))).alias("date"),
    ).agg(
        F.min_by(price, "o_orderkey").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


# priority -> action type and value
ACTIONS = {
    "1-URGENT": ("split", 2.0),
    "2-HIGH": ("dividend_cash", 0.5),
    "3-MEDIUM": ("dividend_stock", 0.1),
    "4-NOT SPECIFIED": ("spinoff", 0.2),
    "5-LOW": ("merger", 1.0),
}


def corporate_actions(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as corporate actions of a customer."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (k, v) in ACTIONS.items():
        kind = F.when(F.col("o_orderpriority") == name, k).otherwise(kind)
        value = F.when(F.col("o_orderpriority") == name, v).otherwise(value)
    return (
        table(spark, d, "orders")
        .where("o_orderstatus = 'F'")
        .select(
            F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("symbol"),
            date_from_ns(micros_to_ns(F.col("o_orderdate"))).alias("ex_date"),
            kind.alias("type"),
            value.alias("value"),
        )
    )


_KIND = " ".join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in ACTIONS.items())
_VALUE = " ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in ACTIONS.items())
PRICES = f"""prices AS (
  SELECT 'cust:' || o_custkey AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date,
         first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),
actions AS (
  SELECT 'cust:' || o_custkey AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS ex_date,
         CASE o_orderpriority {_KIND} END AS type,
         CAST(CASE o_orderpriority {_VALUE} END AS DOUBLE) AS value
  FROM orders WHERE o_orderstatus = 'F'),
mult AS (
  SELECT symbol, ex_date,
         product(CASE type WHEN 'split' THEN value WHEN 'dividend_stock' THEN value + 1
                           WHEN 'spinoff' THEN value + 1 ELSE 1.0 END) AS mp,
         product(CASE type WHEN 'split' THEN value WHEN 'dividend_stock' THEN value + 1
                           ELSE 1.0 END) AS ms
  FROM actions GROUP BY 1, 2),
raw AS (
  SELECT p.symbol, p.date, coalesce(product(m.mp), 1.0) AS rp, coalesce(product(m.ms), 1.0) AS rs
  FROM prices p LEFT JOIN mult m ON m.symbol = p.symbol AND m.ex_date > p.date
  GROUP BY 1, 2),
factors AS (
  SELECT symbol, date, rp / last_value(rp) OVER w AS cfacpr, rs / last_value(rs) OVER w AS cfacshr
  FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
