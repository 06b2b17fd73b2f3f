"""Returns and what follows from them where prices are zero, against the SQL twins."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = ["beta", "ingest_stats", "realized_vol", "simple_returns", "log_returns"]


@pytest.fixture(scope="module")
def zero_prices(spark, tmp_path_factory):
    """Trades of users whose prices start, end or stay at zero, and some lines."""
    root = tmp_path_factory.mktemp("zero")
    runs = {1: [0, 5, 7, 4], 2: [3, 0, 0, 2], 3: [0, 0], 4: [6, 5, 6, 0], 5: [8], 6: [2, 3, 5, 4], 7: [0, 9]}
    events = [
        (10 * user + i, user, dt.datetime(2024, 1, 2, 3 + i, user), "view", float(price), '{"k": 1}')
        for user, prices in runs.items()
        for i, price in enumerate(prices)
    ]
    spark.createDataFrame(
        events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"
    ).write.parquet(f"{root}/events.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.where("l_suppkey < 3").write.parquet(f"{root}/lineitem.parquet")
    return str(root)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices_give_what_the_sql_gives(spark, zero_prices, name):
    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{zero_prices}/{table}.parquet/*.parquet'")
    sql = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, zero_prices).select(*sql.columns).collect()
    # repr tells null, NaN and the infinities apart
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, sql.fetchall()))
