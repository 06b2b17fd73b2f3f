"""Hand-computed cases."""

import random
import datetime as dt
import json
import math

import pytest
from conftest import all_near
from pyspark.sql import functions as F

from tapeline.functions import calendar as cal
from tapeline.functions import options as op
from tapeline.functions import ratios as rt
from tapeline.functions import timefns as tf
from tapeline.functions.hexwords import exact, signed, unsigned
from tapeline.operators import corpactions as ca
from tapeline.operators import coverage as cov
from tapeline.operators import facts as fc
from tapeline.operators import onchain as oc
from tapeline.operators import replay as rp
from tapeline.operators import resample as rs
from tapeline.operators import returns as ret
from tapeline.operators import schedule as sch
from tapeline.operators import security as sec
from tapeline.operators.symbols import symbol_resolve
from tapeline.sources import onchain as chain
from tapeline.sources import vendors as vn

S = 10**9
TRADE = "symbol string, local_ts long, price double, size double"


def test_intervals():
    assert tf.parse_interval(" 5M ") == 300 * S
    assert tf.parse_interval("1w") == 7 * 86400 * S
    for bad in ("", "5", "m5", "0s", "1y", "-1m"):
        with pytest.raises(ValueError):
            tf.parse_interval(bad)


def test_weeks_start_on_monday(spark):
    ts = 1704844800 * S  # Wednesday 2024-01-10
    row = spark.range(1).select(tf.date_from_ns(tf.bucket_ns(F.lit(ts), tf.parse_interval("1w"))).alias("d")).first()
    assert row.d == "2024-01-08"
    neg = spark.range(1).select(tf.bucket_ns(F.lit(-1), 10, 0).alias("b")).first()
    assert neg.b == -10


def test_trades_to_bars(spark):
    df = spark.createDataFrame(
        [("a", S // 10, 150.0, 10.0), ("a", S // 2, 152.0, 20.0), ("a", 12 * S // 10, 151.0, 15.0)], TRADE
    )
    rows = [tuple(r) for r in rs.ohlcv_trades(df, "1s").orderBy("bar").collect()]
    assert rows == [
        ("a", 0, "1s", 150.0, 152.0, 150.0, 152.0, 30.0, 4540 / 30, 2),
        ("a", S, "1s", 151.0, 151.0, 151.0, 151.0, 15.0, 151.0, 1),
    ]
    still = spark.createDataFrame([("a", 0, 5.0, 0.0)], TRADE)
    assert rs.ohlcv_trades(still, "1s").first().vwap is None
    assert rs.ohlcv_trades_df(df.limit(0), "1s").count() == 0


def test_millisecond_series(spark):
    base = 1782060000000
    df = spark.createDataFrame([("a", base + x, 1.0, 1.0) for x in (0, 100000, 250000, 350000)], TRADE)
    bars = rs.ohlcv_any_unit(df, "5m").orderBy("bar").collect()
    assert [(r.bar, r.trade_count) for r in bars] == [(base, 3), (base + 300000, 1)]


def test_fill(spark):
    df = spark.createDataFrame([("a", 0, 5.0, 1.0), ("a", 3 * S, 6.0, 1.0)], TRADE)
    rows = rs.ohlcv_trades_fill(df, "1s").orderBy("bar").collect()
    assert [(r.close, r.volume, r.trade_count) for r in rows] == [
        (5.0, 1.0, 1), (None, 0.0, 0), (None, 0.0, 0), (6.0, 1.0, 1)
    ]
    rows = rs.ohlcv_trades_fill(df, "1s", start_ns=-S, end_ns=4 * S, ffill=True).orderBy("bar").collect()
    assert [r.close for r in rows] == [None, 5.0, 5.0, 5.0, 6.0, 6.0]


def test_quotes_to_bars(spark):
    q = spark.createDataFrame([("a", S // 10, 149.0, 151.0), ("a", S // 2, 150.0, 152.0)], "symbol string, local_ts long, bid_px double, ask_px double")
    r = rs.bars_from_quotes(q, "1s").first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.vwap, r.trade_count) == (150.0, 151.0, 150.0, 151.0, 0.0, 150.5, 2)
    with pytest.raises(ValueError):
        rs.bars_from_quotes(q, "1s", "last")


def test_rollup(spark):
    schema = "symbol string, local_ts long, open double, high double, low double, close double, volume double, vwap double, trade_count long"
    df = spark.createDataFrame(
        [
            ("a", 0, 100.0, 105.0, 99.0, 102.0, 1000.0, 102.0, 10),
            ("a", S, 102.0, 103.0, 101.0, 102.5, 2000.0, 102.2, 20),
            ("a", 60 * S, 103.0, 104.0, 102.0, 103.5, 1500.0, None, None),
        ],
        schema,
    )
    first, second = rs.bars_rollup(df, "1m").orderBy("bar").collect()
    assert (first.open, first.high, first.low, first.close, first.volume, first.trade_count) == (100.0, 105.0, 99.0, 102.5, 3000.0, 30)
    assert first.vwap == pytest.approx((102 * 1000 + 102.2 * 2000) / 3000)
    assert (second.vwap, second.trade_count) == (103.5, 1)


def test_rollup_of_bars_equals_bars_of_trades(spark):
    df = spark.createDataFrame([("a", i * 7 * S, float(i % 13), float(i % 5 + 1)) for i in range(2000)], TRADE)
    minute = rs.ohlcv_trades(df, "1m").withColumn("local_ts", F.col("bar"))
    a = rs.bars_rollup(minute, "1h").orderBy("bar").collect()
    b = rs.ohlcv_trades(df, "1h").orderBy("bar").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x.bar, x.open, x.high, x.low, x.close, x.trade_count) == (y.bar, y.open, y.high, y.low, y.close, y.trade_count)
        assert x.vwap == pytest.approx(y.vwap)


def prices(spark):
    return spark.createDataFrame(
        [
            ("a", f"2026-06-0{i}", c, c, c, c, v)
            for i, (c, v) in enumerate(zip((200.0, 210.0, 220.0, 104.0, 106.0), (100.0, 100.0, 100.0, 200.0, 200.0)), 1)
        ],
        "symbol string, date string, open double, high double, low double, close double, volume double",
    )


ACTION = "symbol string, ex_date string, type string, value double"


def test_split_and_dividend(spark, segments):
    acts = spark.createDataFrame(
        [("a", "2026-06-04", "split", 2.0), ("a", "2026-06-03", "dividend_cash", 0.5), ("a", "soon", "split", 9.0)], ACTION
    )
    rows = ca.adjust_dataframe(prices(spark), acts, base_date="2026-06-05").orderBy("date").collect()
    all_near([r.adj_close for r in rows], [100.0, 105.0, 110.0, 104.0, 106.0])
    assert [r.adj_volume for r in rows] == [200.0] * 5
    all_near([r.total_return for r in rows], [None, 0.05, (110 + 0.25) / 105 - 1, 104 / 110 - 1, 106 / 104 - 1])


def test_action_on_a_closed_day(spark):
    acts = spark.createDataFrame([("a", "2026-05-31", "split", 3.0), ("a", "2026-06-04", "spinoff", 0.5)], ACTION)
    rows = ca.cumulative_factors(prices(spark).where("date <> '2026-06-04'"), acts).orderBy("date").collect()
    assert [(r.cfacpr, r.cfacshr) for r in rows] == [(1.5, 1.0)] * 3 + [(1.0, 1.0)]
    early = ca.cumulative_factors(prices(spark), acts, base_date="2026-06-01").orderBy("date").collect()
    all_near([r.cfacpr for r in early], [1.0, 1.0, 1.0, 1 / 1.5, 1 / 1.5])


def test_risk(spark):
    a = (0.01, 0.02, -0.01, 0.03, 0.0)
    m = (0.005, 0.01, -0.005, 0.015, 0.0)
    asset = spark.createDataFrame([("x", i, v) for i, v in enumerate(a)], "symbol string, t int, ret double")
    market = spark.createDataFrame(list(enumerate(m)), "t int, market_ret double")
    assert ret.beta(asset, market, on=["t"]).first().beta == pytest.approx(2.0)
    flat = market.withColumn("market_ret", F.lit(0.1))
    assert math.isnan(ret.beta(asset, flat, on=["t"]).first().beta)
    one = asset.where("t = 0")
    assert math.isnan(ret.realized_vol(one).first().realized_vol)
    assert ret.realized_vol(one, method="sum_of_squares").first().realized_vol == pytest.approx(0.01 * math.sqrt(252))
    both = ret.realized_vol(one, method={"std": "standard", "sq": "sum_of_squares"}).first()
    assert both.n == 1 and math.isnan(both.std) and both.sq == pytest.approx(0.01 * math.sqrt(252))
    with pytest.raises(ValueError):
        ret.realized_vol(one, method={"x": "other"})
    for kw in ({"annualization": -1.0}, {"method": "other"}):
        with pytest.raises(ValueError):
            ret.realized_vol(asset, **kw)


def bsm(s, k, t, r, v, q, call):
    n = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    if call:
        return s * math.exp(-q * t) * n(d1) - k * math.exp(-r * t) * n(d2)
    return k * math.exp(-r * t) * n(-d2) - s * math.exp(-q * t) * n(-d1)


def test_options(spark):
    cases = [(100.0, k, t, 0.05, v, 0.02, c) for k in (80.0, 100.0, 130.0) for t in (0.1, 1.0) for v in (0.2, 0.6) for c in ("call", "P")]
    df = spark.createDataFrame(cases, "spot double, strike double, years double, rate double, sigma double, dividend double, type string")
    args = [F.col(c) for c in ("model_price", "spot", "strike", "years", "rate", "dividend", "type")]
    rows = op.enrich_chain(df).withColumn("iv", op.option_iv(*args)).collect()
    assert len(rows) == len(cases)
    for r in rows:
        call = r.type == "call"
        want = bsm(r.spot, r.strike, r.years, r.rate, r.sigma, r.dividend, call)
        assert r.model_price == pytest.approx(want, abs=1e-10)
        h = 1e-4
        up = bsm(r.spot + h, r.strike, r.years, r.rate, r.sigma, r.dividend, call)
        down = bsm(r.spot - h, r.strike, r.years, r.rate, r.sigma, r.dividend, call)
        assert r.delta == pytest.approx((up - down) / (2 * h), abs=1e-6)
        up = bsm(r.spot, r.strike, r.years, r.rate, r.sigma + h, r.dividend, call)
        down = bsm(r.spot, r.strike, r.years, r.rate, r.sigma - h, r.dividend, call)
        assert r.vega == pytest.approx((up - down) / (2 * h), abs=1e-4)
        up = bsm(r.spot, r.strike, r.years + h, r.rate, r.sigma, r.dividend, call)
        down = bsm(r.spot, r.strike, r.years - h, r.rate, r.sigma, r.dividend, call)
        assert r.theta == pytest.approx(-(up - down) / (2 * h), abs=1e-3)
        if r.vega > 1e-2:
            assert r.iv == pytest.approx(r.sigma, abs=1e-3)


def test_option_edges(spark):
    names = ["spot", "strike", "years", "rate", "sigma", "dividend", "type"]
    cases = [
        (100.0, 90.0, 0.0, 0.0, 0.2, 0.0, "call", 10.0),
        (0.0, 90.0, 1.0, 0.0, 0.2, 0.0, "put", 0.0),
        (100.0, 0.0, 1.0, 0.0, 0.2, 0.1, "C", 100 * math.exp(-0.1)),
        (100.0, 0.0, 1.0, 0.0, 0.2, 0.1, "p", 0.0),
        (100.0, 110.0, 1.0, 0.0, 0.0, 0.0, "put", 10.0),
        (-1.0, 110.0, 1.0, 0.0, 0.2, 0.0, "put", None),
        (100.0, 110.0, 1.0, 0.0, 0.2, 0.0, "straddle", None),
    ]
    df = spark.createDataFrame(cases, ", ".join(f"{n} {'string' if n == 'type' else 'double'}" for n in names) + ", want double")
    for r in op.enrich_chain(df).collect():
        all_near([r.model_price], [r.want])
    single = df.select(op.option_price(*[F.col(n) for n in names]).alias("p"), "want")
    for r in single.collect():
        all_near([r.p], [r.want])
    out = spark.createDataFrame([(500.0,)], "p double").select(
        op.option_iv(F.col("p"), *[F.lit(x) for x in (100.0, 90.0, 1.0, 0.0, 0.0)], F.lit("call")).alias("iv")
    )
    assert math.isnan(out.first().iv)


def test_ratios(spark):
    df = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0), (None, 2.0), (10.0, math.nan)], "a double, b double")
    got = [r.x for r in df.select(rt.pe_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    all_near(got, [5.0, math.nan, math.nan, math.nan])


def test_coverage(spark):
    df = spark.createDataFrame(
        [("AAPL", 1, "stooq", 150.0, 1.0), ("AAPL", 1, "yahoo", 151.0, None), ("AAPL", 1, "tiingo", 152.0, 3.0), ("MSFT", 2, "tiingo", 300.0, None), ("MSFT", 2, "other", 9.0, 9.0)],
        "symbol string, local_ts long, provider string, close double, volume double",
    )
    order = ["yahoo", "tiingo", "stooq"]
    best = [tuple(r) for r in cov.coverage_priority(df, order).orderBy("symbol").collect()]
    assert best == [("AAPL", 1, "yahoo", 151.0, None), ("MSFT", 2, "tiingo", 300.0, None)]
    full = cov.coverage_fill_nulls(df, order)
    assert [tuple(r) for r in full.orderBy("symbol").collect()] == [("AAPL", 1, "yahoo", 151.0, 3.0), ("MSFT", 2, "tiingo", 300.0, 9.0)]
    again = cov.coverage_fill_nulls(full, order)
    assert sorted(again.collect()) == sorted(full.collect())
    with pytest.raises(ValueError):
        cov.resolve_coverage(df, order, "other")
    with pytest.raises(ValueError):
        cov.coverage_priority(df.drop("provider"), order)


def test_replay_order(spark):
    rows = [("provB", "AAPL"), ("provA", "MSFT"), ("provA", "AAPL")]
    df = spark.createDataFrame([(p, s, 2000, 1000) for p, s in rows], "provider string, symbol string, local_ts long, source_ts long")
    late = df.limit(1).withColumns({"source_ts": F.lit(None).cast("long"), "symbol": F.lit("Z")})
    got = [(r.provider, r.symbol) for r in rp.replay_merge({"trade": df, "quote": late}, start_ns=2000, end_ns=2000).collect()]
    assert got == [("provB", "Z"), ("provA", "AAPL"), ("provA", "MSFT"), ("provB", "AAPL")]


def test_company_facts(spark):
    def value(val, filed):
        return {"val": val, "end": "2020-09-30", "fy": 2020, "fp": "FY", "form": "10-K", "filed": filed, "accn": "1"}

    good = {"cik": 320193, "facts": {"us-gaap": {"Revenues": {"label": "x", "units": {"USD": [value(1.0e6, "2020-10-30"), value(1.2e6, "2021-10-30")]}}}}}
    df = spark.createDataFrame([(320193, json.dumps(good)), (7, "{broken")], "cik long, payload string")
    names = spark.createDataFrame([(320193, "AAPL")], "cik long, symbol string")
    facts = vn.src_company_facts(df, names)
    assert facts.count() == 2
    latest = fc.facts_latest(facts, ord="ord").collect()
    assert [(r.symbol, r.val) for r in latest] == [("AAPL", 1.2e6)]
    assert vn.src_company_facts(df).first().symbol == "CIK0000320193"


def test_calendar_2026(spark):
    c = cal.calendar_table(spark, "2026-01-01", "2026-12-31", custom=["2026-03-03"])
    days = [r.date.isoformat()[5:] for r in c.where("is_holiday").orderBy("date").collect()]
    assert days == ["01-01", "01-19", "02-16", "03-03", "04-03", "05-25", "06-19", "07-03", "09-07", "11-26", "12-25"]
    early = [r.date.isoformat()[5:] for r in c.where("is_early_close").orderBy("date").collect()]
    assert early == ["11-27", "12-24"]
    eve = cal.calendar_table(spark, "2021-12-31", "2021-12-31").first()
    assert eve.is_holiday

    def ns(*a):
        return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * S

    stamps = {ns(2026, 1, 7, 15, 0): True, ns(2026, 1, 7, 14, 0): False, ns(2026, 1, 7, 21, 0): True, ns(2026, 1, 7, 21, 30): False,
              ns(2026, 7, 1, 13, 30): True, ns(2026, 11, 27, 18, 0): True, ns(2026, 11, 27, 18, 1): False, ns(2026, 1, 10, 16, 0): False,
              ns(1985, 1, 8, 16, 0): True, ns(2101, 1, 5, 16, 0): True}
    df = spark.createDataFrame([(t,) for t in stamps], "local_ts long")
    kept = {r.local_ts for r in cal.session_filter(df).collect()}
    assert kept == {t for t, ok in stamps.items() if ok}


def test_due_periods(spark):
    d = dt.date
    tasks = spark.createDataFrame(
        [("m", "monthly", d(2026, 1, 20), None, False), ("new", "weekly", None, d(2026, 3, 12), True), ("done", "daily", d(2026, 3, 16), None, False)],
        "name string, interval string, last_run_date date, start_date date, run_on_non_trading_days boolean",
    )
    due = sch.due_periods(tasks, "2026-03-16")
    got = {}
    for r in due.orderBy("due_date").collect():
        got.setdefault(r.name, []).append(r.due_date)
    assert got == {"m": [d(2026, 2, 2), d(2026, 3, 2)], "new": [d(2026, 3, 12), d(2026, 3, 16)]}
    assert {r.name: r.due_date for r in sch.next_due(due).collect()} == {"m": d(2026, 2, 2), "new": d(2026, 3, 12)}


def test_due_periods_of_one_file_are_dealt_out_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(sch, "PARTITION_ROWS", 10, raising=False)
    tasks = spark.range(200, numPartitions=1).selectExpr(
        "concat('t', id % 150) AS name", "CASE WHEN id % 2 = 0 THEN 'weekly' ELSE 'semi_monthly' END AS interval",
        "date '2026-03-01' AS last_run_date",
        "CAST(null AS date) AS start_date", "true AS run_on_non_trading_days",
    )
    due = sch.due_periods(tasks, "2026-03-16")
    assert due.rdd.getNumPartitions() >= 20
    days = {0: [2, 9, 16], 1: [15]}
    want = [(f"t{i}", dt.date(2026, 3, day)) for i in range(150) for day in days[i % 2]]
    assert sorted((r.name, r.due_date) for r in due.collect()) == sorted(want)


def test_security_master(spark):
    row = ("X:1", "abc", "NYSE", "Abc", "CS", "0000000001", "F1", "C1", "I1", True, "2020", "2020")
    master = spark.createDataFrame([row], ", ".join(f"{c} {'boolean' if c == 'is_active' else 'string'}" for c in sec.MASTER_COLUMNS))
    change = master.withColumns({"symbol": F.lit("x:1"), "name": F.lit("New"), "created_at": F.lit("2024"), "updated_at": F.lit("2024")})
    merged = sec.security_upsert(master, change).collect()
    assert [(r.symbol, r.name, r.created_at, r.updated_at) for r in merged] == [("X:1", "New", "2020", "2024")]
    maps = spark.createDataFrame([("ABC", "X:1", None), ("abc", "X:2", "NYSE"), ("abc", "X:3", "LSE")], "ticker string, symbol string, exchange string")
    asked = spark.createDataFrame([("abc", "NYSE"), ("abc", "TSE"), ("abc", None), ("zzz", None)], "ticker string, exchange string")
    got = {(r.ticker, r.exchange): r.symbol for r in sec.resolve_ticker(asked, maps).collect()}
    assert got == {("abc", "NYSE"): "X:2", ("abc", "TSE"): "X:1", ("abc", None): "X:1", ("zzz", None): None}
    gone = spark.createDataFrame([("nope",)], "symbol string")
    assert sec.unknown_symbols(gone, master).count() == 1


def test_symbol_resolve(spark):
    known = spark.createDataFrame([("alpaca:AAPL",), ("yahoo:MSFT",), ("tsla",)], "symbol string")
    got = {r.input: r.symbol for r in symbol_resolve(spark, ["aapl", "TSLA", "ms", "foo", "Yahoo: ibm", "  "], known).collect()}
    assert got == {"aapl": "alpaca:AAPL", "TSLA": "tsla", "ms": "yahoo:MSFT", "foo": "alpaca:FOO", "Yahoo: ibm": "Yahoo:IBM"}


def test_words(spark):
    values = [0, 1, -1, 12345678901234567890, -(10**30), 2**255 - 1, -(2**255)]
    df = spark.createDataFrame([(f"{v % 2**256:064x}",) for v in values], "w string")
    rows = df.select(signed(F.col("w")).alias("s"), unsigned(F.col("w")).alias("u"), exact(F.col("w")).alias("e")).collect()
    for v, r in zip(values, rows):
        assert r.s == pytest.approx(float(v), rel=1e-15)
        assert r.u == pytest.approx(float(v % 2**256), rel=1e-15)
        assert (int(r.e) if r.e is not None else None) == (v if 0 <= v < 2**126 else None)


def test_pool_rows_without_a_price(spark):
    rows = [(1, 0.0), (2, -1.0), (3, math.nan), (4, math.inf), (5, 2.0)]
    df = spark.createDataFrame(rows, "id int, price double").withColumns(
        {"reserve0": F.lit(10.0), "reserve1": F.lit(20.0), "is_flipped": F.lit(False)}
    )
    out = chain.src_pool_ladder_cp(df).collect()
    assert [r.id for r in out] == [5]
    assert all(v.size >= 0.0001 for v in out[0].bids)


def test_traces(spark):
    rows = [
        ("t", 0, "call", "0xf", "0xA", "0x5CFFE9DE00", []),
        ("t", 1, "call", "0xf", "0xB", None, [0]),
        ("t", 2, "call", "0xf", "0xa", "0x128acb08", [0, 1]),
        ("u", 0, "call", "0xf", "0xA", "0x", []),
        ("u", 1, "staticcall", "0xf", "0xA", "0x", [0]),
        ("v", 0, "call", "0xf", "0xA", "0x", [0]),
        ("v", 1, "call", "0xf", "0xA", "0x", [1, 0]),
    ]
    df = spark.createDataFrame(rows, "tx_hash string, ord int, call_type string, from_addr string, to_addr string, input string, path array<int>")
    got = {r.tx_hash: (r.flashloans, r.reentrancy_detected, r.internal_swaps) for r in oc.trace_summary(df).collect()}
    assert got == {"t": (True, True, 1), "u": (False, False, 0), "v": (False, False, 0)}


def test_reentrant_calls_of_random_traces(spark):
    """Calls in the order of their trace, out of it, and of repeated paths."""
    rng = random.Random(11)
    rows = []
    for tx in range(40):
        paths = [[]]
        for _ in range(30):
            base = rng.choice(paths)
            paths.append([*base, rng.choice([0, 1, 9, 10, 300])])
        paths.sort()
        if tx % 2:
            rng.shuffle(paths)
        for n, path in enumerate(paths):
            kind = "staticcall" if rng.random() < 0.1 else rng.choice(["call", None])
            rows.append((f"t{tx}", n, kind, rng.choice(["0xA", "0xa", "0xB", "", None]), path))
    want = {
        (x[0], x[1])
        for x in rows
        for y in rows
        if x[0] == y[0] and y[1] < x[1] and x[3] and y[3] and x[3].lower() == y[3].lower()
        and "staticcall" not in (x[2], y[2])
        and len(y[4]) < len(x[4]) and x[4][: len(y[4])] == y[4]
    }
    df = spark.createDataFrame(rows, "tx_hash string, ord int, call_type string, to_addr string, path array<int>")
    got = [(r.tx_hash, r.ord) for r in oc.trace_ancestor_join(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(int(t[1:]) % 2 for t, _ in want)
    wide = df.withColumns({"from_addr": F.lit("0xf"), "input": F.lit(None).cast("string")})
    summary = {r.tx_hash: r.reentrancy_detected for r in oc.trace_summary(wide).collect()}
    assert summary == {f"t{tx}": any(t == f"t{tx}" for t, _ in want) for tx in range(40)}
    assert oc.trace_summary(wide.limit(0)).count() == 0
