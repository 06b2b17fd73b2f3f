"""Ordered operators against plain Python, with one hot key, whole and cut up."""

import math
import random

import pytest
from conftest import all_near
from pyspark.sql import functions as F

from tapeline.operators import indicators as ind
from tapeline.operators import resample as rs
from tapeline.operators import returns as ret
from tapeline.operators import sequence as sq
from tapeline.operators.ordered import SEGMENT, STEPS, is_time, lag_columns, lay_out, rows_since, running


def prices(seed=1, n=60, holes=0.0):
    rng = random.Random(seed)
    rows = []
    for symbol, count in (("hot", n), ("b", 9), ("c", 1)):
        p = 100.0
        for i in range(count):
            p = max(1.0, p + rng.uniform(-3, 3))
            rows.append((symbol, i * 10, None if rng.random() < holes else round(p, 2)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, local_ts long, price double")


def per_symbol(rows):
    out = {}
    for symbol, ts, price in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(symbol, []).append(price)
    return out


def column(df, name):
    out = {}
    for r in df.orderBy("symbol", "local_ts").collect():
        out.setdefault(r.symbol, []).append(r[name])
    return out


def check(df, name, rows, rule):
    got = column(df, name)
    for symbol, xs in per_symbol(rows).items():
        all_near(got[symbol], rule(xs), 1e-9)


def ema_rule(xs, period):
    a = 2 / (period + 1)
    out, y, gap = [], None, 0
    for x in xs:
        gap += 1
        if x is None:
            out.append(None)
            continue
        if y is None:
            y = x
        else:
            w = (1 - a) ** gap
            y = (w * y + a * x) / (w + a)
        gap = 0
        out.append(y)
    return out


def rsi_rule(xs, n):
    out, g, l = [], 0.0, 0.0
    for i in range(len(xs)):
        if i:
            known = xs[i] is not None and xs[i - 1] is not None
            c = xs[i] - xs[i - 1] if known else 0.0
            up, down = max(c, 0.0), max(-c, 0.0)
            if i <= n:
                g, l = g + up / n, l + down / n
            else:
                g, l = (g * (n - 1) + up) / n, (l * (n - 1) + down) / n
        if i < n:
            out.append(None)
        elif g == 0 and l == 0:
            out.append(50.0)
        elif l == 0:
            out.append(100.0)
        else:
            out.append(100 - 100 / (1 + g / l))
    return out


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_ema(spark, segments, holes):
    rows = prices(2, holes=holes)
    check(ind.ema(frame(spark, rows), 5), "ema", rows, lambda xs: ema_rule(xs, 5))


def test_ema_literal(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)])
    all_near(column(ind.ema(df, 2), "ema")["a"], [1.0, 5 / 3, 23 / 9])


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_rsi(spark, segments, holes):
    rows = prices(3, holes=holes)
    check(ind.rsi(frame(spark, rows), 4), "rsi", rows, lambda xs: rsi_rule(xs, 4))


def test_rsi_limits(spark):
    rows = [("up", i, float(i)) for i in range(1, 6)]
    rows += [("down", i, 10.0 - i) for i in range(1, 6)] + [("flat", i, 3.0) for i in range(1, 6)]
    got = column(ind.rsi(frame(spark, rows), 3), "rsi")
    assert got == {
        "up": [None] * 3 + [100.0, 100.0],
        "down": [None] * 3 + [0.0, 0.0],
        "flat": [None] * 3 + [50.0, 50.0],
    }


def test_macd(spark, segments):
    rows = prices(4, holes=0.1)
    out = ind.macd(frame(spark, rows), 3, 6, 4)

    def line(xs):
        return [None if a is None else a - b for a, b in zip(ema_rule(xs, 3), ema_rule(xs, 6))]

    check(out, "macd", rows, line)
    check(out, "macd_signal", rows, lambda xs: ema_rule(line(xs), 4))


@pytest.mark.parametrize("period", [3, 20])
def test_sma_and_bands(spark, segments, period):
    rows = prices(5)

    def rule(xs):
        return [
            None if i + 1 < period else sum(xs[i + 1 - period : i + 1]) / period for i in range(len(xs))
        ]

    def upper(xs):
        out = []
        for i, m in enumerate(rule(xs)):
            if m is None:
                out.append(None)
            else:
                w = xs[i + 1 - period : i + 1]
                out.append(m + 2 * math.sqrt(sum((x - m) ** 2 for x in w) / period))
        return out

    check(ind.sma(frame(spark, rows), period), "sma", rows, rule)
    check(ind.bollinger(frame(spark, rows), period), "bb_upper", rows, upper)


def test_sma_literal(spark):
    df = frame(spark, [("a", i, 10.0 * i) for i in range(1, 6)])
    assert column(ind.sma(df, 3), "sma")["a"] == [None, None, 20.0, 30.0, 40.0]


def test_returns(spark, segments):
    rows = prices(6, holes=0.1)

    def rule(xs):
        out = [math.nan]
        for a, b in zip(xs, xs[1:]):
            out.append(math.nan if a is None or b is None or a == 0 else (b - a) / a)
        return out

    check(ret.simple_returns(frame(spark, rows)), "simple_return", rows, rule)


def test_returns_literal(spark):
    xs = [10.0, None, 11.0, 0.0, 12.0]
    df = frame(spark, [("a", i, x) for i, x in enumerate(xs)])
    nan = math.nan
    all_near(column(ret.simple_returns(df), "simple_return")["a"], [nan, nan, nan, -1.0, nan])
    all_near(column(ret.log_returns(df), "log_return")["a"], [nan] * 5)


def test_lag_reaches_over_short_segments(spark, segments):
    """A lag longer than a segment is still exact."""
    rows = prices(7, n=80)
    out = lag_columns(lay_out(frame(spark, rows), ["symbol"], ["local_ts"]), {"far": (F.col("price"), 25)})
    check(out.done(), "far", rows, lambda xs: [None] * min(25, len(xs)) + xs[:-25])


def test_running(spark, segments):
    rows = prices(8, holes=0.3)
    layout = lay_out(frame(spark, rows), ["symbol"], ["local_ts"])
    price = F.col("price")
    out = running(
        layout,
        {"top": ("max", price), "n": ("count", price), "total": ("sum", price), "seen": ("last", price)},
        inclusive=False,
    ).done()

    def rule(fn, empty=None):
        def apply(xs):
            res = []
            for i in range(len(xs)):
                known = [x for x in xs[:i] if x is not None]
                res.append(fn(known) if known else empty)
            return res

        return apply

    check(out, "top", rows, rule(max))
    check(out, "n", rows, rule(len, 0))
    check(out, "total", rows, rule(sum))
    check(out, "seen", rows, rule(lambda k: k[-1]))


def test_rows_since(spark):
    rows = prices(9, holes=0.6)
    for width in (10, 70, 10_000, None):
        layout = lay_out(frame(spark, rows), ["symbol"], ["local_ts"], width)
        out = rows_since(layout, F.col("price").isNotNull(), "place", "gap").done()
        assert out.columns == ["symbol", "local_ts", "price", "place", "gap"]
        places, gaps = column(out, "place"), column(out, "gap")
        for symbol, xs in per_symbol(rows).items():
            assert places[symbol] == list(range(1, len(xs) + 1))
            want = [next((i - j for j in range(i - 1, -1, -1) if xs[j] is not None), None) for i in range(len(xs))]
            assert gaps[symbol] == want


def test_seq_gap(spark, segments):
    rng = random.Random(9)
    rows, n = [], 0
    for i in range(70):
        n += rng.choice([1, 1, 1, 2, 4, 0, -3])
        rows.append(("s", i, n))
    df = spark.createDataFrame(rows, "symbol string, local_ts long, seq long")
    got = {r.local_ts: r for r in sq.seq_gap(df).collect()}
    last = None
    for _, ts, seq in rows:
        r = got[ts]
        if last is None:
            assert not r.is_gap and r.expected is None
            last = seq
        else:
            assert r.expected == last + 1
            if seq == last + 1:
                assert not r.is_gap and r.kind is None
                last = seq
            elif seq > last + 1:
                assert (r.kind, r.skipped) == ("forward", seq - last - 1)
                last = seq
            else:
                assert (r.kind, r.skipped) == ("backward", seq - last - 1)


def test_segments_are_bounded(spark):
    """One key with all rows is really cut, and its rows stay whole."""
    df = spark.range(1000).select(F.lit("k").alias("symbol"), F.col("id").alias("local_ts"))
    layout = lay_out(df, ["symbol"], ["local_ts"], 50)
    sizes = [r["count"] for r in layout.df.groupBy(*layout.part).count().collect()]
    assert layout.split and sizes == [50] * 20


def test_building_a_plan_starts_no_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "no job may start here")
    df = frame(spark, prices(3))
    ret.simple_returns(df)
    ind.ema(df, 5)
    ind.macd(df)
    ind.rsi(df, 5)
    sq.seq_gap(df.withColumn("seq", F.col("local_ts")))
    assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    sc.setJobGroup("", "")


def test_integers_that_are_no_times_are_cut(spark):
    """A key of sequence numbers lies in many segments, and its results stay."""
    df = spark.range(300_000).select(
        F.lit("hot").alias("symbol"), F.col("id").alias("seq"), (F.col("id") * 7 % 101).cast("double").alias("price")
    )
    cut = lay_out(df, ["symbol"], ["seq"]).df.groupBy(SEGMENT).count()
    assert cut.count() == 5 and cut.agg(F.max("count")).first()[0] == STEPS
    whole = ind.sma(df, 20, order=["seq"], segment=None)
    apart = ind.sma(df, 20, order=["seq"])
    assert whole.exceptAll(apart).isEmpty() and apart.count() == 300_000
    assert is_time("local_ts") and is_time("bar") and not is_time("bits") and not is_time("seq")


def test_descending_order(spark, segments):
    """Running values and lags from the newest row back."""
    rows = prices(11, holes=0.3)
    layout = lay_out(frame(spark, rows), ["symbol"], ["-local_ts"])
    price = F.col("price")
    layout = running(layout, {"seen": ("last", price), "n": ("count", price)}, inclusive=False)
    got = lag_columns(layout, {"next": (price, 1)}).done()

    def seen(xs):
        return [next((x for x in xs[i + 1 :] if x is not None), None) for i in range(len(xs))]

    check(got, "seen", rows, seen)
    check(got, "n", rows, lambda xs: [sum(x is not None for x in xs[i + 1 :]) for i in range(len(xs))])
    check(got, "next", rows, lambda xs: [*xs[1:], None])


def test_order_violations_look_at_all_earlier_rows(spark, segments):
    df = spark.createDataFrame(
        [("a", i, t) for i, t in enumerate([10, 5, 7, 11, 11])], "symbol string, arrival long, local_ts long"
    )
    bad = rs.order_violations(df, arrival=["arrival"]).collect()
    assert sorted((r.arrival, r.prev_ts) for r in bad) == [(1, 10), (2, 10)]
