"""Books, depth, slippage and gaps against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import book as bk
from tapeline.operators import depth as dp
from tapeline.operators import sequence as sq

LV = "array<struct<price:double,size:double>>"
BOOK = f"symbol string, local_ts long, seq long, is_snapshot boolean, bids {LV}, asks {LV}"


def replay(records, interval):
    """Reference-free walk: one symbol's records in order to boundary books."""
    book, at, started, out = {}, None, False, {}
    for ts, _, snap, bids, asks in records:
        if not started and not snap:
            continue
        if started:
            while ts > at:
                out[at] = dict(book)
                at += interval
        if snap:
            book = {}
        for side, levels in (("bid", bids), ("ask", asks)):
            for price, size in levels:
                if size:
                    book[(side, price)] = size
                else:
                    book.pop((side, price), None)
        if not started:
            started, at = True, ts - ts % interval + interval
            continue
        while ts >= at:
            out[at] = dict(book)
            at += interval
    return out, book


def random_records(seed, n=60):
    rng = random.Random(seed)
    ts, out = 0, []
    for i in range(n):
        ts += rng.choice([0, 0, 1, 2, 5, 10, 13])
        snap = rng.random() < 0.12

        def side(lo):
            prices = rng.sample(range(lo, lo + 6), rng.randint(0, 3))
            return [(float(p), float(rng.choice([0, 1, 2, 5]))) for p in prices]

        out.append((ts, i, snap, side(90), side(100)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resample_and_rebuild(spark, segments, seed):
    data = {s: random_records(seed * 10 + i) for i, s in enumerate("xyz")}
    rows = [(s, *r) for s, records in data.items() for r in records]
    df = spark.createDataFrame(rows, BOOK)
    got, final = {}, {}
    for r in bk.book_resample(df, 10, as_levels=True).collect():
        got.setdefault((r.symbol, r.local_ts), {})[(r.side, r.price)] = r["size"]
    for r in bk.book_rebuild(df).collect():
        final.setdefault(r.symbol, {})[(r.side, r.price)] = r["size"]
    whole = {(r.symbol, r.local_ts): r for r in bk.book_resample(df, 10).collect()}
    for symbol, records in data.items():
        want, end = replay(records, 10)
        assert {at for s, at in whole if s == symbol} == set(want)
        for at, book in want.items():
            assert got.get((symbol, at), {}) == book, (symbol, at)
            row = whole[(symbol, at)]
            assert row.depth == len(book)
            assert [v.price for v in row.bids] == sorted((p for s, p in book if s == "bid"), reverse=True)
            assert [v.price for v in row.asks] == sorted(p for s, p in book if s == "ask")
        assert final.get(symbol, {}) == end


def test_resample_literal(spark):
    s = 10**8
    rows = [
        ("a", s, 0, True, [(150.0, 10.0), (149.0, 20.0)], [(151.0, 15.0), (152.0, 25.0)]),
        ("a", 5 * s, 1, False, [(150.0, 12.0)], [(151.0, 0.0)]),
        ("a", 12 * s, 2, False, [(149.0, 0.0)], [(153.0, 30.0)]),
        ("a", 22 * s, 3, False, [], []),
    ]
    out = {
        r.local_ts: (r.bids, r.asks)
        for r in bk.book_resample(spark.createDataFrame(rows, BOOK), 10 * s).collect()
    }
    assert out == {
        10 * s: ([(150.0, 12.0), (149.0, 20.0)], [(152.0, 25.0)]),
        20 * s: ([(150.0, 12.0)], [(152.0, 25.0), (153.0, 30.0)]),
    }
    with pytest.raises(ValueError):
        bk.book_resample(spark.createDataFrame(rows, BOOK), 0)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_resample_shuffles_levels_once(spark):
    rows = [(s, *r) for s in "xy" for r in random_records(ord(s))]
    df = spark.createDataFrame(rows, BOOK)
    # ties of a time, spans, levels
    assert shuffles(bk.book_resample(df, 10, as_levels=True)) <= 3
    # spans once more, lives by cells of boundaries
    assert shuffles(bk.book_resample(df, 10, top_n=2)) <= 5


def test_resample_top_without_keys_and_times(spark, monkeypatch):
    records = random_records(5, n=200)
    snap = [(100.0, 1.0)]
    rows = [("x", *r) for r in records] + [("x", None, 900 + i, False, [(90.0 + i, 9.0)], []) for i in range(3)]
    # levels of no key show in no book
    rows += [(None, 3, 0, True, snap, snap), (None, 24, 1, True, snap, [])]
    # a snapshot ahead of all times: the later of two prices holds
    rows += [("t", None, 0, True, snap, []), ("t", None, 1, False, [(100.0, 2.0)], []), ("t", 12, 2, False, [], snap)]
    rows += [("t", 31, 3, False, [(100.0, 0.0)], [])]
    df = spark.createDataFrame(rows, BOOK).repartition(3)
    want, _ = replay(records, 10)

    def top(book, side, sign):
        return sorted((p for s, p in book if s == side), key=lambda p: sign * p)[:2]

    for cell in (16, 1):
        monkeypatch.setattr(bk, "CELL", cell)
        books = bk.book_resample(df, 10, top_n=2).collect()
        got = {r.local_ts: ([v.price for v in r.bids], [v.price for v in r.asks]) for r in books if r.symbol == "x"}
        assert got == {at: (top(b, "bid", -1), top(b, "ask", 1)) for at, b in want.items()}
        assert sorted((r.local_ts, r.depth) for r in books if r.symbol is None) == [(10, 0), (20, 0)]
        held = sorted((r.local_ts, r.bids, r.asks) for r in books if r.symbol == "t")
        assert held == [(20, [(100.0, 2.0)], snap), (30, [(100.0, 2.0)], snap)]
        levels = bk.book_resample(df, 10, top_n=2, as_levels=True).collect()
        assert len(levels) == sum(len(r.bids) + len(r.asks) for r in books)
        assert {r.depth for r in bk.book_resample(df, 10, top_n=0).collect()} == {0}


def test_book_table_takes_one_shuffle_and_equals_the_sql(spark, tmp_path):
    import duckdb

    from tapeline.plans.books import BOOK as SQL
    from tapeline.plans.books import book_table

    con = duckdb.connect()
    con.sql(
        f"""COPY (SELECT (i % 400)::BIGINT AS l_orderkey, CASE WHEN i % 11 > 0 THEN i % 3 END::BIGINT AS l_suppkey,
        (i % 7 + 1)::INTEGER AS l_linenumber, (i * 7 % 50)::DOUBLE AS l_quantity,
        CASE WHEN i % 17 > 0 THEN i % 3 / 100.0 END::DOUBLE AS l_discount, (i % 2 / 100.0)::DOUBLE AS l_tax,
        CASE WHEN i % 5 = 0 THEN 'R' ELSE 'A' END AS l_returnflag,
        CASE WHEN i % 19 > 0 THEN TIMESTAMP '1969-12-20' + INTERVAL (i * i % 37) DAY + INTERVAL (i % 2) HOUR END AS l_shipdate
        FROM range(3000) t(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"""
    )
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(f"WITH {SQL} SELECT symbol, local_ts, is_snapshot, side, price, size FROM levels").fetchall()
    books = book_table(spark, str(tmp_path))
    assert shuffles(books) == 1
    got = [
        (r.symbol, r.local_ts, r.is_snapshot, side, v.price, v["size"])
        for r in books.collect()
        for side, levels in (("bid", r.bids), ("ask", r.asks))
        for v in levels
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def snapshots(spark):
    row = [("X", 1, [(100.0, 5.0), (99.0, 10.0)], [(102.0, 8.0), (101.0, 4.0)])]
    return spark.createDataFrame(row, f"symbol string, local_ts long, bids {LV}, asks {LV}")


@pytest.mark.parametrize(
    "side,size,price,slip,status",
    [
        ("buy", 2.0, 101.0, 0.0, "ok"),
        ("buy", 6.0, 608 / 6, 608 / 6 - 101, "ok"),
        ("sell", 10.0, 99.5, 0.5, "ok"),
        ("buy", 15.0, None, None, "exceeds_depth"),
    ],
)
def test_slippage(spark, side, size, price, slip, status):
    r = dp.slippage(snapshots(spark), side, size).first()
    assert r.status == status
    assert r.expected_price == (None if price is None else pytest.approx(price))
    assert r.slippage_usd == (None if slip is None else pytest.approx(slip))


def test_slippage_errors(spark):
    for side, size in (("buy", 0.0), ("hold", 1.0)):
        with pytest.raises(ValueError):
            dp.slippage(snapshots(spark), side, size)
    empty = snapshots(spark).withColumn("bids", F.array().cast(LV))
    assert dp.slippage(empty, "sell", 1.0).first().status == "no_levels"


BARS = "symbol string, local_ts long, open double, high double, low double, close double, volume double"


def test_volume_at_price(spark):
    two = spark.createDataFrame(
        [("a", 1, 10.0, 12.0, 10.0, 11.0, 100.0), ("a", 2, 11.0, 13.0, 11.0, 12.0, 200.0)], BARS
    )
    for method in dp.METHODS:
        total = dp.volume_at_price(two, bins=4, method=method).agg(F.sum("size")).first()[0]
        assert total == pytest.approx(300.0)
    one_price = spark.createDataFrame([("a", 1, 5.0, 5.0, 5.0, 5.0, 7.0)], BARS)
    assert [tuple(r) for r in dp.volume_at_price(one_price).collect()] == [("a", 5.0, 7.0)]
    dead = spark.createDataFrame([("a", 1, 5.0, 6.0, 5.0, 5.0, 0.0)], BARS)
    assert dp.volume_at_price(dead).count() == 0
    with pytest.raises(ValueError):
        dp.volume_at_price(two, bins=0)


def test_ladder(spark):
    profile = spark.createDataFrame([("a", float(p), 1.0) for p in range(98, 103)], "symbol string, price double, size double")
    ref = spark.createDataFrame([("a", 100.0)], "symbol string, reference_price double")
    rows = dp.ladder_top_n(profile, ref, top_n=2).orderBy("side", "level").collect()
    assert [(r.side, r.price) for r in rows] == [("ask", 101.0), ("ask", 102.0), ("bid", 99.0), ("bid", 98.0)]


FEED = "symbol string, local_ts long, is_snapshot boolean, seq long, prev_seq long, content string"


def gap_rule(rows):
    """Plain state machine over (ts, snap, seq, prev, content)."""
    out, started, last, last_content = {}, False, None, None
    for ts, snap, seq, prev, content in rows:
        if snap:
            started, last, last_content = True, seq, None
            out[ts] = "ok"
            continue
        if not started:
            out[ts] = None
            continue
        if seq is not None and seq == last:
            out[ts] = "gap" if last_content is not None and content != last_content else "duplicate"
        elif prev is not None:
            if last is None:
                ok = False
            elif last_content is None:
                ok = seq is not None and prev < last <= seq
            else:
                ok = prev == last
            out[ts] = "ok" if ok else "gap"
        else:
            out[ts] = "gap" if seq is not None and last is not None and seq != last + 1 else "ok"
        last = last if seq is None else seq
        last_content = content
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_book_gap(spark, segments, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for ts in range(60):
        n += rng.choice([0, 1, 1, 1, 2])
        snap = rng.random() < 0.15
        seq = None if rng.random() < 0.1 else n
        prev = rng.choice([None, n - 1, n - 2, n])
        rows.append((ts, snap, seq, prev, rng.choice("ab")))
    df = spark.createDataFrame([("s", *r) for r in rows], FEED)
    got = {r.local_ts: r.status for r in sq.book_gap(df, order=["local_ts"]).collect()}
    assert got == gap_rule(rows)
