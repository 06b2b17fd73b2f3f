"""Live state machines over several micro-batches."""

import threading

import pytest
from conftest import SF
from pyspark.sql.streaming import StreamingQueryListener
from test_books import BOOK, FEED, gap_rule, random_records

from tapeline.operators import book as bk
from tapeline.plans import ORACLES, QUERIES
from tapeline.streaming import books as live
from tapeline.streaming.lake import drain
from tapeline.streaming.totals import LiveTotals, watch_totals

DEPTH = "symbol string, ord long, is_snapshot boolean, first_id long, final_id long, prev_id long"


def batches(spark, tmp_path, parts, schema):
    """One file, hence one micro-batch, per part, in order."""
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_resync_keeps_what_continues_the_snapshot(spark, tmp_path):
    def d(ord_, first, final=None):
        return ("s", ord_, False, first, final or first, first - 1)

    def snap(ord_, at):
        return ("s", ord_, True, at, at, None)

    parts = [
        [d(0, 4), snap(1, 5), d(2, 5), d(3, 6), d(4, 7)],
        [d(5, 10), d(6, 11)],
        [snap(7, 9), d(8, 12), d(9, 20)],
        [d(10, 30), snap(11, 20), d(12, 21)],
    ]
    out = drain(live.book_resync(batches(spark, tmp_path, parts, DEPTH)), "t")
    got = sorted((r.ord, r.emitted) for r in out.collect())
    assert got == [
        (1, "snapshot"), (3, "delta"), (4, "delta"),
        (5, "kept"), (6, "kept"), (7, "snapshot"), (8, "delta"),
        (11, "resync_failed"),
    ]


def test_resync_keeps_a_bounded_buffer(spark, tmp_path):
    def d(ord_, n):
        return ("s", ord_, False, n, n, n - 1)

    def snap(ord_, at):
        return ("s", ord_, True, at, at, None)

    parts = [
        [snap(0, 5), d(1, 6), d(2, 10), d(3, 11)],
        [d(4, 12), d(5, 13)],  # the fourth waiting delta starts the buffer anew
        [d(6, 14), snap(7, 12), d(8, 15), d(9, 20), d(10, 21), d(11, 22)],
        [d(12, 23), d(13, 24), snap(14, 21), d(15, 25)],
    ]
    out = drain(live.book_resync(batches(spark, tmp_path, parts, DEPTH), max_buffer=3), "t")
    got = sorted((r.ord, r.emitted) for r in out.collect())
    assert got == [
        (0, "snapshot"), (1, "delta"),
        (5, "buffer_full"), (5, "kept"), (6, "kept"), (7, "snapshot"), (8, "delta"),
        (12, "buffer_full"), (14, "resync_failed"),
    ]
    with pytest.raises(ValueError):
        live.book_resync(batches(spark, tmp_path, [], DEPTH), max_buffer=0)


def test_late_rows_over_batches(spark, tmp_path):
    import random

    from tapeline.operators.resample import order_violations
    from tapeline.streaming.order import ARRIVED, LATE, late_rows

    class Told(StreamingQueryListener):
        def __init__(self):
            self.batches, self.ended = [], threading.Event()

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            seen = event.progress.observedMetrics
            if seen.get(ARRIVED) and seen[ARRIVED]["rows"]:
                self.batches.append((seen[ARRIVED]["rows"], seen[LATE]["rows"]))

        def onQueryTerminated(self, event):
            self.ended.set()

    rng = random.Random(3)
    schema = "symbol string, venue string, ord long, local_ts long"
    big = 1_700_000_000_000_000_000
    rows = [
        (rng.choice(["a", "b", None]), rng.choice("xy"), i, None if rng.random() < 0.1 else big + i + rng.randrange(-20, 20))
        for i in range(300)
    ]
    keys = ["symbol", "venue"]
    told = Told()
    spark.streams.addListener(told)
    try:
        parts = [rows[:100], rows[100:130], rows[130:]]
        out = drain(late_rows(batches(spark, tmp_path, parts, schema), keys=keys), "t")
        assert told.ended.wait(30)
    finally:
        spark.streams.removeListener(told)
    want = order_violations(spark.createDataFrame(rows, schema), keys=keys, arrival=["ord"])
    want = sorted((r.ord, r.local_ts, r.prev_ts) for r in want.select("ord", "local_ts", "prev_ts").collect())
    assert want and sorted((r.ord, r.local_ts, r.prev_ts) for r in out.collect()) == want
    timed = [sum(r[3] is not None for r in part) for part in parts]
    assert [b[0] for b in told.batches] == timed and sum(b[1] for b in told.batches) == len(want)


def test_a_late_row_can_end_the_stream(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tapeline.streaming.order import late_rows

    schema = "symbol string, ord long, local_ts long"
    parts = [[("a", 0, 5), ("b", 1, 9)], [("a", 2, 5), ("a", 3, 4)]]
    with pytest.raises(StreamingQueryException, match="comes after 5"):
        drain(late_rows(batches(spark, tmp_path, parts, schema), refuse=True), "t")


@pytest.mark.parametrize("venue", live.VENUES)
def test_sync_actions(venue):
    sync = live.Sync(venue, None, None)
    assert sync.feed(1, 2, 0) == "DROP"
    sync.snapshot = 100
    assert sync.feed(90, 95, 89) == "DROP"
    assert sync.feed(103, 105, 102) == "RESYNC"
    assert sync.feed(98, 103, 97) == "APPLY"
    assert sync.feed(104, 106, 103) == "APPLY"
    assert sync.feed(108, 109, 107) == "RESYNC"


def test_gap_over_batches(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows, n = [], 0
    for ts in range(60):
        n += rng.choice([0, 1, 1, 1, 2])
        seq = None if rng.random() < 0.1 else n
        rows.append((ts, rng.random() < 0.15, seq, rng.choice([None, n - 1, n - 2]), rng.choice("ab")))
    full = [("s", *r) for r in rows]
    schema = FEED.replace("local_ts", "ord")
    out = drain(live.stream_book_gap(batches(spark, tmp_path, [full[:20], full[20:45], full[45:]], schema)), "t")
    want = {ts: status for ts, status in gap_rule(rows).items() if status is not None}
    assert {r.ord: r.status for r in out.collect()} == want


def test_live_book_ends_as_the_batch_one(spark, tmp_path):
    rows = [(s, i, i, *r[2:]) for s in "xyz" for i, r in enumerate(random_records(ord(s)))]
    schema = BOOK.replace("seq long", "ord long")
    parts = [[r for r in rows if lo <= r[1] < lo + 20] for lo in (0, 20, 40)]
    out = drain(live.stream_book(batches(spark, tmp_path, parts, schema)), "t")
    last = {}
    for r in out.orderBy("ord").collect():
        last[r.symbol] = (r.best_bid, r.best_ask, r.levels)
    df = spark.createDataFrame(rows, BOOK)
    book = bk.book_rebuild(df)
    best = {r.symbol: (r.best_bid, r.best_ask) for r in bk.best_prices(book).collect()}
    counts = {r.symbol: r["count"] for r in book.groupBy("symbol").count().collect()}
    for symbol, (bid, ask, levels) in last.items():
        assert (bid, ask) == best.get(symbol, (None, None)) and levels == counts.get(symbol, 0)


def test_reorg_over_batches(spark, tmp_path):
    schema = "chain string, ord long, block_number long, block_hash string, parent_hash string"
    parts = [
        [("c", 1, 10, "a10", "a9"), ("c", 2, 11, "a11", "a10"), ("c", 3, 12, "b12", "b11")],
        [("c", 4, 11, "b11", "a10"), ("c", 5, 12, "b12", "b11"), ("c", 6, 13, "c13", "c12")],
    ]
    out = drain(live.stream_reorg(batches(spark, tmp_path, parts, schema)), "t")
    got = sorted((r.block_number, r.fork_point, r.expected, r.got) for r in out.collect())
    assert got == [(12, 11, "a11", "b11"), (13, 12, "b12", "c12")]


def test_totals_of_every_batch(spark, tmp_path):
    schema = "symbol string, channel string, local_ts long, price double"
    parts = [
        [("a", "trade", 1, 10.0), ("b", "trade", 2, 20.0)],
        [("a", "trade", 5, 30.0), ("a", "trade", 4, 40.0), ("a", "book", 9, None)],
        [("c", "trade", 3, 50.0)],
    ]
    told = []
    totals = LiveTotals(told.append)
    spark.streams.addListener(totals)
    try:
        drain(watch_totals(batches(spark, tmp_path, parts, schema)), "t")
        assert totals.ended.wait(30)
    finally:
        spark.streams.removeListener(totals)
    got = [(b["batch"], b["rows"], b["valued"], b["last_value"], b["last_ts"]) for b in told]
    assert got == [(0, 2, 2, 20.0, 2), (1, 3, 2, 30.0, 9), (2, 1, 1, 50.0, 3)]
    assert (totals.rows, totals.last_value) == (6, 30.0) and totals.batches == told


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "macd" in df.columns
    assert SF.endswith("sf0.001")
