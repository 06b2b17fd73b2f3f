"""Lake layout, pruning, export and dead letters."""

import glob
import os

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapeline.schema import CHANNELS
from tapeline.sinks import conform as cf
from tapeline.sinks import lake as out
from tapeline.sources import catalog
from tapeline.sources import lake as src
from tapeline.sources import vendors as vn
from tapeline.streaming.lake import decode_frames, frames_write_stream, lake_write_stream

DAY1, DAY2 = 1700000000 * 10**9, 1700006400 * 10**9
S = 10**9


def trades(spark):
    rows = [("alpaca", "alpaca:AAPL", "AAPL", DAY1 + i * S, 100.0 * (i + 1), 2.0, "A") for i in range(3)]
    rows += [("alpaca", "alpaca:MSFT", "MSFT", DAY2, 50.0, 1.0, "B"), ("../evil", "x", "x", DAY1, 1.0, 1.0, "A")]
    return spark.createDataFrame(rows, "provider string, symbol string, symbol_raw string, local_ts long, price double, size double, tape string")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    out.lake_write(trades(spark), "trade", root)
    return root


def test_channels():
    assert len(CHANNELS) == 25


def test_layout_and_scan(spark, lake):
    assert glob.glob(f"{lake}/provider=alpaca/channel=trade/date=2023-11-14/bucket=*/*.zstd.parquet")
    assert not glob.glob(f"{lake}/provider=*evil*")
    got = src.lake_scan(spark, lake, "trade", "alpaca:AAPL", DAY1, DAY1 + S)
    assert [r.price for r in got.collect()] == [100.0, 200.0]
    assert got.columns == CHANNELS["trade"].names
    assert src.lake_scan(spark, lake, "trade", "nope", DAY1, DAY2).count() == 0
    assert src.lake_scan(spark, lake, "no_such_channel", "x", DAY1, DAY2).count() == 0
    assert src.lake_scan(spark, lake, "bar", "x", DAY1, DAY2).count() == 0
    assert src.lake_scan_many(spark, lake, "trade", ["alpaca:AAPL", "alpaca:MSFT"], DAY1, DAY2).count() == 4


def test_scan_prunes(spark, lake):
    df = src.lake_scan_many(spark, lake, "trade", ["alpaca:AAPL"], DAY1, DAY1 + S, ordered=False)
    plan = df.select("price")._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [" in scan and "date#" in scan.split("PartitionFilters")[1].split("]")[0]
    assert "In(symbol" in scan or "EqualTo(symbol" in scan
    assert "GreaterThanOrEqual(local_ts" in scan
    assert "tape" not in scan.split("ReadSchema")[1]
    assert all("date=2023-11-14" in f for f in df.inputFiles())
    assert src.dates_between(DAY1, DAY2) == ["2023-11-14", "2023-11-15"]
    assert src.dates_between(0, 9_999_999_999_999_999_999) is None
    assert len(src.dates_between(0, 500 * 86_400 * 10**9)) == 501


def test_unbucketed_files(spark, tmp_path):
    root = str(tmp_path)
    rows = out.lake_rows(trades(spark).where("provider = 'alpaca'"), "trade")
    rows.drop("bucket", "venue", "exchange").write.mode("append").partitionBy("provider", "channel", "date").parquet(root)
    assert src.lake_scan(spark, root, "trade", "alpaca:AAPL", DAY1, DAY2).count() == 3
    out.lake_write(trades(spark), "trade", root)
    assert src.lake_scan(spark, root, "trade", "alpaca:AAPL", DAY1, DAY2).count() == 6
    assert {r.channel: r["rows"] for r in src.lake_summary(spark, root).collect()} == {"trade": 8}


def test_compact(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        out.lake_write(trades(spark).withColumn("id", F.lit(i)), "trade", root)
    pattern = f"{root}/provider=alpaca/channel=trade/date=2023-11-14/bucket=*/*.parquet"
    before = len(glob.glob(pattern))
    other = sorted(glob.glob(f"{root}/provider=alpaca/channel=trade/date=2023-11-15/bucket=*/*.parquet"))
    out.compact(spark, root, "trade", "2023-11-14")
    assert len(glob.glob(pattern)) < before
    assert sorted(glob.glob(f"{root}/provider=alpaca/channel=trade/date=2023-11-15/bucket=*/*.parquet")) == other
    assert src.read_channel(spark, root, "trade").count() == 12


def test_compact_moves_files_without_a_bucket(spark, tmp_path):
    """Rows of an older writer move into buckets once, and stay once."""
    root = str(tmp_path)
    old = out.lake_rows(trades(spark), "trade").drop("bucket", "venue", "exchange")
    old.write.mode("append").partitionBy("provider", "channel", "date").parquet(root)
    out.lake_write(trades(spark), "trade", root)
    before = src.read_channel(spark, root, "trade").count()
    for _ in range(2):
        out.compact(spark, root, "trade", "2023-11-14")
        back = src.read_channel(spark, root, "trade")
        assert back.count() == before
        assert back.where("date = '2023-11-14' AND bucket IS NULL").isEmpty()


def test_scan_reads_one_bucket(spark, tmp_path):
    root = str(tmp_path)
    many = spark.range(200).select(
        F.lit("p").alias("provider"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"),
        F.lit("x").alias("symbol_raw"), F.lit(DAY1).alias("local_ts"), F.lit(1.0).alias("price"), F.lit(1.0).alias("size"),
    )
    out.lake_write(many, "trade", root, buckets=16)
    got = src.lake_scan(spark, root, "trade", "s7", DAY1, DAY2)
    assert [r.symbol for r in got.collect()] == ["s7"]
    folders = {f.rsplit("/", 2)[1] for f in src.filter_buckets(src.read_channel(spark, root, "trade"), ["s7"], 16).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(folders) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    with pytest.raises(ValueError):
        out.lake_write(many, "trade", root, buckets=8)


def test_rejected_rows_are_kept(spark, tmp_path):
    root = str(tmp_path)
    bad = trades(spark).withColumn("provider", F.lit("no folder/name"))
    out.lake_write(bad, "trade", root)
    assert src.read_channel(spark, root, "trade").count() == 0
    assert spark.read.parquet(f"{root}/{out.REJECTED}/trade").count() == bad.count()


def test_conform(spark):
    lv = "array<struct<price:double,amount:double>>"
    df = spark.createDataFrame([("p", "s", 1, [(1.0, 2.0)], None)], f"provider string, symbol string, local_ts long, bids {lv}, asks {lv}")
    r = cf.conform_channel(df, "book_snapshot").first()
    assert r.is_snapshot is True and r.bids[0]["size"] == 2.0 and r.asks == []
    assert cf.conform_channel(df, "book_delta").first().is_snapshot is False
    moved = cf.derive_partition_cols(df.withColumn("date", F.lit("2020-01-01")), "short_volume")
    assert moved.first().date_val == "2020-01-01" and moved.first().date == "1970-01-01"
    with pytest.raises(ValueError):
        cf.conform_channel(df, "nothing")


def test_export(spark, lake, tmp_path):
    df = src.read_channel(spark, lake, "trade")
    out.export(df, "arrow", str(tmp_path / "a"), limit=2)
    files = glob.glob(str(tmp_path / "a" / "*.arrow"))
    assert sum(pa.ipc.open_file(f).read_all().num_rows for f in files) == 2
    out.export(df.withColumn("conditions", F.array(F.lit("x"), F.lit("y"))), "csv", str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().conditions == "x,y"
    out.export(df, "json", str(tmp_path / "j"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "j")).count() == 4
    with pytest.raises(ValueError):
        out.export(df, "xml", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        out.export(df, "csv", str(tmp_path / "x"), limit=-1)
    with pytest.raises(ValueError):
        out.export(df, "arrow", str(tmp_path / "x"))


def test_eod_files(spark, tmp_path):
    (tmp_path / "aapl.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-06-20,180,182,179,181,5000000\nbad,1,1,1,1,1\n")
    (tmp_path / "msft.txt").write_text("<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\r\n20260620,180,182,179,181,5000000\r\n")
    (tmp_path / "^spx.csv").write_text("Date,Open,High,Low,Close\n2026-06-20,180,182,179,181\n")
    bars, index = vn.src_eod_csv(vn.read_eod_csv(spark, str(tmp_path)))
    got = sorted((r.symbol, r.open, r.high, r.low, r.close, r.volume) for r in bars.collect())
    assert got == [("AAPL", 180.0, 182.0, 179.0, 181.0, 5e6), ("MSFT", 180.0, 182.0, 179.0, 181.0, 5e6)]
    assert [(r.symbol, r.value) for r in index.collect()] == [("^SPX", 181.0)]


def test_frames_and_dead_letters(spark, tmp_path):
    raw = spark.createDataFrame([(DAY1, '{"s":"A","p":1.5}'), (DAY1, '{"s":"B"'), (DAY1, None)], "local_ts long, raw string")
    good, bad = decode_frames(raw, "s string, p double")
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["empty frame", "malformed json"]
    inbox, root, dead = (str(tmp_path / n) for n in ("in", "lake", "dead"))
    raw.write.parquet(inbox)

    def to_trades(df):
        return df.select(
            F.lit("p").alias("provider"), F.col("s").alias("symbol"), F.col("s").alias("symbol_raw"), "local_ts", F.col("p").alias("price"), F.lit(1.0).alias("size")
        )

    query = frames_write_stream(
        spark.readStream.schema(raw.schema).parquet(inbox), "s string, p double", to_trades, "trade", root, dead,
        checkpoint=str(tmp_path / "state"), every=None,
    )
    query.awaitTermination()
    assert src.read_channel(spark, root, "trade").count() == 1
    assert sorted(r.error for r in spark.read.parquet(f"{dead}/batch=0").collect()) == ["empty frame", "malformed json"]
    assert os.path.isdir(root)


@pytest.mark.parametrize("stop", ["before", "after"])
def test_a_repeated_batch_is_written_once(spark, tmp_path, monkeypatch, stop):
    """The driver stops before or after the commit of a stream's second batch."""
    inbox, root, state = (str(tmp_path / n) for n in ("in", "lake", "state"))
    rows = days_of_symbols(spark, 1, 2)
    for part in (0, 1):
        rows.where(F.col("price") % 4 >= 2 * part).coalesce(1).write.mode("append").parquet(inbox)
    total = rows.count() + rows.where("price % 4 >= 2").count()
    real, calls = catalog.commit, []

    def commit(*args, **more):
        calls.append(more["batch"])
        if len(calls) == 2 and stop == "before":
            raise RuntimeError("stopped")
        real(*args, **more)
        if len(calls) == 2:
            raise RuntimeError("stopped")

    monkeypatch.setattr(catalog, "commit", commit)

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        lake_write_stream(stream, "trade", root, checkpoint=state, every=None, buckets=1).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert calls == [(state, 0), (state, 1)] + [(state, 1)] * (stop == "before")
    assert src.read_channel(spark, root, "trade").count() == total


def test_batches_are_known_after_compaction(spark, tmp_path):
    root = str(tmp_path)
    rows = days_of_symbols(spark, 1, 2)
    for n in (0, 1):
        out.lake_write(rows, "trade", root, buckets=1, batch=("s", n))
    out.lake_write(rows.limit(0), "trade", root, buckets=1, batch=("s", 2))
    out.compact(spark, root, "trade", "2023-11-15")
    catalog.fold(spark, root, "trade")
    for n in (0, 1, 2):
        out.lake_write(rows, "trade", root, buckets=1, batch=("s", n))
    assert src.read_channel(spark, root, "trade").count() == 2 * rows.count()
    out.lake_write(rows, "trade", root, buckets=1, batch=("other", 0))
    out.lake_write(rows, "trade", root, buckets=1, batch=("s", 3))
    assert src.read_channel(spark, root, "trade").count() == 4 * rows.count()


def days_of_symbols(spark, days=3, symbols=40):
    """A row for every symbol, day and hour."""
    hours = spark.range(days * 24 * symbols)
    return hours.select(
        F.lit("p").alias("provider"),
        F.concat(F.lit("s"), F.col("id") % symbols).alias("symbol"),
        F.lit("x").alias("symbol_raw"),
        (F.lit(1700006400 * S) + F.floor(F.col("id") / symbols) * 3600 * S).alias("local_ts"),
        F.col("id").cast("double").alias("price"),
        F.lit(1.0).alias("size"),
    )


@pytest.mark.parametrize("listed", [256, 2])
def test_scans_choose_files_from_the_catalog(spark, tmp_path, monkeypatch, listed):
    """One symbol and one day read one file, and nothing lists the lake's folders."""
    root = str(tmp_path)
    monkeypatch.setattr(catalog, "LISTED", listed)
    out.lake_write(days_of_symbols(spark), "trade", root, buckets=16)
    out.lake_write(days_of_symbols(spark).withColumn("symbol", F.concat(F.lit("t"), "symbol")), "trade", root, buckets=16)
    monkeypatch.setattr(src, "_read_layouts", None)
    day = 1700006400 * S
    got = src.lake_scan(spark, root, "trade", "s7", day, day + 86_400 * S - 1)
    assert len(got.inputFiles()) == 1 and got.count() == 24
    assert src.lake_scan(spark, root, "trade", "s7", day + 3 * 86_400 * S, day + 9 * 86_400 * S).inputFiles() == []
    assert src.lake_scan(spark, root, "trade", "nothing", day, day + 86_400 * S).count() == 0
    assert {r.channel: r["rows"] for r in src.lake_summary(spark, root).collect()} == {"trade": 2 * 3 * 24 * 40}
    assert src.lake_symbols(spark, root, "trade").count() == 80
    for symbols in (None, ["s7"], ["s7", "ts9", "nothing"]):
        assert tuple(src.lake_time_range(spark, root, "trade", symbols).first()) == (day, day + 71 * 3600 * S)
    assert tuple(src.lake_time_range(spark, root, "trade", ["nothing"]).first()) == (None, None)
    assert src.lake_views(spark, root) == ["trade"] and src.read_channel(spark, root, "quote").count() == 0
    plan = src.lake_time_range(spark, root, "trade")._jdf.queryExecution().executedPlan().toString()
    assert "provider=" not in plan  # no file of rows


def test_bloom_filter_loses_no_symbol(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(catalog, "LISTED", 0)
    out.lake_write(days_of_symbols(spark, 1, 300), "trade", root, buckets=1)
    files = catalog.live_files(spark, root, "trade")
    held = files.select(*[catalog.may_hold([f"s{i}"]).alias(f"c{i}") for i in range(300)]).collect()
    assert all(any(row[f"c{i}"] for row in held) for i in range(300))
    wrong = files.select(*[catalog.may_hold([f"no{i}"]).alias(f"c{i}") for i in range(300)]).collect()
    assert sum(any(row[f"c{i}"] for row in wrong) for i in range(300)) < 15


def test_files_of_other_writers_are_adopted(spark, tmp_path):
    root = str(tmp_path)
    out.lake_write(days_of_symbols(spark), "trade", root, buckets=2)
    other = out.lake_rows(days_of_symbols(spark), "quote", 2)
    other.write.mode("append").partitionBy("provider", "channel", "date", "bucket").parquet(root)
    assert src.read_channel(spark, root, "quote").count() == 0
    for _ in range(2):
        catalog.adopt(spark, root)
        assert src.read_channel(spark, root, "quote").count() == 3 * 24 * 40
        assert src.read_channel(spark, root, "trade").count() == 3 * 24 * 40


def test_compact_is_one_step(spark, tmp_path, monkeypatch):
    """A stop at any point leaves every row once, and appends meanwhile stay."""
    root, day = str(tmp_path), "2023-11-15"
    for _ in range(2):
        out.lake_write(days_of_symbols(spark), "trade", root, buckets=2)
    count = src.read_channel(spark, root, "trade").count()

    def stopped(*_, **__):
        raise RuntimeError("stopped")

    def appended(*args):
        added = written(*args)
        patch.undo()
        out.lake_write(days_of_symbols(spark, 1, 1), "trade", root, buckets=2)
        return added

    written = catalog.written
    with monkeypatch.context() as patch:
        patch.setattr(catalog, "commit", stopped)
        with pytest.raises(RuntimeError):
            out.compact(spark, root, "trade", day)
    assert src.read_channel(spark, root, "trade").count() == count
    with monkeypatch.context() as patch:
        patch.setattr(out, "_delete", stopped)
        with pytest.raises(RuntimeError):
            out.compact(spark, root, "trade", day)
    assert src.read_channel(spark, root, "trade").count() == count
    # rows that come in before the commit
    with monkeypatch.context() as patch:
        patch.setattr(catalog, "written", appended)
        out.compact(spark, root, "trade", day)
    assert src.read_channel(spark, root, "trade").count() == count + 24
    count += 24
    catalog.fold(spark, root, "trade")
    assert len(glob.glob(f"{root}/_files/channel=trade/*.parquet")) == 1
    assert src.read_channel(spark, root, "trade").count() == count
    assert src.lake_scan(spark, root, "trade", "s7", DAY1, DAY2 + 86_400 * S).count() == 50
    assert src.lake_scan(spark, root, "trade", "s0", DAY1, DAY2 + 86_400 * S).count() == 50 + 24


def test_queries_write_only_the_channels_they_read(spark, monkeypatch):
    from tapeline.plans import QUERIES, lakeq

    written, write = [], out.lake_write

    def noted(df, channel, *args, **kwargs):
        written.append(channel)
        return write(df, channel, *args, **kwargs)

    monkeypatch.setattr(lakeq, "_roots", {})
    monkeypatch.setattr(lakeq.out, "lake_write", noted)
    QUERIES["lake_scan_many"](spark, "/root/testdata/sf0.001").collect()
    assert written == ["trade"]
    QUERIES["lake_views"](spark, "/root/testdata/sf0.001").collect()
    assert written == ["trade", "quote"]
