"""K-d shards: balance, the cells that the tree makes, and odd tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F

from tapeline.llm import queries, shards

SF = "/root/testdata/sf0.01"


def checked(placed, docs):
    """Rows by shard, after what must hold for every placing."""
    got = [tuple(r) for r in placed.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter(r[:3] for r in got) == want
    by_shard = defaultdict(list)
    for row in got:
        by_shard[row[3]].append(row)
    for rows in by_shard.values():
        assert sorted(r[4] for r in rows) == list(range(len(rows)))
    return by_shard


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    placed = queries.op11_kd_shards(spark, SF)
    assert {tuple(r) for r in placed.select("law", "grown_shard").distinct().collect()} == {("bytes", None)}
    by_shard = checked(placed, docs)
    assert sorted(by_shard) == list(range(8))
    weights = [sum(r[1] for r in rows) for rows in by_shard.values()]
    assert max(weights) <= 1.02 * sum(weights) / 8


def skewed(spark, n=4000):
    """A third of all rows are copies of one text, another third has one source."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        text = "the same text again " * 20 if i % 3 == 0 else f"text {i} " * rng.randint(1, 120)
        rows.append((i, text, rng.choice(["en", "de", None]), "hot" if i % 3 == 1 else f"src{i % 50}", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


@pytest.mark.parametrize("count", [1, 2, 3, 8, 13])
def test_balance_under_skew(spark, count):
    df, rows = skewed(spark)
    by_shard = checked(shards.shard_by_metadata(df, shards=count), [r[:2] for r in rows])
    weights = [sum(r[1] for r in by_shard[s]) for s in range(count)]
    assert max(weights) <= 1.03 * sum(weights) / count and min(weights) >= 0.97 * sum(weights) / count


def test_equal_texts_stay_together(spark):
    rng = random.Random(6)
    texts = [f"text {i} " * rng.randint(1, 40) for i in range(3000)]
    rows = [(i, rng.choice(texts[: 1 + i // 2]), rng.choice("abcd"), rng.choice("xyz"), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = shards.shard_by_metadata(df, shards=8)
    places = defaultdict(set)
    total = Counter()
    for r in placed.collect():
        places[rows[r["doc_id"]][1]].add(r["shard"])
        total[rows[r["doc_id"]][1]] += r["size"]
    part = sum(total.values()) / 8 / shards.SLICES
    copies = Counter(r[1] for r in rows)
    light = [t for t in places if total[t] <= part and copies[t] <= 6000 / 8 / shards.SLICES]
    assert len(light) > 500 and all(len(places[t]) == 1 for t in light)


def plain_cells(rows, count):
    """The tree over (values, tie, size) in plain Python, for items of one row each."""
    if count == 1:
        return [rows]
    dims = range(len(rows[0][0]))
    widest = max(dims, key=lambda d: (max(r[0][d] for r in rows) - min(r[0][d] for r in rows), -d))
    rows = sorted(rows, key=lambda r: (r[0][widest], r[1]))
    goal, below = sum(r[2] for r in rows) * (count // 2) / count, 0
    for at, row in enumerate(rows):
        if below + row[2] >= goal:
            break
        below += row[2]
    at += not goal - below < below + row[2] - goal
    return plain_cells(rows[:at], count // 2) + plain_cells(rows[at:], count - count // 2)


def test_cells_equal_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(shards, "SUMS", 20)  # many rounds
    rng = random.Random(9)
    rows = [(i, f"text {i} " * rng.randint(1, 60), rng.choice("abcdefgh"), rng.randint(0, 99)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    narrow = shards._numbered(df, ("lang", "n_chars"), "doc_id", "text")
    ends = narrow.agg(F.min("m0"), F.max("m0"), F.min("m1"), F.max("m1"), F.sum("size"), F.count("*")).first()
    items = shards._items(narrow, 5, ends[4], ends[5]).select(
        "doc_id",
        "size",
        "tie",
        shards._scaled(F.col("m0"), ends[0], ends[1]).alias("v0"),
        shards._scaled(F.col("m1"), ends[2], ends[3]).alias("v1"),
    )
    plain = [((r["v0"], r["v1"]), r["tie"], r["size"], r["doc_id"]) for r in items.collect()]
    want = {r[3]: s for s, cell in enumerate(plain_cells(plain, 5)) for r in cell}
    placed = shards.shard_by_metadata(df, shards=5, dimensions=("lang", "n_chars"))
    assert {r["doc_id"]: r["shard"] for r in placed.collect()} == want


def test_target_bytes_and_files(spark, tmp_path):
    df, rows = skewed(spark, 600)
    total = sum(len(r[1]) + 1 for r in rows)
    placed = shards.shard_by_metadata(df, target_bytes=total // 5)
    weights = Counter()
    for r in placed.collect():
        weights[r["shard"]] += r["size"]
    assert len(weights) == -(-total // (total // 5)) and max(weights.values()) <= 1.02 * (total // 5)
    shards.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*df.columns, "__shard"])
    assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter(rows)
    weights = [r["w"] for r in back.groupBy("__shard").agg(F.sum(F.octet_length("text") + 1).alias("w")).collect()]
    assert len(weights) == 4 and max(weights) <= 1.05 * total / 4


def test_odd_tables(spark):
    odd = odd_documents(spark)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    checked(shards.shard_by_metadata(odd, shards=8), rows)
    checked(shards.shard_by_metadata(odd, shards=3, dimensions=()), rows)
    same = spark.createDataFrame([(1, "x", None, None, 1)] * 50, odd.select("doc_id", "text", "lang", "source", "n_chars").schema)
    by_shard = checked(shards.shard_by_metadata(same, shards=8), [(1, "x")] * 50)
    assert sorted(by_shard) == list(range(8))  # copies of one row are dealt out
    assert shards.shard_by_metadata(empty_documents(spark), shards=8).collect() == []
    with pytest.raises(ValueError):
        shards.shard_by_metadata(odd)
