"""Periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
from helpers import empty_documents, odd_documents, table

from tapeline.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=12):
    """Maximal stretches in which words q apart are the same, by the smallest q."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x - start >= q:
                least.setdefault((start, x - start + q), q)
            x += x == start
    return sorted((s, l, q) for (s, l), q in least.items() if l >= max(min_length, 2 * q))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_runs_equal_plain_python(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.choice([1, 3, 6])):
            n, kinds = rng.choice([0, 1, 2, 11, 12, 13, 30, 60, 120]), rng.choice([1, 2, 3, 20])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(words, np.int64))
        monkeypatch.setattr(runs, "PAIRS", rng.choice([7, 100, 1 << 19]))
        least = rng.choice([1, 12])
        for got, words in zip(runs.runs_of(texts, least), texts):
            assert [tuple(r) for r in got.tolist()] == plain_runs(words.tolist(), least)


def test_extensions_equal_comparing():
    rng = random.Random(5)
    for _ in range(60):
        base = [rng.randrange(2) for _ in range(rng.choice([3, 14, 40]))]
        words, _ = runs.joined([np.array(base * rng.choice([1, 2, 5]), np.int64)] * 2)
        n = len(words) - runs.COVER
        i, j = np.triu_indices(n, 1)
        room = np.full(len(i), len(words))
        assert runs.Extensions(words).of(i, j).tolist() == runs.agreeing(
            words, i, j, np.minimum(room, len(words) - j)
        ).tolist()


def test_long_runs():
    whole = runs.runs_of([np.zeros(60_000, np.int64), np.arange(90_000) % 30_000])
    assert [w.tolist() for w in whole] == [[[0, 60_000, 1]], [[0, 90_000, 30_000]]]


def test_query_equals_plain_python(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        kinds = ["a", "b", "été", "d　e"][: rng.choice([1, 2, 4])]
        words = rng.choices(kinds, k=rng.choice([0, 1, 9, 40, 200]))
        rows.append((i, rng.choice([" ", "\n", " \t", "\x0b"]).join(words)))
    rows += [(None, "x y z " * 9), (7, None), (10, "ab " * 1_500)]
    monkeypatch.setattr(queries, "read_table", lambda *_: table(spark, rows))
    got = sorted(map(tuple, queries.op13_runs(spark, "").collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert sum(1 for r in got if r[1]) > 60


def test_query_on_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0]: r[1] for r in docs if len(r[1] or "") < 6_000}
    got = {r[0]: tuple(r) for r in queries.op13_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == plain_row(i, t) for i, t in short.items())


def test_odd_tables(spark):
    found = runs.find_runs(odd_documents(spark)).collect()
    assert len(found) == 11
    by_id = {r["doc_id"]: r for r in found}
    assert [tuple(r) for r in by_id[6]["runs"]] == [(0, 80_000, 4)]
    assert by_id[6]["collapsed"] == "alpha beta gamma delta"
    assert by_id[2]["n_words"] == by_id[7]["n_words"] == 0 and by_id[7]["collapsed"] == ""
    assert runs.find_runs(empty_documents(spark)).collect() == []
