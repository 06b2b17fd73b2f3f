"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import empty_documents, odd_documents, table
from pyspark.sql import functions as F

from tapeline.llm import queries, variants

SF = "/root/testdata/sf0.01"


def plain_groups(counts, ratio=5):
    """word -> (form, root, n, n_near, form_n), by each word's single deletions."""
    def less(word):
        return {word[:i] + word[i + 1 :] for i in range(len(word))}

    holes, near = {}, {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
        for d in less(w):
            if d in counts:
                near[w].add(d)
                near[d].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_words(docs):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def words_of(rng, count):
    """Words with many near ones: random edits of a few stems, accents and long ones."""
    letters = "abcdeéßz"
    words = set()
    stems = ["".join(rng.choices(letters, k=rng.choice([6, 7, 9, 12, 40]))) for _ in range(25)]
    while len(words) < count:
        w = rng.choice(stems)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if len(w) > 1:
            words.add(w)
    return {w: rng.choice([5, 6, 30, 31, 200, 5000]) for w in sorted(words)}


def test_groups_equal_plain_python(spark, monkeypatch):
    rng = random.Random(2)
    counts = words_of(rng, 1500)
    counts |= {"x" * 300: 9, "x" * 299: 90, "y" + "x" * 300: 900, "ab" * 200: 7, "ab" * 199 + "a": 70}
    want = plain_groups(counts)
    assert sum(1 for v in want.values() if v[0]) > 200 and any(want[v[0]][0] for v in want.values() if v[0])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    for subtree, block in ((4_000, 1 << 17), (50, 64), (1, 7)):
        monkeypatch.setattr(variants, "SUBTREE", subtree)
        monkeypatch.setattr(variants, "BLOCK", block)
        assert result(variants.variant_groups(df)) == want


def test_trie_finds_all_within_the_budget():
    rng = random.Random(7)
    counts = np.array(sorted({tuple(rng.choices(range(2), k=variants.GROUPS)) for _ in range(600)}), np.uint8)
    queries_ = counts[:80].astype(np.int64)
    for q in queries_:
        q[rng.randrange(variants.GROUPS)] += rng.choice([0, 1])
    none = np.zeros(len(queries_), np.int64)
    got = {(int(a), int(b)) for qs, ws in variants.Trie(counts, 0).search(queries_, none, none) for a, b in zip(qs, ws)}
    want = set()
    for a, q in enumerate(queries_.tolist()):
        for b, w in enumerate(counts.tolist()):
            more = [x - y for x, y in zip(w, q)]
            if all(abs(m) <= 1 for m in more) and more.count(1) <= 1 and more.count(-1) <= 1:
                want.add((a, b))
    assert got == want and len(want) > 400


def test_one_edit():
    words = ["abcdef", "abcdeg", "abcde", "bcdef", "abxcdef", "abdcef", "fedcba", "aabcdef", "aaabcdef"]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    a, b = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    a, b = a[a != b], b[a != b]
    near = {(words[i], words[j]) for i, j, ok in zip(a, b, variants.one_edit(codes, start, size, a, b)) if ok}
    pairs = [("abcdef", w) for w in ("abcdeg", "abcde", "bcdef", "abxcdef", "aabcdef")]
    pairs += [("abcdeg", "abcde"), ("aabcdef", "aaabcdef"), ("abxcdef", "aabcdef")][:2]
    assert near == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_query_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_words(docs)
    assert result(queries.op12_variants(spark, SF)) == plain_groups(counts)


def test_query_on_a_fixture(spark, monkeypatch):
    rng = random.Random(11)
    words = list(words_of(rng, 60))
    rows = [(i, " ".join(w if rng.random() < 0.9 else w.upper() for w in rng.choices(words, k=40))) for i in range(300)]
    rows += [(None, "straße× Straße÷ ÀÉÎabc " * 12), (4, None), (5, "")]
    monkeypatch.setattr(queries, "read_table", lambda *_: table(spark, rows))
    want = plain_groups(plain_words(rows))
    assert len(want) > 60 and result(queries.op12_variants(spark, "")) == want


def test_odd_tables(spark):
    found = queries.misspelt_runs(odd_documents(spark))
    words = variants.frequent_words(found, F.col("word"))
    # the long text alone repeats; one of its words may have lost a letter
    assert {r[0] for r in words.collect()} <= {"alpha", "gamma", "delta"}
    assert result(variants.variant_groups(words)) == {}
    empty = variants.frequent_words(queries.misspelt_runs(empty_documents(spark)), F.col("word"))
    assert result(variants.variant_groups(empty)) == {}
    one = spark.createDataFrame([("single", 7)], "word string, n long")
    assert result(variants.variant_groups(one)) == {"single": (None, "single", 7, 0, None)}


def test_vectors_clip():
    counts = variants.vectors(pa.array(["a" * 300 + "b", "", "日b"]), {97: 0, 98: 1})
    assert counts[0][:2].tolist() == [255, 1] and counts[1].sum() == 0 and counts[2].sum() == 2
