"""Syncmer fingerprints and SimHash classes against plain Python."""

import hashlib
import random

import duckdb
import xxhash
from helpers import ROWS, empty_documents, odd_documents, table

from tapeline.llm import jaccard, simhash, syncmers
from tapeline.llm.graph import connected_components

M = 2**64 - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_fingerprint(text):
    k, s = syncmers.K, syncmers.S

    def inner(i):
        h = 0
        for j in range(s):
            h = (h * 0x9E3779B97F4A7C15 + ord(text[i + j]) + 1) & M
        return mix(h)

    first = {}
    for i in range(len(text) - k + 1):
        hashes = [inner(i + j) for j in range(k - s + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            h, covered = hashes[0], s
            while covered < k:
                step = min(covered, k - s)
                h = mix((h * 0xD6E8FEB86659FD93 + hashes[step]) & M)
                covered = step + s
            first.setdefault(h >> 32, i)
    if text and not first:
        return (xxhash.xxh32_intdigest(text.encode()),)
    least = sorted(first)[: syncmers.SKETCH]
    return tuple(sorted(least, key=first.get))


def test_fingerprints_equal_plain_python():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdé 日", k=rng.choice([0, 3, 11, 12, 13, 40, 400, 3000]))) for _ in range(60)]
    assert syncmers.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_every_text_has_a_fingerprint():
    rng = random.Random(2)
    texts = sorted({"".join(rng.choices("abcdefgh ", k=n)) for n in range(1, 19) for _ in range(30)})
    found = syncmers.fingerprints(texts)
    assert all(found) and found == [plain_fingerprint(t) for t in texts]
    short = [f for f, t in zip(found, texts) if 12 <= len(t)]
    assert len(set(short)) == len(short)
    assert syncmers.fingerprints(["", "x"])[0] == ()


def test_likeness():
    a = tuple(range(100, 200))
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness((), ()) == 1
    assert syncmers.likeness(a, ()) == 0 and syncmers.likeness(a, tuple(range(300, 400))) == 0
    # the same anchors in another order are no match in place
    assert syncmers.likeness(a, a[::-1]) < 0.05
    assert syncmers.from_hex(syncmers.to_hex(a)) == a


def test_edits_against_plain_python(spark):
    docs = odd_documents(spark)
    rows = syncmers.fingerprint_edits(docs).collect()
    texts = sorted(
        [(i is not None, i or 0, t or "") for i, t in ROWS], key=lambda r: (r[0], r[1])
    )
    assert len(rows) == len(ROWS)
    by_id = {}
    for known, i, t in texts:
        by_id.setdefault(i if known else None, set()).add(t)
    order = [(i if known else None, t) for known, i, t in texts]
    want = set()
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        want.add((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == want
    for r in rows:
        (text,) = by_id[r.doc_id]
        assert r.fingerprint == syncmers.to_hex(plain_fingerprint(text)) if len(text) < 10_000 else r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert syncmers.fingerprint_edits(empty_documents(spark)).count() == 0
    one = syncmers.fingerprint_edits(table(spark, [(1, "only one text here, its own next")])).first()
    assert one.near_next == 1


def test_edit_is_told_from_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 400")
    rows = syncmers.fingerprint_edits(docs).collect()
    near = sum(r.near_edited for r in rows) / len(rows)
    assert 0.45 < near < 0.75
    assert sum(r.near_next < r.near_edited for r in rows) > 0.97 * len(rows)


def test_anchors_of_a_passage_keep_their_distance(spark):
    passage = "".join(random.Random(2).choices("abcdefgh ", k=300))
    docs = table(spark, [(1, passage), (2, "lead of another document " + passage)])
    found = {i: {} for i in (1, 2)}
    for r in syncmers.syncmer_anchors(docs).collect():
        found[r.doc_id][r.hash] = r.position
    assert found[1] and all(found[2][h] - p == 25 for h, p in found[1].items())


def plain_simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest id that links reach, by comparing all pairs."""
    n = len(prints)
    low = list(range(n))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_of_edge_cases(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = {plain_simhash(t or "") for i, t in ROWS if i == r.doc_id}
        assert {r.fp & M} == texts
    of = {r.doc_id: r.component_id for r in rows}
    assert of[4] == of[5] == 4 and of[2] == of[3] == of[7] == 2
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def test_classes_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_simhash(r.text or "") for r in docs]
    want = {docs[i].doc_id: docs[c].doc_id for i, c in enumerate(plain_classes(prints))}
    got = simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_hot_shards_lose_no_link(spark, monkeypatch):
    """Chains and balls of fingerprints that share shards, cut into tiny blocks."""
    monkeypatch.setattr(simhash, "TREE_ROWS", 8)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = random.Random(4)
    prints = {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(16)
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))
    roots = {r.node & M: r.root & M for r in connected_components(links).collect()}
    want = plain_classes(prints)
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(prints[i])
    got = {}
    for p in prints:
        got.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(400, 401), (400, 400)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    for r in rows:
        assert r.root == (400 if r.node >= 400 else (r.node - 1) // 50 * 50 + 1)
    assert len(rows) == len({r.node for r in rows})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 6, 8, 9] and ids.count(None) == 1
    assert simhash.keep_one(empty_documents(spark)).count() == 0


def near_copies():
    """Texts, each with copies that have more and more words changed; every text once more."""
    rng = random.Random(11)
    rows = []
    for n in (1, 4, 12, 60, 150, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            rows.append(" ".join(words))
            for changed in (1, 1, 2, 4, 8, 12, 16):
                other = list(words)
                for _ in range(changed):
                    other[rng.randrange(n)] = f"v{rng.randrange(3000)}"
                rows.append(" ".join(other))
    return [(i, t) for i, t in enumerate(rows + [t.upper() for t in rows])]


def jaccard_classes(rows):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_copies_of_the_pipeline_equal_all_pairs(spark, monkeypatch):
    import corpus_pipeline

    rows = near_copies()
    want = jaccard_classes(rows)
    docs = table(spark, rows).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(want.values())
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)  # units cut into pairs of blocks
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want


def test_one_row_of_each_class_stays_where_ids_repeat_or_are_null(spark):
    import corpus_pipeline

    def text(seed, changed=False):
        words = [f"w{seed}x{i}" for i in range(80)]
        return " ".join(words[:-1] + ["other"] if changed else words)

    rows = [(1, text(1)), (2, text(1, True)), (2, text(2)), (3, text(2, True)), (3, text(3)), (3, text(3))]
    rows += [(5, text(4)), (5, text(4, True)), (None, text(1).upper()), (None, text(5)), (None, text(5, True))]
    rows += [(None, text(6)), (7, None), (7, ""), (8, "")]
    docs = table(spark, rows).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(((r.doc_id, (r.text or "").split(" ")[0].lower()) for r in stage(spark, docs, "").collect()), key=repr)
    want = [(1, "w1x0"), (2, "w2x0"), (3, "w3x0"), (5, "w4x0"), (None, "w5x0"), (None, "w6x0"), (7, "")]
    assert got == sorted(want, key=repr)


def test_near_copies_of_edge_cases(spark):
    ids = [r.doc_id for r in jaccard.keep_one(odd_documents(spark)).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 6, 8, 9] and ids.count(None) == 1
    assert jaccard.keep_one(empty_documents(spark)).count() == 0


def test_fingerprint_text_is_hex_of_the_bits(spark):
    from tapeline.llm.queries import op2_simhash

    rows = {r.doc_id: r.fingerprint for r in op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    texts = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert rows == {i: f"{plain_simhash(t or ''):016x}" for i, t in texts}
