"""Toxicity, quality and language-model operators against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ROWS, empty_documents, odd_documents, table
from pyspark.sql import functions as F

from tapeline.llm import gru, quality, toxicity

SF = "/root/testdata/sf0.01"


# -- toxicity ---------------------------------------------------------------------


def random_vectors(n, width, rng):
    out = []
    for _ in range(n):
        k = rng.randint(0, 6)
        terms = np.array(sorted(rng.sample(range(width), k)), np.int64)
        weights = np.array([rng.choice([0.2, 0.5, 1.0]) for _ in range(k)])
        norm = math.sqrt((weights**2).sum()) or 1.0
        out.append((terms, weights / norm))
    return out


def test_block_max_search_is_exact():
    rng = random.Random(1)
    vectors = random_vectors(900, 40, rng)
    index = toxicity.BlockMaxIndex(vectors, 40)
    for q in random_vectors(60, 40, rng):
        ids, sims = index.top(*q, 25)
        dense = np.zeros(40)
        dense[q[0]] = q[1]
        scores = [(-round(float((dense[t] * w).sum()), 9), i) for i, (t, w) in enumerate(vectors)]
        want = [(i, -s) for s, i in sorted(scores) if s < 0][:25]
        assert ids.tolist() == [i for i, _ in want]
        assert sims.tolist() == pytest.approx([w for _, w in want])


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    raw = rng.random(500).round(2)
    label = (rng.random(500) < raw).astype(int)
    steps, values = toxicity.isotonic(raw, label)
    assert (np.diff(values) >= 0).all() and (np.diff(steps) > 0).all()
    assert 0 < values[0] < 0.4 and 0.6 < values[-1] < 1


def test_held_out_toxicity(spark):
    from tapeline.llm.queries import op3_toxicity

    rows = op3_toxicity(spark, SF).select("doc_id", "held_out", "score", "predicted").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    seen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in seen if y], [s for s, y in seen if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert wins > 0.85
    assert sum(s >= 0.3 for s in clean) <= 0.05 * len(clean)


def test_toxicity_of_edge_cases(spark):
    insults = [(i, "you utter numbskull of a numbskull go away" if i % 2 else "a fine day by the sea") for i in range(80)]
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(80)] + [(3, 0), (None, 1), (200, None)], "doc_id long, toxic int"
    )
    model = toxicity.fit(table(spark, insults), labels)
    texts = table(spark, [(1, "what a numbskull"), (2, "what a day by the sea"), (3, None), (4, "")])
    got = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[4].score < 0.3
    assert got[1].evidence[0].label == 1
    docs = odd_documents(spark)
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    kept = toxicity.drop_toxic(docs, model)
    assert len(scores) == len(ROWS) and kept.columns == docs.columns
    assert kept.count() == sum(s < toxicity.THRESHOLD for s in scores)
    assert toxicity.score(empty_documents(spark), model).count() == 0
    none = toxicity.fit(table(spark, insults), labels.limit(0))
    assert {r.score for r in toxicity.score(texts, none).collect()} == {0.0}


# -- quality ----------------------------------------------------------------------


def plain_counts(text):
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts(spark):
    rng = random.Random(3)
    texts = [t for _, t in ROWS if t is None or len(t) < 10_000]
    texts += [" ".join(rng.choices(["a", "b", "#c", "é", "|", "d\n", "\n", "[x]"], k=rng.randint(0, 60))) for _ in range(120)]
    docs = table(spark, list(enumerate(texts))).withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    for r in quality.count_statistics(docs).collect():
        assert tuple(r[c] for c in quality.COUNTS) == plain_counts(texts[r.doc_id])


def plain_distances(x):
    """The documented estimate of one group, row by row."""
    quartile = [sorted(col) for col in x.T]
    n = len(x)

    def pick(col, share):
        return col[max(math.ceil(share * n), 1) - 1]

    mean = np.array([pick(c, 0.5) for c in quartile])
    spread = np.array([(pick(c, 0.75) - pick(c, 0.25)) / 1.349 for c in quartile])
    inverse = np.diag(1 / (spread**2 + np.square(quality.FLOOR)))

    def distances():
        gap = x - mean
        return np.einsum("ni,ij,nj->n", gap, inverse, gap)

    def centre(rows, widen):
        part = x[rows]
        cov = part.T @ part / len(part) - np.outer(part.mean(0), part.mean(0))
        return part.mean(0), np.linalg.inv(cov * widen + np.diag(np.square(quality.FLOOR)))

    wide = (quality.HIGH - quality.LOW) / quality.BINS
    for _ in range(quality.STEPS):
        level = np.log(np.maximum(distances(), math.exp(quality.LOW)))
        bins = np.minimum(np.floor((level - quality.LOW) / wide), quality.BINS - 1)
        order = np.sort(bins)
        edge = order[math.ceil(quality.SUPPORT * n) - 1]
        mean, inverse = centre(bins <= edge, quality.CONSISTENT)
    mean, inverse = centre(distances() <= quality.REWEIGHT, 1.0)
    return distances()


def test_distances_of_one_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 5)) * [1, 0.2, 0.5, 0.5, 0.5] + 3
    x[:30] += 9
    rows = spark.createDataFrame(
        [(i, "g", *map(float, r)) for i, r in enumerate(x)], "i int, grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES)
    ).repartition(4)
    centres = quality.mcd_centres(rows)
    got = rows.join(centres, F.col("grp") == F.col("g")).select("i", quality._distance().alias("d")).collect()
    want = plain_distances(x)
    for r in got:
        assert r.d == pytest.approx(want[r.i], rel=1e-6)
    assert min(r.d for r in got if r.i < 30) > quality.CUTOFF > max(r.d for r in got if r.i >= 30)


def test_alike_junk_of_a_third_goes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for share in (0.1, 0.3, 0.34):
        for far in (6, 10, 30):
            x = rng.normal(0, 1, (1500, 5)) * [0.8, 0.1, 0.5, 0.5, 0.5] + 3
            junk = rng.random(len(x)) < share
            x[junk] = rng.normal(0, 0.05, (junk.sum(), 5)) + [3, 3, 3 + far, 3, 3 + far]
            rows += [(bool(j), f"{share} {far}", *map(float, r)) for j, r in zip(junk, x)]
    rows = spark.createDataFrame(
        rows, "junk boolean, grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES)
    ).repartition(4)
    centres = quality.mcd_centres(rows)
    judged = rows.join(centres, F.col("grp") == F.col("g")).withColumn("out", quality._distance() > quality.CUTOFF)
    for r in judged.groupBy("grp", "junk").agg(F.avg(F.col("out").cast("int")).alias("gone")).collect():
        assert r.gone == (1 if r.junk else 0), r


def test_clean_stays_and_junk_goes(spark):
    rows = quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    kind = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len({r.doc_id for r in rows}) == 1000
    good = [r.kept for r in rows if not r.base_failed and kind.get(r.doc_id) == 1]
    junk = [r.kept for r in rows if kind.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_quality_of_edge_cases(spark):
    rows = quality.judge(odd_documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 6, 7))
    assert quality.judge(empty_documents(spark)).count() == 0


# -- language model ---------------------------------------------------------------


def small_vocabulary(rng):
    words = [f"w{i}".encode() for i in range(900)]
    counts = Counter(rng.choices(words, weights=[1 / (i + 1) for i in range(900)], k=20_000))
    counts[gru.END] = 100
    top = sorted(counts.items(), key=lambda k: (-k[1], k[0]))
    head = [w for w, _ in top[: gru.HEAD]]
    mass = np.zeros(gru.CLASSES)
    for w, n in top[gru.HEAD :]:
        mass[gru.tail_class(w)] += n + 0.1
    mass[gru.HEAD_CLASSES :] += 0.1
    for k in range(gru.HEAD_CLASSES):
        own = head[k * gru.CLASS_WORDS : (k + 1) * gru.CLASS_WORDS]
        mass[k] = sum(counts[w] + 0.1 for w in own) + 1e-9
    return gru.Vocabulary(sum(counts.values()), len(counts), dict(top), mass), words


@pytest.fixture(scope="module")
def language():
    rng = random.Random(5)
    vocabulary, words = small_vocabulary(rng)
    docs = [vocabulary.numbers([*rng.choices(words, k=rng.randint(0, 90)), gru.END]) for _ in range(40)]
    model = gru.Model.start(vocabulary)
    model.flat += np.random.default_rng(6).normal(0, 0.2, model.flat.shape).astype(np.float32)
    return vocabulary, docs, model


def test_gradient(language):
    vocabulary, docs, model = language
    s = gru.lay(docs[:8], vocabulary.end)
    live = s.owner[:7] >= 0

    def start():
        return np.zeros((s.inputs.shape[1], gru.HIDDEN), np.float32)

    def loss():
        logp, _ = gru.window(model, s.inputs[:7], s.targets[:7], s.fresh[:7], live, start(), None)
        return -logp[live].astype(float).sum()

    grad = gru.Model(np.zeros(gru.Model.SIZE, np.float32))
    gru.window(model, s.inputs[:7], s.targets[:7], s.fresh[:7], live, start(), grad)
    for name in gru.Model.SHAPES:
        weights, slope = getattr(model, name).reshape(-1), getattr(grad, name).reshape(-1)
        i = int(np.argmax(abs(slope)))
        kept = weights[i]
        weights[i] = kept + 0.01
        up = loss()
        weights[i] = kept - 0.01
        down = loss()
        weights[i] = kept
        assert slope[i] == pytest.approx((up - down) / 0.02, rel=0.03)


def test_scores_follow_the_whole_document(language):
    """Step by step in plain Python, whatever documents share the streams."""
    vocabulary, docs, m = language
    end = vocabulary.end
    together = gru.score_streams(m, docs, end)
    for d, numbers in enumerate(docs[:12]):
        alone = gru.score_streams(m, [numbers], end)[0]
        h, total, last = np.zeros(gru.HIDDEN), 0.0, end
        for y in numbers.tolist():
            gates = m.x[last].astype(float) + m.bx
            f = 1 / (1 + np.exp(-(gates[: gru.HIDDEN] + h @ m.uf)))
            c = np.tanh(gates[gru.HIDDEN :] + (f * h) @ m.uc)
            h = (1 - f) * h + f * c
            state = np.append(h, 1.0)
            logits = state @ m.wc
            kind = int(gru.classes_of(np.array(y)))
            total += logits[kind] - np.log(np.exp(logits).sum())
            if y < gru.HEAD:
                inner = state @ m.wi[kind]
                total += inner[y % gru.CLASS_WORDS] - np.log(np.exp(inner).sum())
            last = y
        assert together[d] == pytest.approx(total, rel=1e-3, abs=1e-3) == pytest.approx(alone, rel=1e-3, abs=1e-3)


def test_untrained_model_is_the_unigram_model(language):
    vocabulary, docs, _ = language
    m = gru.Model.start(vocabulary)
    known = dict(enumerate(vocabulary.shared))
    numbers = np.array([i for d in docs for i in d if i < gru.HEAD][:50])
    got = gru.score_streams(m, [numbers], vocabulary.end)[0]
    norm = vocabulary.class_mass.sum()
    want = sum(math.log((vocabulary.shared[known[i]] + 0.1) / norm) for i in numbers.tolist())
    assert got == pytest.approx(want, rel=1e-3)


def test_base_score_and_gain(spark):
    from tapeline.llm.queries import op8_gru

    rows = {r.doc_id: r for r in op8_gru(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    counts = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(gru.tokens(t.encode()))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs.items():
        words = gru.tokens(t.encode())
        r = rows[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_edge_cases(spark):
    docs = odd_documents(spark)
    model = gru.fit(docs)
    rows = gru.score(docs, model[0], model[1], model[2]).collect()
    assert len(rows) == len(ROWS)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 7)] == [1, 1, 1]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    nothing = gru.fit(empty_documents(spark))
    assert all(math.isfinite(r.score) for r in gru.score(docs, *nothing).collect())
    assert gru.score(empty_documents(spark), *model).count() == 0
