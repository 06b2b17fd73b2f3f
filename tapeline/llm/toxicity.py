"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words without marks at their ends and the starts of words (3 to 7
letters). From a sample of at most ``MAX_EXAMPLES`` labelled rows, chosen by a hash of
the id, the ``MAX_TERMS`` terms most tied to the label span the vectors; a further
coordinate stands for all other words, so that one odd word in a long text weighs little.

The examples form a block-max inverted index: postings by term, examples in blocks of
``BLOCK``, and for each term and block the largest weight. A query sums these into an
upper bound for each block, opens blocks from the highest bound and stops when no bound
reaches the k-th best cosine so far; the result equals a scan of all examples.

The ``NEIGHBOURS`` nearest examples vote with weight 1 / (distance + 0.05). Votes turn
into probabilities by an isotonic fit on the examples themselves, each scored without its
own text. Texts without any of the terms share one score, the rate among such examples.
Examples are the only labels seen; language, source and id are no inputs.

Null and empty texts get the score of texts without terms. Labels that are null are
ignored, rows of one id vote with their largest label, an empty label table gives the
score 0 to all. An empty table of documents gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks, crc_mod, id_text, text_bytes

MAX_EXAMPLES = 8_000
MAX_TERMS = 300
#: Natural log of how much likelier a term must be in examples of label 1.
MIN_ODDS = 1.5
NEIGHBOURS = 25
BLOCK = 64
#: Weight of the coordinate of all other words.
OTHER_WORDS = 0.5
THRESHOLD = 0.3
STARTS = range(3, 8)
#: Words that a task remembers; beyond that it starts its memory anew.
REMEMBERED = 300_000
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def word_terms(word: bytes) -> tuple[str, ...]:
    """The word itself (marked ``=``) and its starts (marked ``^``)."""
    w = word.decode("utf-8", "replace").lower().strip(EDGE)
    if not w or not w.isalpha():
        return ()
    return ("=" + w, *("^" + w[:n] for n in STARTS if n <= len(w)))


def select_terms(rows: list[tuple[str, int, int]], n1: int, n0: int, most: int) -> list[str]:
    """Terms most tied to the label: support times log odds; ties by the term itself."""
    scored = []
    for term, toxic, clean in rows:
        odds = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
        if odds >= MIN_ODDS:
            scored.append((-toxic * odds, term))
    return [t for _, t in sorted(scored)[:most]]


@dataclass
class Vectors:
    """Sparse rows: ``terms[i]`` and ``weights[i]`` of length 1 in the Euclidean norm."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]


class Vectoriser:
    """Text to a sparse vector over the chosen terms and the coordinate of other words."""

    def __init__(self, terms: list[str], idf: np.ndarray, rest: float):
        self.place = {t: i for i, t in enumerate(terms)}
        self.idf = idf
        self.rest = rest
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = tuple(self.place[t] for t in word_terms(word) if t in self.place)
            self.known[word] = found
        return found

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        counts: Counter[int] = Counter()
        hits = 0
        for found in filter(None, map(self.of_word, words)):
            counts.update(found)
            hits += 1
        if not counts:
            return np.empty(0, np.int64), np.empty(0)
        terms = np.array(sorted(counts), np.int64)
        tf = np.array([counts[t] for t in terms.tolist()], float)
        weight = (1 + np.log(tf)) * self.idf[terms]
        other = self.rest * math.log1p(len(words) - hits)
        terms = np.append(terms, len(self.idf))
        weight = np.append(weight, other)
        return terms, weight / np.sqrt((weight**2).sum())


class BlockMaxIndex:
    """Inverted index with the largest weight of each term in each block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int):
        # alike examples side by side make tight bounds
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
        self.order = np.array(order, np.int64)
        self.blocks = -(-len(order) // BLOCK)
        # postings: the weight of each term in each example, examples by block
        self.postings = np.zeros((width, self.blocks, BLOCK))
        for n, i in enumerate(order):
            terms, weights = vectors[i]
            self.postings[terms, n // BLOCK, n % BLOCK] = weights
        self.high = self.postings.max(axis=2)

    def top(
        self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine (ties: lower number), best first."""
        if not self.blocks or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.high[terms]
        queue = np.argsort(-bound, kind="stable")
        ids: list[np.ndarray] = []
        sims: list[np.ndarray] = []
        have, worst, i, step = 0, -1.0, 0, 4
        while i < len(queue):
            if have >= k and bound[queue[i]] < worst - 1e-9:
                break
            if bound[queue[i]] <= 0:
                break
            group = queue[i : i + step]
            opened = self.postings[np.ix_(terms, group)].reshape(len(terms), -1)
            score = weights @ opened
            hit = np.flatnonzero(score > 0)
            number = self.order[group[hit // BLOCK] * BLOCK + hit % BLOCK]
            near = np.round(score[hit], 9)
            if without >= 0:
                other = number != without
                number, near = number[other], near[other]
            ids.append(number)
            sims.append(near)
            number, near = np.concatenate(ids), np.concatenate(sims)
            best = np.lexsort((number, -near))[:k]
            ids, sims = [number[best]], [near[best]]
            have = len(best)
            worst = near[best[-1]] if have else -1.0
            i += step
            step *= 2
        return (ids[0], sims[0]) if ids else (np.empty(0, np.int64), np.empty(0))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: steps (lower end, value) of a rising fit."""
    order = np.argsort(raw, kind="stable")
    x, y = raw[order], label[order].astype(float)
    starts, sums, counts = [], [], []
    for a, b in zip(x.tolist(), y.tolist()):
        if starts and starts[-1] == a and counts[-1]:
            sums[-1] += b
            counts[-1] += 1
        else:
            starts.append(a)
            sums.append(b)
            counts.append(1)
        while len(starts) > 1 and sums[-2] * counts[-1] >= sums[-1] * counts[-2]:
            last_sum, last_count = sums.pop(), counts.pop()
            starts.pop()
            sums[-1] += last_sum
            counts[-1] += last_count
    # half a label of each kind keeps scores off 0 and 1
    value = [(s + 0.5) / (n + 1) for s, n in zip(sums, counts)]
    return np.array(starts), np.maximum.accumulate(np.array(value)) if value else np.array([])


@dataclass
class Model:
    vectoriser: Vectoriser
    index: BlockMaxIndex
    toxic: np.ndarray  # labels of the indexed examples
    ids: np.ndarray
    base: float  # rate among examples without terms
    steps: np.ndarray
    values: np.ndarray

    def votes(self, near: np.ndarray, sims: np.ndarray) -> float:
        if not len(near):
            return self.base
        weight = 1 / (1 - np.minimum(sims, 1) + 0.05)
        return float((weight * self.toxic[near]).sum() / weight.sum())

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        terms, weights = self.vectoriser(text)
        if not len(terms):
            return self.base, np.empty(0, np.int64), np.empty(0)
        near, sims = self.index.top(terms, weights, NEIGHBOURS)
        return self.calibrated(self.votes(near, sims)), near, sims

    def calibrated(self, raw: float) -> float:
        if not len(self.steps):
            return self.base
        at = max(int(np.searchsorted(self.steps, raw, side="right")) - 1, 0)
        return float(self.values[at])


def build(vectoriser: Vectoriser, examples: list[tuple[int, int, tuple]]) -> Model:
    """Index and calibration from (id, label, vector) of the examples."""
    examples = sorted(examples, key=lambda e: (e[0] is None, e[0] or 0))
    bare = [label for _, label, vector in examples if not len(vector[0])]
    full = [e for e in examples if len(e[2][0])]
    base = (sum(bare) + 0.5) / (len(bare) + 1) if bare else 0.0
    toxic = np.array([label for _, label, _ in full], float)
    vectors = [v for _, _, v in full]
    index = BlockMaxIndex(vectors, len(vectoriser.idf) + 1)
    ids = np.array([i or 0 for i, _, _ in full], np.int64)
    model = Model(vectoriser, index, toxic, ids, base, np.array([]), np.array([]))
    raw = np.array([model.votes(*index.top(*v, NEIGHBOURS, without=i)) for i, v in enumerate(vectors)])
    if len(raw):
        model.steps, model.values = isotonic(raw, toxic)
    return model


def sample_labels(labels: DataFrame, most: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``most`` labelled ids by the order of a hash: a table of bounded size."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("label_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label")
    )
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
    max_terms: int = MAX_TERMS,
) -> Model:
    """Fit on at most ``max_examples`` of the given labelled rows.

    What reaches the driver is bounded by ``max_examples`` and ``max_terms``: the chosen
    ids, the chosen terms and the examples' sparse vectors.
    """
    spark = docs.sparkSession
    chosen = sample_labels(labels, max_examples, "doc_id", label_col).collect()
    if not chosen:
        return build(Vectoriser([], np.empty(0), 0.0), [])
    table = spark.createDataFrame(
        [(r["label_id"], int(r["label"] > 0)) for r in chosen], "label_id long, label int"
    )
    texts = id_text(docs, id_col, text_col).join(
        F.broadcast(table), F.col("doc_id") == F.col("label_id")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]

        def out() -> pa.RecordBatch:
            names = list({*seen[0], *seen[1]})
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([*names, None], pa.string()),
                    pa.array([*(seen[1][t] for t in names), rows[1]], pa.int64()),
                    pa.array([*(seen[0][t] for t in names), rows[0]], pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )
            seen[0].clear()
            seen[1].clear()
            rows[:] = [0, 0]
            return batch

        for batch in chunks(batches):
            whole, offsets = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            for i, label in enumerate(batch.column("label").to_pylist()):
                words = set(whole[ends[i] : ends[i + 1]].lower().split())
                seen[label].update({t for w in words for t in word_terms(w)})
                rows[label] += 1
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out()
        yield out()

    counted = (
        texts.mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("term IS NULL OR toxic >= 3")
    )
    # the best terms by support and odds; the driver sees a bounded list
    totals = counted.where("term IS NULL").collect()
    n1, n0 = (totals[0]["toxic"], totals[0]["clean"]) if totals else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    best = (
        counted.where("term IS NOT NULL")
        .where(odds >= MIN_ODDS)
        .withColumn("tied", F.round(F.col("toxic") * odds, 6))
        .orderBy(F.desc("tied"), "term")
        .limit(max_terms)
        .collect()
    )
    terms = [r["term"] for r in best]
    total = n1 + n0
    idf = np.array([math.log((1 + total) / (1 + r["toxic"] + r["clean"])) + 1 for r in best])
    vectoriser = Vectoriser(terms, idf, OTHER_WORDS)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            whole, offsets = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            found = [vectoriser(whole[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("label").cast(pa.int32()),
                    pa.array([t for t, _ in found], pa.list_(pa.int64())),
                    pa.array([w for _, w in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "terms", "weights"],
            )

    rows = texts.mapInArrow(
        vectors, "doc_id long, label int, terms array<long>, weights array<double>"
    ).collect()
    examples = [
        (r["doc_id"], r["label"], (np.array(r["terms"], np.int64), np.array(r["weights"], float)))
        for r in rows
    ]
    return build(vectoriser, examples)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3
) -> DataFrame:
    """doc_id, score, predicted and the nearest examples (id, similarity, label)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = id_text(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in chunks(batches):
            whole, offsets = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            scores, shown = [], []
            for a, b in zip(ends, ends[1:]):
                value, near, sims = m.score(whole[a:b])
                scores.append(value)
                shown.append(
                    [
                        {"example_id": int(m.ids[n]), "similarity": float(s), "label": int(m.toxic[n])}
                        for n, s in zip(near[:evidence].tolist(), sims[:evidence].tolist())
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array(
                        shown,
                        pa.list_(
                            pa.struct(
                                [("example_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]
                            )
                        ),
                    ),
                ],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return src.mapInArrow(
        run,
        f"doc_id {kind}, score double, predicted int,"
        " evidence array<struct<example_id: long, similarity: double, label: int>>",
    )


def drop_toxic(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a score below ``THRESHOLD``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            texts = batch.column(column).fill_null("")
            keep = [m.score(t.as_buffer().to_pybytes() if t.as_buffer() else b"")[0] < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_labels(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(crc_mod(F.col("doc_id"), 4) != 2)
