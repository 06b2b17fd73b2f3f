"""Log-probability of whole documents under a gated recurrent language model.

Tokens are lower-cased words and one end per document. Word counts over all training
documents come from one aggregation. The ``HEAD`` most frequent words fill classes of
``CLASS_WORDS`` words by frequency; all others fall into ``TAIL`` classes by how they
end. The model factors p(word | past) = p(class | state) * p(word | class, state): a
softmax over classes and, in a head class, a softmax over its words. In a tail class a
word has its share (c + 0.1) of the class's mass, and one further share of 0.1 stands for
all unseen words, so probabilities sum to one over the vocabulary and an unseen word.

The state is that of a minimal gated unit (one gate, which forgets and updates). It
starts at zero with each document, and is carried across windows of ``WINDOW`` steps;
back-propagation stops at a window's start. Documents are laid on parallel streams,
longest first on the shortest stream, and all streams step together in numpy.

Training covers every training document once, in ``ROUNDS`` rounds that each take a part
of them by a hash of the id. In a round each partition trains a copy from the shared
weights, and the copies are averaged by their number of tokens, first in ``SLOTS`` groups
by a shuffle, then on the driver. Biases start at the log of the counts' shares, so the
untrained model is the unigram model and training can only add to it.

Counts of the ``SHARED`` most frequent words are broadcast (a bounded list); rarer words
meet their counts in a join of (document, word) rows, which also gives the base score.

Null texts count as empty: they have the end only. Rows that repeat an id are scored
each. Without training documents every probability comes from the 0.1 shares. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks, text_bytes, valid_text
from tapeline.session import materialize

HEAD, CLASS_WORDS, TAIL = 512, 32, 32
HEAD_CLASSES = HEAD // CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL
SHARED = 65_536
HIDDEN = 16
WINDOW = 32
STREAMS = 512
#: Streams that are always laid if there are as many documents.
NARROW = 32
RATE = 0.01
ROUNDS = 2
SLOTS = 16
#: Tokens that a task lays on its streams at a time.
BATCH_TOKENS = 2_000_000
#: Words beyond the shared ones that a task remembers.
REMEMBERED = 250_000
#: Tokens of a training document that follow each other on a stream; a longer document is
#: cut, so that streams stay of a length. Scoring never cuts.
PIECE = 1024
#: The end token; no word holds a space.
END = b" "
#: Steps whose outputs are worked on at a time, so that they stay in the cache.
OUTPUT_ROWS = 8192
ONES = np.ones(max(CLASSES, CLASS_WORDS), np.float32)


def tail_class(word: bytes) -> int:
    """Class of a word by its last three bytes."""
    return HEAD_CLASSES + int.from_bytes(word[-3:], "big") % TAIL


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


class Places(dict):
    """Place of a word among the shared ones; for another, their number + tail class.

    Other words are remembered up to a bound.
    """

    def __init__(self, shared: list[bytes]):
        super().__init__(zip(shared, range(len(shared))))
        self.shared = len(shared)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.shared + tail_class(word) - HEAD_CLASSES
        return place

    def __reduce__(self):
        return Places, (sorted((w for w, i in self.items() if i < self.shared), key=self.get),)


@dataclass
class Vocabulary:
    """What every task knows of the counts: bounded in size, whatever the corpus.

    ``shared`` lists the most frequent words with their counts, the first ``HEAD`` of
    them being those that have a softmax of their own; the end token is among these.
    """

    total: int  # N
    types: int  # V
    shared: dict[bytes, int]
    class_mass: np.ndarray
    places: Places = field(init=False)

    def __post_init__(self):
        words = list(self.shared)
        self.places = Places(words)
        counts = np.array([*self.shared.values(), *[0] * TAIL], float)
        rare = np.arange(len(words)) >= HEAD
        kinds = [tail_class(w) - HEAD_CLASSES for w in words[HEAD:]]
        # input number of each place: a head word's own, or HEAD + tail class
        self.number = np.array([*range(min(HEAD, len(words))), *(HEAD + k for k in kinds), *range(HEAD, HEAD + TAIL)], np.int32)
        self.is_shared = np.arange(len(counts)) < len(words)
        self.known = self.is_shared & (counts > 0)
        self.log_count = np.where(self.is_shared, np.log10(counts + 0.1), 0.0)
        self.log_rare = np.where(np.append(rare, [False] * TAIL), self.log_count, 0.0)

    @property
    def end(self) -> int:
        return int(self.number[self.places[END]])

    def places_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) > len(self.shared) + REMEMBERED:
            self.places = Places(list(self.shared))
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.number[self.places_of(words)]


class Model:
    """Weights in one flat array, with views by name."""

    SHAPES = {
        "x": (HEAD + TAIL, 2 * HIDDEN),
        "uf": (HIDDEN, HIDDEN),
        "uc": (HIDDEN, HIDDEN),
        "bx": (2 * HIDDEN,),
        # the last row of output weights is the bias
        "wc": (HIDDEN + 1, CLASSES),
        "wi": (HEAD_CLASSES, HIDDEN + 1, CLASS_WORDS),
    }
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        rng = np.random.default_rng(7)
        model = cls(np.zeros(cls.SIZE, np.float32))
        model.x[:] = rng.normal(0, 0.3, model.x.shape)
        model.uf[:] = rng.normal(0, 0.1, model.uf.shape)
        model.uc[:] = rng.normal(0, 0.3, model.uc.shape)
        model.bx[:HIDDEN] = -1.0  # mostly remember
        counts = np.zeros(HEAD)
        first = list(vocabulary.shared.values())[:HEAD]
        counts[: len(first)] = first
        shares = (counts + 0.1).reshape(HEAD_CLASSES, CLASS_WORDS)
        model.wi[:, HIDDEN] = np.log(shares / shares.sum(axis=1, keepdims=True))
        mass = vocabulary.class_mass
        model.wc[HIDDEN] = np.log(mass / mass.sum())
        return model


@dataclass
class Streams:
    """Documents laid end to end on parallel streams; longer streams first."""

    inputs: np.ndarray  # (steps, streams)
    targets: np.ndarray
    fresh: np.ndarray  # 1 where a document goes on, 0 at its first step
    owner: np.ndarray  # document of each step, -1: none
    active: np.ndarray  # streams in use at each step


def lay(docs: list[np.ndarray], end: int) -> Streams:
    """Longest document first, each on the stream that is shortest so far.

    There are no more streams than keep a length, so that one long document among short
    ones does not make the arrays many times longer than their tokens.
    """
    total, longest = sum(map(len, docs)), max(map(len, docs))
    width = max(1, min(STREAMS, len(docs), max(NARROW, -(-total // longest))))
    heap = [(0, i) for i in range(width)]
    placed: list[list[int]] = [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        length, s = heapq.heappop(heap)
        placed[s].append(d)
        heapq.heappush(heap, (length + len(docs[d]), s))
    lengths = [sum(len(docs[d]) for d in p) for p in placed]
    order = sorted(range(width), key=lambda s: -lengths[s])
    steps = max(lengths)
    shape = (steps, width)
    inputs, targets = np.full(shape, end, np.int16), np.full(shape, end, np.int16)
    fresh, owner = np.ones(shape, np.float32), np.full(shape, -1, np.int32)
    for column, s in enumerate(order):
        at = 0
        for d in placed[s]:
            n = len(docs[d])
            targets[at : at + n, column] = docs[d]
            inputs[at + 1 : at + n, column] = docs[d][:-1]
            fresh[at, column] = 0
            owner[at : at + n, column] = d
            at += n
    used = np.array([lengths[s] for s in order])
    active = (used[None, :] > np.arange(0, steps, WINDOW)[:, None]).sum(axis=1)
    return Streams(inputs, targets, fresh, owner, active)


def classes_of(targets: np.ndarray) -> np.ndarray:
    """Class of input numbers."""
    return np.where(targets < HEAD, targets // CLASS_WORDS, targets - HEAD + HEAD_CLASSES)


def _outputs(
    h: np.ndarray, target: np.ndarray, weight: np.ndarray, m: Model, grad: Model | None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of targets under states ``h`` (last column 1: the bias).

    Logits start at log shares and states stay within (-1, 1), so exponentials need no
    shift. With ``grad``, gradients are added to it and those of the states returned.
    """
    kind = classes_of(target)
    rows = np.arange(len(target))
    e = h @ m.wc
    logp = e[rows, kind]
    np.exp(e, out=e)
    sums = e @ ONES[:CLASSES]
    logp -= np.log(sums)
    d_h = None
    if grad is not None:
        e *= (weight / sums)[:, None]
        e[rows, kind] -= weight
        grad.wc += h.T @ e
        d_h = e @ m.wc.T
    in_head = np.flatnonzero((target < HEAD) & (weight > 0))
    by_class = in_head[np.argsort(kind[in_head].astype(np.uint8), kind="stable")]
    cut = np.searchsorted(kind[by_class], np.arange(HEAD_CLASSES + 1)).tolist()
    place_all = target[by_class] % CLASS_WORDS
    h_all = h[by_class]
    for k in range(HEAD_CLASSES):
        a, b = cut[k], cut[k + 1]
        if a == b:
            continue
        own, hk, spot, place = by_class[a:b], h_all[a:b], rows[: b - a], place_all[a:b]
        e = hk @ m.wi[k]
        logp[own] += e[spot, place]
        np.exp(e, out=e)
        s = e @ ONES[:CLASS_WORDS]
        logp[own] -= np.log(s)
        if grad is not None:
            e /= s[:, None]
            e[spot, place] -= 1
            grad.wi[k] += hk.T @ e
            d_h[own] += e @ m.wi[k].T
    return logp, d_h


def window(
    m: Model, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray, grad: Model | None
) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probabilities of ``y`` (steps, streams) and the state after the window.

    With ``grad``, the gradients of their negative sum over live steps are added to it.
    """
    steps, width = x.shape
    f_gates = (m.x[:, :HIDDEN] + m.bx[:HIDDEN])[x]
    c_gates = (m.x[:, HIDDEN:] + m.bx[HIDDEN:])[x]
    past = np.empty((steps, width, HIDDEN), np.float32)
    f_all, c_all, h_all = f_gates, c_gates, np.ones((steps, width, HIDDEN + 1), np.float32)
    half = m.uf * np.float32(0.5)
    f_gates *= np.float32(0.5)
    for t in range(steps):
        p = np.multiply(h, fresh[t, :, None], out=past[t])
        # the logistic function by tanh
        f = f_gates[t]
        f += p @ half
        np.tanh(f, out=f)
        f += np.float32(1)
        f *= np.float32(0.5)
        c = c_gates[t]
        c += (f * p) @ m.uc
        np.tanh(c, out=c)
        h = c - p
        h *= f
        h += p
        h_all[t, :, :HIDDEN] = h
    flat_h = h_all.reshape(-1, HIDDEN + 1)
    target, weight = y.ravel(), live.ravel().astype(np.float32)
    logp = np.empty(len(target), np.float32)
    d_all = None if grad is None else np.empty_like(flat_h)
    for a in range(0, len(target), OUTPUT_ROWS):
        part = slice(a, a + OUTPUT_ROWS)
        logp[part], d_part = _outputs(flat_h[part], target[part], weight[part], m, grad)
        if grad is not None:
            d_all[part] = d_part
    logp = logp.reshape(steps, width)
    if grad is None:
        return logp, h
    d_h = np.ascontiguousarray(d_all[:, :HIDDEN]).reshape(steps, width, HIDDEN)
    d_gates = np.empty((steps, width, 2 * HIDDEN), np.float32)
    later = np.zeros((width, HIDDEN), np.float32)
    back_c, back_f = np.ascontiguousarray(m.uc.T), np.ascontiguousarray(m.uf.T)
    for t in range(steps - 1, -1, -1):
        f, c, p, dh = f_all[t], c_all[t], past[t], d_h[t]
        dh += later
        dc = dh * f
        dc *= 1 - c * c
        through = dc @ back_c
        df = c - p
        df *= dh
        df += through * p
        df *= f
        stay = 1 - f
        df *= stay
        d_gates[t, :, :HIDDEN] = df
        d_gates[t, :, HIDDEN:] = dc
        stay *= dh
        through *= f
        stay += through
        stay += df @ back_f
        later = np.multiply(stay, fresh[t, :, None], out=stay)
    flat_p, flat_d = past.reshape(-1, HIDDEN), d_gates.reshape(-1, 2 * HIDDEN)
    grad.uf += flat_p.T @ flat_d[:, :HIDDEN]
    grad.uc += (f_all.reshape(-1, HIDDEN) * flat_p).T @ flat_d[:, HIDDEN:]
    grad.bx += flat_d.sum(axis=0)
    source = x.ravel()
    order = np.argsort(source, kind="stable")
    source = source[order]
    lead = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
    grad.x[source[lead]] += np.add.reduceat(flat_d[order], lead, axis=0)
    return logp, h


def train_streams(m: Model, docs: list[np.ndarray], end: int, adam: dict) -> int:
    """One pass of truncated back-propagation over documents; returns the tokens seen."""
    s = lay(docs, end)
    h = np.zeros((s.inputs.shape[1], HIDDEN), np.float32)
    grad = Model(np.zeros(Model.SIZE, np.float32))
    seen = 0
    for i, active in enumerate(s.active.tolist()):
        part = slice(i * WINDOW, (i + 1) * WINDOW)
        live = s.owner[part, :active] >= 0
        grad.flat[:] = 0
        _, h = window(m, s.inputs[part, :active], s.targets[part, :active], s.fresh[part, :active], live, h[:active], grad)
        n = int(live.sum())
        seen += n
        g = grad.flat / max(n, 1)
        adam["t"] += 1
        adam["m"] += 0.1 * (g - adam["m"])
        adam["v"] += 0.01 * (g * g - adam["v"])
        first = adam["m"] / (1 - 0.9 ** adam["t"])
        second = np.sqrt(adam["v"] / (1 - 0.99 ** adam["t"]))
        # few tokens make small steps, so that a lone stream's end does not undo the rest
        m.flat -= RATE * min(1.0, n / (WINDOW * 32)) * first / (second + 1e-6)
    return seen


def score_streams(m: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each document's token numbers."""
    s = lay(docs, end)
    h = np.zeros((s.inputs.shape[1], HIDDEN), np.float32)
    total = np.zeros(len(docs))
    i = 0
    while i < len(s.active):
        # few streams step further at a time; the state goes on in any case
        active = int(s.active[i])
        ahead = max(1, min(STREAMS // (2 * active), 64))
        part = slice(i * WINDOW, (i + ahead) * WINDOW)
        owner = s.owner[part, :active]
        live = owner >= 0
        logp, h = window(m, s.inputs[part, :active], s.targets[part, :active], s.fresh[part, :active], live, h[:active], None)
        total += np.bincount(owner[live], weights=logp[live], minlength=len(docs))
        i += ahead
    return total


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")
    )


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and c over all given documents; the end token is the word of one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in chunks(batches):
            whole, ends = valid_text(*text_bytes(batch.column("text")))
            cut = ends.tolist()
            for a, b in zip(cut, cut[1:]):
                seen.update(whole[a:b].lower().split())
            seen[END] += batch.num_rows
            if len(seen) > 400_000:
                yield out()
        if seen:
            yield out()

    src = _texts(docs, id_col, text_col).select("text")
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, class masses and the most frequent words: what the driver gathers is bounded."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # words by narrow steps of their counts: the driver gets few more rows than it keeps
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, words = 0, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        least, words = row["step"], words + row["n"]
        if words >= SHARED:
            break
    frequent = counts.where(step >= least)
    top = frequent.orderBy(F.desc("c"), "word").limit(SHARED).collect()
    found = {r["word"].encode("utf-8"): int(r["c"]) for r in top}
    order = list(found)
    if END not in order[:HEAD]:
        # the end token always has a place in the head
        order = [w for w in order if w != END]
        order.insert(HEAD - 1, END)
    shared = {w: found.get(w, 0) for w in order}
    head = order[:HEAD]
    in_head = set(head)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(CLASSES)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                w = word.encode("utf-8")
                if w not in in_head:
                    mass[tail_class(w)] += c + 0.1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(mass)], names=["k", "mass"]
        )

    rows = counts.mapInArrow(masses, "k int, mass double").groupBy("k").agg(F.sum("mass").alias("mass"))
    mass = np.zeros(CLASSES)
    for r in rows.collect():
        mass[r["k"]] = r["mass"]
    mass[HEAD_CLASSES:] += 0.1  # unseen words
    for i in range(HEAD_CLASSES):
        own = head[i * CLASS_WORDS : (i + 1) * CLASS_WORDS]
        mass[i] = sum(shared[w] + 0.1 for w in own) + 1e-9
    return Vocabulary(int(totals["n"] or 0), int(totals["v"] or 0), shared, mass)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Chunks of rows with the tokens of each."""
    for batch in chunks(batches):
        whole, ends = valid_text(*text_bytes(batch.column("text")))
        cut = ends.tolist()
        yield batch, [tokens(whole[a:b]) for a, b in zip(cut, cut[1:])]


def pieces(numbers: np.ndarray) -> list[np.ndarray]:
    """A training document in pieces of at most ``PIECE`` tokens."""
    return [numbers[a : a + PIECE] for a in range(0, len(numbers), PIECE)]


def train(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weights after ``ROUNDS`` rounds of parallel training and averaging."""
    spark = docs.sparkSession
    model = Model.start(vocabulary)
    words = spark.sparkContext.broadcast(vocabulary)
    end = vocabulary.end
    src = _texts(docs, id_col, text_col)
    turn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(ROUNDS))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Model(shared.value.copy())
            adam = {"t": 0, "m": np.zeros_like(m.flat), "v": np.zeros_like(m.flat)}
            seen, held, n = 0, [], 0
            for _, lists in _documents(batches):
                for w in lists:
                    held += pieces(words.value.numbers(w))
                    n += len(w)
                if n >= BATCH_TOKENS:
                    seen += train_streams(m, held, end, adam)
                    held, n = [], 0
            if held:
                seen += train_streams(m, held, end, adam)
            if seen:
                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([seen]), pa.array([m.flat.tobytes()], pa.binary())],
                    names=["slot", "seen", "weights"],
                )

        copies = src.where(turn == r).select("text").mapInArrow(run, "slot int, seen long, weights binary")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    s = sums.setdefault(row["slot"], [0, np.zeros(Model.SIZE)])
                    s[0] += row["seen"]
                    s[1] += row["seen"] * np.frombuffer(row["weights"], np.float32).astype(float)
            for slot, (n, total) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())],
                    names=["slot", "seen", "weights"],
                )

        parts = copies.repartition(SLOTS, "slot").mapInArrow(add, copies.schema).collect()
        if parts:
            n = sum(p["seen"] for p in parts)
            mean = sum(p["seen"] / n * np.frombuffer(p["weights"], np.float32).astype(float) for p in parts)
            model = Model(mean.astype(np.float32))
    return model


def score(
    docs: DataFrame,
    vocabulary: Vocabulary,
    counts: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every whole text."""
    sc = docs.sparkSession.sparkContext
    known, weights = sc.broadcast(vocabulary), sc.broadcast(model.flat)
    end = vocabulary.end
    src = _texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    info = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = known.value, Model(weights.value.copy())
        share = np.append(np.zeros(HEAD), np.log10(v.class_mass[HEAD_CLASSES:]))
        n_shared = len(v.shared)

        def finish(docs: list[tuple], numbers: list[np.ndarray]) -> pa.RecordBatch:
            lm = score_streams(m, numbers, end) / math.log(10)
            ids, keys, words, times, notes = [], [], [], [], []
            for d, (doc_id, key, note, rest) in enumerate(docs):
                note["lm"] += float(lm[d])
                # a word of its own keeps this row apart from all words
                ids += [doc_id] * (len(rest) + 1)
                keys += [key] * (len(rest) + 1)
                words.append(f" {key}".encode())
                words += rest
                times.append(0)
                times += rest.values()
                notes.append(note)
                notes += [None] * len(rest)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(keys, pa.int64()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(times, pa.int32()),
                    pa.array(notes, info),
                ],
                names=["doc_id", "text_key", "word", "times", "info"],
            )

        docs, numbers, n = [], [], 0
        for batch, lists in _documents(batches):
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            starts = np.cumsum(lengths) - lengths
            flat = [w for own in lists for w in own]
            places = v.places_of(flat)
            number = v.number[places]
            base = np.add.reduceat(v.log_count[places], starts)
            local = np.add.reduceat(v.log_rare[places] - share[number], starts)
            known_here = np.add.reduceat(v.known[places].astype(np.int64), starts)
            rest: list[Counter[bytes]] = [Counter() for _ in lists]
            rare = np.flatnonzero(places >= n_shared)
            for d, i in zip((np.searchsorted(starts, rare, side="right") - 1).tolist(), rare.tolist()):
                rest[d][flat[i]] += 1
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist())
            for d, (doc_id, key) in enumerate(rows):
                note = {
                    "n_tokens": int(lengths[d]),
                    "n_known": int(known_here[d]),
                    "base": float(base[d]),
                    "lm": float(local[d]),
                }
                docs.append((doc_id, key, note, rest[d]))
            numbers += np.split(number, starts[1:])
            n += len(flat)
            if n >= BATCH_TOKENS:
                yield finish(docs, numbers)
                docs, numbers, n = [], [], 0
        if docs:
            yield finish(docs, numbers)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    rows = src.mapInArrow(
        run,
        f"doc_id {kind}, text_key long, word string, times int,"
        " info struct<n_tokens: long, n_known: long, base: double, lm: double>",
    )
    c = counts.select(F.col("word").alias("counted"), "c")
    joined = rows.join(c, F.col("word") == F.col("counted"), "left")
    rare = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    norm = math.log10(vocabulary.total + 0.1 * (vocabulary.types + 1))

    def add(column: Column) -> Column:
        return F.sum(F.coalesce(column, F.lit(0)))

    summed = joined.groupBy("doc_id", "text_key").agg(
        F.count("info").alias("copies"),
        add(F.col("info.n_tokens")).alias("n_tokens"),
        (add(F.col("info.n_known")) + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (add(F.col("info.base")) + F.sum(rare)).alias("base"),
        (add(F.col("info.lm")) + F.sum(rare)).alias("lm"),
    )
    # equal rows of one id were summed together
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    each = summed.select("*", copies)
    n = F.col("copies")
    return each.select(
        "doc_id",
        (F.col("n_tokens") / n).cast("long").alias("n_tokens"),
        (F.col("n_known") / n).cast("long").alias("n_known"),
        (F.col("base") / n - F.col("n_tokens") / n * norm).alias("base_score"),
        (F.col("lm") / n).alias("score"),
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, DataFrame, Model]:
    """Vocabulary, table of counts and weights from the given training documents."""
    counts = materialize(count_words(docs, id_col, text_col), "counts")
    vocabulary = learn_vocabulary(counts)
    return vocabulary, counts, train(docs, vocabulary, id_col, text_col)
