"""Periodic runs of words, from longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) of at least ``max(min_length, 2 * q)`` words that no neighbouring word extends.

Grid. A run of period q holds at least q places x in a row with word x = word x + q, so one
of them is a multiple of q. For every q up to half a text, neighbouring points of the grid
0, q, 2q, ... are therefore compared: how far the words from both points on agree, and how
far the words before them do. Over all q that is n ln n pairs of a text's n words, dealt in
blocks of ``PAIRS``.

Extensions. Most pairs part within ``COVER`` words and are done. Texts with a pair that
does not get an index: of all suffixes only those at places whose remainder modulo
``COVER`` is in ``SAMPLE`` are sorted (by their first words, then by doubling along steps
of ``COVER``, which lead from sampled place to sampled place). ``SAMPLE`` is a perfect
difference cover: for any two places some shift below ``COVER`` takes both into the
sample. An extension compares the few words up to there and then reads the least common
prefix between the two ranks from a sparse table. Extensions to the left use the same index
over the words in reverse.

A task holds ``CHUNK_BYTES`` of texts, or one longer text, at a time; a text of n words
takes memory in proportion to n log n. Null texts and texts without words have no run.
Rows are independent of each other: repeated rows and ids give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeline.llm.common import chunks, id_text, text_bytes

MIN_LENGTH = 12
COVER = 13
#: Every remainder but 0 is the difference of exactly one pair of these.
SAMPLE = (0, 1, 3, 9)
#: Grid pairs held at a time.
PAIRS = 1 << 19

SHIFT = np.array(
    [
        [
            next(d for d in range(COVER) if (a + d) % COVER in SAMPLE and (b + d) % COVER in SAMPLE)
            for b in range(COVER)
        ]
        for a in range(COVER)
    ]
)


def agreeing(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words from places i and j on are the same, up to ``most``, by comparing."""
    count = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(most > 0)
    t = 0
    while len(open_):
        open_ = open_[words[i[open_] + step * t] == words[j[open_] + step * t]]
        t += 1
        count[open_] = t
        open_ = open_[most[open_] > t]
    return count


class Extensions:
    """Longest common extensions to the right of any two places of ``words``.

    Words are numbers; the last ``COVER`` of them, and at least one in any two stretches
    that must not be compared across, occur once.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words) - COVER  # places that may be asked for
        places = np.flatnonzero(np.isin(np.arange(max(n, 0)) % COVER, SAMPLE))
        self.number = np.full(len(words) + COVER, -1, np.int64)
        self.number[places] = np.arange(len(places))
        ranks = self._first_ranks(places)
        levels = [ranks]
        width = COVER
        beyond = np.concatenate((places, np.full(1, len(words))))  # place of number -1
        while len(ranks) and ranks.max() + 1 < len(places):
            after = self.number[np.minimum(places + width, len(words))]
            later = np.where(after >= 0, ranks[after] + 1, 0)
            ranks = np.unique(ranks * (len(places) + 1) + later, return_inverse=True)[1]
            levels.append(ranks)
            width *= 2
        self.rank = ranks
        order = np.empty(len(places), np.int64)
        order[ranks] = np.arange(len(places))
        self.table = [self._common_prefixes(places, levels, order)]
        reach = 1
        while 2 * reach < len(order):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-reach], last[reach:]))
            reach *= 2

    def _first_ranks(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the first ``COVER`` words, as many words as fit in a number at a time."""
        if not len(places):
            return np.zeros(0, np.int64)
        low = int(self.words.min())
        bits = max(1, int(self.words.max() - low).bit_length())
        ranks, rank_bits, t = np.zeros(len(places), np.int64), 0, 0
        while t < COVER:
            fit = max(1, min((63 - rank_bits) // bits, COVER - t))
            key = ranks
            for _ in range(fit):
                key = (key << bits) | (self.words[places + t] - low)
                t += 1
            ranks = np.unique(key, return_inverse=True)[1]
            rank_bits = max(1, int(ranks.max()).bit_length())
        return ranks

    def _common_prefixes(self, places: np.ndarray, levels: list, order: np.ndarray) -> np.ndarray:
        """Common prefix of each sampled suffix and the one sorted before it (first: 0)."""
        common = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return common
        i, j = places[order[:-1]], places[order[1:]]
        found = np.zeros(len(i), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            a, b = self.number[i + found], self.number[j + found]
            same = (a >= 0) & (b >= 0) & (levels[level][a] == levels[level][b])
            found += np.where(same, COVER << level, 0)
        room = len(self.words) - np.maximum(i, j) - found
        common[1:] = found + agreeing(self.words, i + found, j + found, np.minimum(room, COVER))
        return common

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of every two places i and j (i < j)."""
        shift = SHIFT[i % COVER, j % COVER]
        found = agreeing(self.words, i, j, shift)
        on = np.flatnonzero(found == shift)
        if len(on):
            a = self.rank[self.number[i[on] + shift[on]]]
            b = self.rank[self.number[j[on] + shift[on]]]
            low, high = np.minimum(a, b) + 1, np.maximum(a, b)
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            least = np.empty(len(on), np.int64)
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                least[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k) + 1])
            found[on] += least
        return found


def grid(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of grid pairs of all texts: text, first place, period."""
    half = lengths // 2
    text = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (lengths[text] - 1) // period
    upto = np.cumsum(count)
    at = 0
    while at < len(text):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        row = np.repeat(np.arange(at, end), count[at:end])
        k = np.arange(len(row)) - np.repeat(upto[at:end] - count[at:end] - before, count[at:end])
        yield text[row], starts[text[row]] + k * period[row], period[row]
        at = end


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another between words that occur once, and where they start."""
    parts, starts, place, single = [np.array([-1], np.int64)], [], 1, -2
    for words in texts:
        starts.append(place)
        parts += [words, np.array([single], np.int64)]
        place += len(words) + 1
        single -= 1
    parts.append(np.arange(single, single - COVER, -1, dtype=np.int64))
    return np.concatenate(parts), np.array(starts, np.int64)


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Start, length and period of each text's runs by start, then period.

    Texts are arrays of non-negative word numbers.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    words, starts = joined(texts)
    found, open_texts = [], np.zeros(len(texts), bool)
    for text, i, q in grid(starts, lengths):
        at = np.flatnonzero(words[i] == words[i + q])
        text, i, q = text[at], i[at], q[at]
        most = np.full(len(i), COVER, np.int64)
        right = agreeing(words, i, i + q, most)
        left = agreeing(words, i - 1, i + q - 1, most, -1)
        beyond = (right == COVER) | (left == COVER)
        open_texts[text[beyond]] = True
        found.append(_stretches(text, i - starts[text], q, left, right, ~beyond))
    unsettled = np.flatnonzero(open_texts)
    if len(unsettled):
        found = [f[:, ~open_texts[f[0]]] for f in found]
        sub_lengths = lengths[unsettled]
        words, starts = joined([texts[t] for t in unsettled.tolist()])
        ahead = Extensions(words)
        # in reverse, place x is the last place less x, and the single words follow again
        inner = words[: len(words) - COVER]
        last = len(inner) - 1
        behind = Extensions(np.concatenate((inner[::-1], words[len(inner) :])))
        for text, i, q in grid(starts, sub_lengths):
            at = np.flatnonzero(words[i] == words[i + q])
            text, i, q = text[at], i[at], q[at]
            left = behind.of(last - (i + q - 1), last - (i - 1))
            # a stretch is read at its first grid point only
            first = np.flatnonzero(left < q)
            text, i, q, left = text[first], i[first], q[first], left[first]
            right = ahead.of(i, i + q)
            found.append(
                _stretches(unsettled[text], i - starts[text], q, left, right, np.ones(len(i), bool))
            )
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    # of the periods of one stretch the smallest counts
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    if rows.shape[1]:
        same = (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)
        rows = rows[:, np.concatenate(([True], ~same))]
    rows = rows[:, rows[2] >= np.maximum(min_length, 2 * rows[3])]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    cut = np.searchsorted(rows[0], np.arange(len(texts) + 1))
    return [rows[1:, a:b].T for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _stretches(text, place, q, left, right, settled) -> np.ndarray:
    """Text, start, length and period of stretches that hold two periods."""
    at = np.flatnonzero(settled & (left + right >= q))
    return np.stack((text[at], place[at] - left[at], left[at] + right[at] + q[at], q[at]))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period), collapsed.

    Words are what white space of ASCII separates, places count words from 0. ``collapsed``
    joins by one space the words that no run holds after its first period.
    """
    src = id_text(docs, id_col, text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            whole, offsets = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            split = [whole[a:b].split() for a, b in zip(ends[:-1], ends[1:])]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            flat = pa.array([w for words in split for w in words], pa.binary())
            ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            found = runs_of(np.split(ids, np.cumsum(counts)[:-1]), min_length)
            collapsed = []
            for words, rows in zip(split, found):
                if len(rows):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words))
            flat_runs = np.concatenate(found)
            edges = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.ListArray.from_arrays(
                        pa.array(edges),
                        pa.StructArray.from_arrays(
                            [pa.array(np.ascontiguousarray(flat_runs[:, c])) for c in range(3)],
                            fields=list(run_type),
                        ),
                    ),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>,"
        " collapsed string",
    )
