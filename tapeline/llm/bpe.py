"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation is a scan. Every code point gets a class from a table, refined by what
follows it (whether a space is the last of its run, whether an apostrophe opens a
contraction). A class acts on eight states as a function, these functions compose
associatively, and the few that arise are numbered with a composition table. So a prefix
scan over function numbers (in blocks: along the columns, then over the block totals by
doubling) gives the state before every code point, and state and class tell whether a
token slice begins there. The first code point of a text resets the state, so all texts
of a chunk are scanned as one array.

Slices are merged once and remembered; a task's memory of slices is bounded. Token ids
come with the byte offset of each token in its text, and decoding writes each token's
bytes to its offset.

Null texts count as empty and have no tokens. Malformed UTF-8 is read with the
replacement character. Very long slices are merged with a heap, in n log n. Rows keep
their order within a partition, and rows that repeat an id stay separate.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tapeline.llm.common import char_starts, chunks, code_points, id_text, text_bytes, valid_text

#: The rank of a pair that no merge joins.
NONE = 1 << 62
#: Slices that a task remembers; beyond that it starts its memory anew.
REMEMBERED = 300_000
#: Bytes of text or ids worked on at a time; the arrays about them are many times larger.
PIECE_BYTES = 250_000

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# classes after the look ahead
IN_RUN, LAST_SPACE, LAST_BLANK, SHORT, LONG = 3, 4, 5, 6, 7
CLASSES = 8
# states: what the slice that reaches here may go on with
FRESH, LETTERS, NUMBERS, OTHERS, RUN, JOINED, ONE_MORE, TWO_MORE = range(8)
STATES = 8


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """Class of every code point: letters, numbers, white space, space, all other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        table[[ord(c) for c in regex.findall(pattern, text)]] = kind
    blank = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blank] = BLANK
    table[0x20] = SPACE
    return table


def step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of a class, and whether a slice begins at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if kind == IN_RUN:
        return RUN, state != RUN
    if kind == LAST_SPACE:
        return JOINED, True
    if kind == LAST_BLANK:
        return FRESH, True
    if kind in (SHORT, LONG):
        if state in (OTHERS, JOINED):
            return OTHERS, False
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    own = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[kind]
    return own, state not in (own, JOINED)


@lru_cache(maxsize=1)
def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the generators, composition, action and slice beginnings.

    Generators are the eight classes and, at +8, the same after a reset to FRESH; number
    0 is the identity. ``compose[a, b]`` is first ``a``, then ``b``. Beginnings are by
    function, state before it and class (a reset always begins a slice).
    """
    plain = [tuple(step(s, c)[0] for s in range(STATES)) for c in range(CLASSES)]
    reset = [(f[FRESH],) * STATES for f in plain]
    identity = tuple(range(STATES))
    numbers = {identity: 0}
    queue = [identity]
    while queue:
        f = queue.pop()
        for g in plain + reset:
            h = tuple(g[x] for x in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                queue.append(h)
    functions = list(numbers)
    compose = np.array(
        [[numbers[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int32
    )
    action = np.array(functions, np.uint8)
    starts = [[step(s, c)[1] for c in range(CLASSES)] + [True] * CLASSES for s in range(STATES)]
    begins = np.array([[starts[s] for s in f] for f in functions]).ravel()
    generators = np.array([numbers[f] for f in plain + reset], np.int32)
    return generators, compose, action, begins


def refine(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scan classes of code points; ``first`` marks the first one of each text."""
    kind = point_classes()[points]
    blank = kind >= SPACE
    follows = np.empty(len(points), bool)  # a character that is no white space follows
    follows[:-1] = ~blank[1:] & ~first[1:]
    follows[-1:] = False
    out = np.where(blank, IN_RUN, kind).astype(np.uint8)
    last = blank & follows
    out[last] = np.where(kind[last] == SPACE, LAST_SPACE, LAST_BLANK)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        ends = np.concatenate((first, np.ones(2, bool)))
        one = np.where(ends[quote + 1], 0, padded[quote + 1])
        two = np.where(ends[quote + 1] | ends[quote + 2], 0, padded[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        long |= (one == ord("l")) & (two == ord("l"))
        out[quote[short]] = SHORT
        out[quote[long]] = LONG
    return out


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of code points at which a pre-token begins."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    generators, compose, action, begins = scan_tables()
    kind = refine(points, first)
    width = max(16, int(np.sqrt(n) / 8))
    rows = -(-n // width)
    flat = np.zeros(rows * width, np.uint8)
    flat[:n] = kind
    flat[:n][first] += CLASSES
    classes = np.ascontiguousarray(flat.reshape(rows, width).T)  # a column for each block
    moves = generators.take(classes)
    size = len(compose)
    table = compose.ravel()
    prefix = np.empty(moves.shape, np.int32)  # within a block, before each place
    total = np.zeros(rows, np.int32)
    for j in range(width):
        prefix[j] = total
        total *= size
        total += moves[j]
        total = table.take(total)
    # blocks: inclusive scan by doubling, then shifted by one
    reach = 1
    while reach < rows:
        total[reach:] = table.take(total[:-reach] * size + total[reach:])
        reach *= 2
    entry = np.zeros(rows, np.int32)
    entry[1:] = action[total[:-1], FRESH]
    prefix *= STATES
    prefix += entry
    prefix *= 2 * CLASSES
    prefix += classes
    return np.flatnonzero(begins.take(prefix).T.reshape(-1)[:n])


def pre_tokens(whole: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Slices of texts laid end to end, their byte starts, and the texts' slice ranges."""
    starts = char_starts(whole)
    points = code_points(whole)
    first = np.zeros(len(points), bool)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[np.searchsorted(starts, begin)] = True
    at = starts[slice_starts(points, first)]
    ends = np.append(at[1:], len(whole))
    slices = [whole[a:b] for a, b in zip(at.tolist(), ends.tolist())]
    return slices, at, np.searchsorted(at, offsets)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of lowest rank joins until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 64:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    scores = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min(scores)
        if best == NONE:
            break
        at = scores.index(best)
        joined = parts[at] + parts[at + 1]
        parts[at : at + 2] = [joined]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(joined + parts[at + 1], NONE)
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + joined, NONE)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list of parts."""
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i : after[j]])
            if rank is not None:
                heap.append((rank, i, after[j]))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = False
        after[i] = end
        if end < n:
            before[end] = i
        for left in (i, before[i]):
            if left >= 0:
                size = len(heap)
                offer(left)
                if len(heap) > size:
                    heapq.heappush(heap, heap.pop())
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Ranks, what decoding needs, and the slices remembered so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {}
        top = max(ranks.values()) + 1
        pieces = [b""] * top
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.fromiter(map(len, pieces), np.int64, top)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def ids_of(self, slices: list[bytes]) -> list[bytes]:
        """For each slice its ids as little-endian 32-bit numbers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in {*slices}.difference(known):
            known[piece] = np.array(merge(piece, self.ranks), "<u4").tobytes()
        return [known[s] for s in slices]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes at its offset."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        out = np.arange(int(offsets[-1] + lengths[-1]))
        return self.blob[out + np.repeat(self.places[ids] - offsets, lengths)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, read once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and offsets (both packed little-endian 32-bit numbers).

    ``path`` names the rank file, which every executor can read. ``offsets`` are the byte
    places of the tokens in the text.
    """
    src = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, limit=PIECE_BYTES):
            whole, ends = valid_text(*text_bytes(batch.column("text")))
            slices, _, cut = pre_tokens(whole, ends)
            packed = own.ids_of(slices)
            rows = [b"".join(packed[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            ids = np.frombuffer(b"".join(rows), "<u4")
            upto = np.cumsum(own.lengths[ids]) - own.lengths[ids]
            within = (upto - np.repeat(ends[:-1], counts)).astype("<u4").tobytes()
            edges = np.concatenate(([0], np.cumsum(counts))) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array(rows, pa.binary()),
                    pa.array([within[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "offsets"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (as ``encode`` returns it) and the column ``decoded``, the texts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, "ids", PIECE_BYTES):
            pairs = zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist())
            texts = [
                own.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64))
                for i, o in pairs
            ]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids", "offsets").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, offsets binary, decoded binary"
    )
