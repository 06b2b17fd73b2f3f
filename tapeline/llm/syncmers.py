"""Document fingerprints from closed syncmers.

A window of ``k`` code points is a closed syncmer if the smallest hash among its inner
windows of ``s`` code points stands at its first or last place. Whether a window is
chosen depends on its own characters alone, so an edit moves no anchor elsewhere; the
anchors of an unchanged passage are found again at shifted positions.

The fingerprint of a text lists the ``SKETCH`` smallest distinct anchor hashes (8 hex
digits each) in the order of their first position. The likeness of two fingerprints is
the share of the smallest hashes of their union which stand in both *in the same
order*: an estimate of the Jaccard similarity of the anchor sets that only counts
collinear matches.

Empty and null texts have an empty fingerprint; two empty ones are alike (1), an empty
and another text are not (0). A text shorter than ``k`` has itself as its only anchor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks, code_points, id_text, mix64, text_bytes, valid_text

K, S = 12, 5
SKETCH = 128
#: Ranges of ids for each shuffle partition when neighbours are sought.
RANGES_PER_PARTITION = 4


def anchors(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of texts laid end to end."""
    n = len(points)
    if n < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = points.astype(np.uint64) + np.uint64(1)
    rolled = x[: n - S + 1].copy()
    for j in range(1, S):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += x[j : n - S + 1 + j]
    h = mix64(rolled)
    width, low, reach = K - S + 1, h, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        gap = width - reach
        low = np.minimum(low[:-gap], low[gap:])
    windows = n - K + 1
    chosen = (h[:windows] == low) | (h[K - S : K - S + windows] == low)
    ends = np.repeat(np.cumsum(lengths), lengths)
    chosen &= np.arange(windows) + K <= ends[:windows]
    at = np.flatnonzero(chosen)
    whole = h[at]
    covered = S
    while covered < K:
        step = min(covered, K - S)
        whole = mix64(whole * np.uint64(0xD6E8FEB86659FD93) + h[at + step])
        covered = step + S
        if step == K - S:
            break
    return at, whole >> np.uint64(32)


def fingerprints(texts: list[str]) -> list[tuple[int, ...]]:
    """For each text the smallest distinct anchor hashes in order of position."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at, h = anchors(points, lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    doc = np.searchsorted(starts, at, side="right") - 1
    key = (doc.astype(np.uint64) << np.uint64(32)) | h
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    order, key = order[first], key[first]
    docs = (key >> np.uint64(32)).astype(np.int64)
    begin = np.searchsorted(docs, np.arange(len(texts)))
    rank = np.arange(len(key)) - begin[docs]
    kept = np.sort(order[rank < SKETCH])  # back to the order of positions
    owner, value = doc[kept], h[kept].astype(np.int64)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    value = value.tolist()
    out = []
    for i, text in enumerate(texts):
        if text and cut[i] == cut[i + 1]:  # no anchor
            out.append((xxhash.xxh32_intdigest(text.encode("utf-8")),))
        else:
            out.append(tuple(value[cut[i] : cut[i + 1]]))
    return out


def likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Share of the smallest hashes of the union that both have in the same order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    place = {h: i for i, h in enumerate(b)}
    union = sorted({*a, *b})[:SKETCH]
    last = union[-1]
    tails: list[int] = []
    for h in a:
        if h <= last and (i := place.get(h)) is not None:
            spot = bisect_left(tails, i)
            tails[spot : spot + 1] = [i]
    return len(tails) / len(union)


def to_hex(fingerprint: tuple[int, ...]) -> str:
    return np.array(fingerprint, ">u4").tobytes().hex()


def from_hex(fingerprint: str) -> tuple[int, ...]:
    return tuple(np.frombuffer(bytes.fromhex(fingerprint), ">u4").tolist())


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All anchors of every text: doc_id, position (code points, from 0), hash (32 bits).

    Texts shorter than ``K`` have one anchor at 0, empty ones none. Equal passages of two
    documents have equal hashes at one common shift, so a join on ``hash`` that groups by
    the difference of positions finds aligned passages.
    """
    src = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            whole, offsets = valid_text(*text_bytes(batch.column("text")))
            texts = [whole[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            at, h = anchors(code_points(whole), lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            doc = np.searchsorted(starts, at, side="right") - 1
            short = np.flatnonzero((lengths > 0) & (lengths < K))
            own = [xxhash.xxh32_intdigest(texts[i].encode()) for i in short]
            rows = np.concatenate((doc, short))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(np.concatenate((at - starts[doc], np.zeros(len(short), np.int64)))),
                    pa.array(np.concatenate((h.astype(np.int64), np.array(own, np.int64)))),
                ],
                names=["doc_id", "position", "hash"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, position long, hash long")


def with_next(src: DataFrame) -> tuple[DataFrame, int]:
    """Rows in ascending (doc_id, text hash), each range closed by the row after it.

    Ids are cut into ranges at quantiles (a bounded list on the driver), one shuffle
    brings each range together in order, and the first row of a range is also dealt to
    the range before it, the first of all to the last. Ranges are a function of the id,
    so they stay the same when a lost task runs again.
    """
    spark = src.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = max(4, RANGES_PER_PARTITION * parts)
    ids = src.select("doc_id")
    steps = [i / n_ranges for i in range(1, n_ranges)]
    bounds = sorted(set(ids.approxQuantile("doc_id", steps, 0.25 / n_ranges)))
    edges = np.array(bounds, np.float64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        values = doc_id.fillna(-np.inf).to_numpy(np.float64)
        return pd.Series(np.searchsorted(edges, values, side="right").astype("int32"))

    rows = src.withColumns(
        {"tie": F.xxhash64("text"), "part": range_of("doc_id"), "tail": F.lit(0)}
    )
    heads = (
        rows.groupBy("part")
        .agg(F.min(F.struct("doc_id", "tie")).alias("head"))
        .orderBy("part")
        .collect()  # one row for each range
    )
    if not heads:
        return rows, parts
    previous = [h["part"] for h in heads[-1:] + heads[:-1]]
    links = spark.createDataFrame(
        [(h["head"]["doc_id"], h["head"]["tie"], before) for h, before in zip(heads, previous)],
        "next_id long, next_tie long, before int",
    )
    tails = (
        rows.drop("part", "tail")
        .join(
            F.broadcast(links),
            F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie")),
        )
        .select("doc_id", "text", "tie", F.col("before").alias("part"), F.lit(1).alias("tail"))
    )
    return rows.unionByName(tails), parts


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document has the next higher (doc_id, hash of its text); a null
    id comes first, and rows that repeat an id follow each other. A single document is
    its own next one. An empty table gives an empty result.
    """
    src = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, parts = with_next(src)
    dealt = rows.repartitionByRange(max(parts, 1), "part").sortWithinPartitions(
        "part", "tail", F.col("doc_id").asc_nulls_first(), "tie"
    )

    def finish(pending: list[tuple], closing: tuple | None) -> pa.RecordBatch:
        texts = [t for _, t in pending]
        after = texts[1:] + ([closing[1]] if closing else [])
        own = fingerprints(texts + after[-1:])
        edited = [edit(a, b) for a, b in zip(texts, after)]
        changed = fingerprints(edited)
        n = len(after)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in pending[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
                pa.array(list(map(to_hex, own[:n])), pa.string()),
                pa.array(list(map(to_hex, changed)), pa.string()),
                pa.array(list(map(likeness, own[:n], changed)), pa.float64()),
                pa.array(list(map(likeness, own[:n], own[1 : n + 1])), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        closed = None  # the range whose closing row was seen
        size = 0
        for batch in chunks(batches):
            whole, offsets = valid_text(*text_bytes(batch.column("text")))
            ends = offsets.tolist()
            ids = batch.column("doc_id").to_pylist()
            part, tail = batch.column("part").to_pylist(), batch.column("tail").to_pylist()
            for i, doc_id in enumerate(ids):
                if tail[i] and closed == part[i]:
                    continue  # a repeated closing row
                row = (doc_id, whole[ends[i] : ends[i + 1]].decode())
                if tail[i]:
                    closed = part[i]
                    if pending:
                        yield finish(pending, row)
                    pending, size = [], 0
                    continue
                pending.append(row)
                size += ends[i + 1] - ends[i]
                if size > 1_000_000 and len(pending) > 1:
                    yield finish(pending, None)
                    pending, size = pending[-1:], len(pending[-1][1])
        assert not pending, "every range ends with the row that follows it"

    return dealt.select("doc_id", "text", "part", "tail").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )
