"""Best-fit packing of tokenised documents into sequences, as a hierarchy.

Each partition counts its documents' tokens, cuts those longer than a sequence into
pieces (the first one takes the remainder) and packs its pieces by best fit, longest
first. Bins that are full up to ``SLACK`` tokens are done. The underfull ones are items
of the next round: a shuffle deals them into groups of about ``GROUP`` items, each group
is packed by best fit again, and so on, until one group is left. A piece's place follows
from the bins it passed through. Only lengths and ids travel, never texts or tokens.

A document is its token ids by the given tokenizer without special tokens, then the id 0.
Null and empty texts are the single id 0. The file's added tokens are found in a text, as
``tokenizers`` does. Rows that repeat an id are packed each. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks, id_text, text_bytes, valid_text
from tapeline.session import materialize

LENGTH = 2048
SLACK = 16
#: Items that one task packs at a time, in a partition and in a round.
GROUP = 50_000
END_ID = (0).to_bytes(4, "little")


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenIds:
    """Ids of texts under a ``tokenizers`` file of byte-level BPE; none are put around them.

    The file's vocabulary lists tokens in the order of their merges, so its ids serve as
    merge ranks; ``tiktoken`` applies them several times faster and to the same ids (the
    tests compare both libraries).
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        added = spec.get("added_tokens", ())
        if any(t[f] for t in added for f in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: added tokens that strip, normalise or want whole words")
        special = {t["content"]: t["id"] for t in added}
        as_byte = byte_characters()
        ranks = {
            bytes(as_byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self.encoding = tiktoken.Encoding(
            os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def __call__(self, text: bytes) -> bytes:
        """Packed little-endian 32-bit ids of a valid UTF-8 text."""
        ids = self.encoding.encode_to_numpy(text.decode("utf-8"), allowed_special="all")
        return ids.astype("<u4", copy=False).tobytes()


def cut_document(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes the remainder."""
    first = n % length or length
    edges = [0, *range(first, n + 1, length)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: longest first, into the bin with the least room left.

    Bins wait by their room; a bit for each room that occurs finds the least one that
    suffices. Ties are settled by the order of the items.
    """
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, count = 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_no = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, bin_no = length, count
            count += 1
        bins[i], offsets[i] = bin_no, length - room
        left = room - size
        if left:
            waiting[left].append(bin_no)
            rooms |= 1 << left
    return bins, offsets


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path]


def local_pieces(docs: DataFrame, path: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with the bin of their partition and their offset in it."""
    src = id_text(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(path)
        base = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        used = 0

        def packed() -> pa.RecordBatch:
            nonlocal held, used
            bins, offsets = best_fit([h[3] for h in held], length)
            columns = list(zip(*held))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], src_type),
                    pa.array(columns[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[2:]),
                    pa.array(np.array(bins, np.int64) + base + used),
                    pa.array(offsets, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place"],
            )
            used += max(bins) + 1
            held = []
            return out

        src_type = None
        for batch in chunks(batches):
            src_type = batch.column("doc_id").type
            whole, ends = valid_text(*text_bytes(batch.column("text")))
            cut = ends.tolist()
            rows = [tokens(whole[a:b]) for a, b in zip(cut, cut[1:])]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), rows):
                ids += END_ID
                for piece, (start, size) in enumerate(cut_document(len(ids) // 4, length)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    held.append((doc_id, piece, start, size, crc))
            if len(held) >= GROUP:
                yield packed()
        if held:
            yield packed()

    return src.mapInArrow(
        run,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, place long",
    )


def merge_round(items: DataFrame, groups: int, number: int, length: int) -> DataFrame:
    """item, size, into, shift: best fit of underfull bins within groups dealt by a hash."""
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(groups, "grp").sortWithinPartitions("grp", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches):
            bins, offsets = best_fit(batch.column("size").to_pylist(), length)
            # a merged bin is named by its first item's bin
            items = batch.column("item").to_numpy()
            name: dict[int, int] = {}
            into = [name.setdefault(b, i) for b, i in zip(bins, items.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("size"), pa.array(into, pa.int64()), pa.array(offsets, pa.int64())],
                names=["item", "size", "into", "shift"],
            )

    return dealt.mapInArrow(run, "item long, size long, into long, shift long")


def regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each group of rows sorted by ``grp``, in parts of 4 * GROUP at most."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from table.to_batches(max_chunksize=4 * GROUP)
            held.clear()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("grp").to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:]):
            if last is not None and group[a] != last:
                yield from out()
            last = group[a]
            held.append(batch.slice(a, b - a))
    yield from out()


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = materialize(local_pieces(docs, path, length, id_col, text_col), "pieces")
    bins = pieces.groupBy(F.col("bin").alias("item")).agg(F.sum("length").alias("size"))
    items = materialize(bins.where(F.col("size") < length - SLACK), "underfull")
    moves = None  # item, root, shift: where the underfull bins have gone so far
    number, n = 0, items.count()
    while n > 1:
        groups = -(-n // group)
        step = materialize(merge_round(items, groups, number, length), "round")
        if moves is None:
            moves = step.select("item", F.col("into").alias("root"), "shift")
        else:
            after = step.select(F.col("item").alias("i"), "into", F.col("shift").alias("more"))
            moves = moves.join(after, F.col("root") == F.col("i"), "left").select(
                "item",
                F.coalesce("into", "root").alias("root"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
            moves = materialize(moves, "moves")
        if groups == 1:
            break
        merged = step.groupBy(F.col("into").alias("item")).agg(F.sum("size").alias("size"))
        items = materialize(merged.where(F.col("size") < length - SLACK), "underfull")
        before, n, number = n, items.count(), number + 1
        if n > 0.9 * before:
            # hardly anything fits: the rest meets in fewer, larger groups
            group *= 2
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moves = moves.select(F.col("item").alias("moved"), "root", "shift")
    return pieces.join(moves, F.col("bin") == F.col("moved"), "left").select(
        *columns,
        F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
