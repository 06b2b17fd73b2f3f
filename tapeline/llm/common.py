"""Helpers shared by the document operators.

Operators take any DataFrame, read an id and a text column and return only the columns
that they document, so further columns of the input, whatever their names, never clash.
Python work runs over Arrow batches that are cut by bytes, so that memory does not
depend on how many rows Spark puts into a batch or on the longest run of long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in its working arrays at a time; a longer single
#: text is held alone.
CHUNK_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns ``doc_id`` (as it is) and ``text`` (null becomes empty)."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(column))
        start, rows = 0, batch.num_rows
        while start < rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(rows, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's rows, starting at 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    part = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return part - part[0]


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All rows of a string column without nulls as one bytes object, with offsets."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    part = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = b"" if data is None else data.slice(int(part[0]), int(part[-1] - part[0])).to_pybytes()
    return whole, part - part[0]


def valid_text(whole: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The same texts in valid UTF-8: malformed bytes become the replacement character."""
    try:
        whole.decode("utf-8")
        # a character must not span two rows
        starts = offsets[:-1][offsets[:-1] < len(whole)]
        head = np.frombuffer(whole, np.uint8)[starts]
        if not ((head & 0xC0) == 0x80).any():
            return whole, offsets
    except UnicodeDecodeError:
        pass
    rows = [
        whole[a:b].decode("utf-8", "replace").encode("utf-8")
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
    ]
    return b"".join(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def code_points(whole: bytes) -> np.ndarray:
    return np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)


def char_starts(whole: bytes) -> np.ndarray:
    """Byte place of every code point."""
    return np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
