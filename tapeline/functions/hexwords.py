"""256-bit words of hex payloads.

Addresses and hashes are cut out as text. Numbers are read from all payloads of an Arrow
batch at once: the digits of a word become four big-endian limbs of 64 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
LIMB = float(2**64)
# The least number that DECIMAL(38,0) cannot hold, as two limbs.
_TOO_WIDE = (np.uint64(10**38 >> 64), np.uint64(10**38 & (2**64 - 1)))
# The value of an ASCII hex digit; 255 for other bytes.
_DIGITS = np.full(256, 255, np.uint8)
for _at, _digit in enumerate("0123456789abcdef"):
    _DIGITS[[ord(_digit), ord(_digit.upper())]] = _at
_TYPES = {"unsigned": "double", "signed": "double", "exact": "decimal(38,0)", "fits": "boolean"}


def strip_0x(text: Column) -> Column:
    return F.when(text.startswith("0x"), F.right(text, F.length(text) - 2)).otherwise(text)


def word(data: Column, index: int) -> Column:
    """The index-th word of a payload without ``0x``."""
    return F.substring(data, 1 + index * WORD, WORD)


def byte_length(data: Column) -> Column:
    return F.floor(F.length(data) / 2).cast("int")


def numbers(data: Column, kinds: Sequence[str]) -> Column:
    """The first words of a hex payload, with or without ``0x``, as a struct of numbers
    ``w0``, ``w1``, ...

    A kind is ``unsigned`` or ``signed`` (a double), ``exact`` (DECIMAL(38,0); null from
    10^38 on) or ``fits`` (whether ``exact`` holds it). Words that the payload does not
    hold whole, or that are not hex, are null.
    """
    import pyarrow as pa

    kinds = tuple(kinds)

    def read(column: pa.Array) -> pa.Array:
        wide = pa.types.is_large_string(column.type)
        _, raw, body = column.buffers()
        offsets = np.frombuffer(raw, np.int64 if wide else np.int32)
        offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        start, size = offsets[:-1], np.diff(offsets)
        if column.null_count:
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
        some = size >= 2
        prefixed = np.zeros(len(column), bool)
        prefixed[some] = (body[start[some]] == ord("0")) & (body[start[some] + 1] == ord("x"))
        start, size = start + 2 * prefixed, size - 2 * prefixed
        fields = []
        for i, kind in enumerate(kinds):
            there = size >= WORD * (i + 1)
            limbs = np.zeros((len(column), 4), np.uint64)
            digits = _DIGITS[body[(start[there] + WORD * i)[:, None] + np.arange(WORD)]]
            limbs[there] = (digits[:, 0::2] << 4 | digits[:, 1::2] & 15).view(">u8")
            there[there] = (digits < 16).all(axis=1)
            fields.append(_as_array(limbs, ~there, kind))
        return pa.StructArray.from_arrays(fields, names=[f"w{i}" for i in range(len(kinds))])

    read.__annotations__ = {"column": pa.Array, "return": pa.Array}
    fields = ", ".join(f"w{i}: {_TYPES[k]}" for i, k in enumerate(kinds))
    return F.arrow_udf(read, f"struct<{fields}>")(data)


def _as_array(limbs: np.ndarray, missing: np.ndarray, kind: str) -> Any:
    import pyarrow as pa

    if kind in ("exact", "fits"):
        high, low = limbs[:, 2], limbs[:, 3]
        narrow = (high < _TOO_WIDE[0]) | ((high == _TOO_WIDE[0]) & (low < _TOO_WIDE[1]))
        fits = (limbs[:, :2] == 0).all(axis=1) & narrow
        if kind == "fits":
            return pa.array(fits, mask=missing)
        halves = np.ascontiguousarray(limbs[:, [3, 2]]).tobytes()  # little-endian
        valid = np.packbits(fits & ~missing, bitorder="little").tobytes()
        buffers = [pa.py_buffer(valid), pa.py_buffer(halves)]
        return pa.Array.from_buffers(pa.decimal128(38, 0), len(limbs), buffers)
    if kind == "signed":
        # the complement of a negative word, or its leading ones would swallow its digits
        negative = limbs[:, 0] >> np.uint64(63) == 1
        limbs = np.where(negative[:, None], ~limbs, limbs)
    out = np.zeros(len(limbs))
    for limb in limbs.T:
        out = out * LIMB + limb
    if kind == "signed":
        out = np.where(negative, -(out + 1.0), out)
    return pa.array(out, mask=missing)


def unsigned(w: Column) -> Column:
    """A word of text as a double."""
    return numbers(w, ["unsigned"])["w0"]


def signed(w: Column) -> Column:
    """Two's complement as a double."""
    return numbers(w, ["signed"])["w0"]


def exact(w: Column) -> Column:
    """DECIMAL(38,0) of an unsigned word; null from 10^38 on."""
    return numbers(w, ["exact"])["w0"]


def address(w: Column) -> Column:
    """The last 20 bytes of a word or topic, lower-case with ``0x``."""
    return F.concat(F.lit("0x"), F.right(F.lower(w), F.lit(40)))
