"""Shards of near equal bytes by a k-d tree over the documents' metadata.

A cell that must still make up several shards is split along its widest dimension, at the
weighted median: the bytes on either side go as the shards do (one half each if their
number is even). Cells of one shard are leaves, numbered from left to right, so a shard
holds documents of alike language, source and length.

Dimensions. Every metadata column becomes a number of 31 bits over the range of the table:
numbers by their logarithm, times as they are, other values as text by their first six
bytes beyond the prefix that all values share. Nulls come first. Along a dimension
documents are ordered by that number and then by a hash of their text, 62 bits together.

Medians are found over all rows by narrowing: each round sums the bytes of every open cell
in equal stretches of its range, and the stretch that holds the median becomes the next
range, until it is one position. A round brings at most ``SUMS`` rows, or 16 a cell, to the
driver; rows of the table never come there.

Equal texts are one item: they share the least value of each dimension and so stay in one
shard. Only copies that together weigh, or count, more than a ``SLICES``-th of a shard are
dealt into several items by row number; there are at most 2 * shards * SLICES such texts,
so the list of them is broadcast. An item's neighbours fix how unequal shards may get:
half an item at each split.

Null texts weigh as empty ones. Null ids, repeated ids and repeated rows are rows like
others. A table without rows gives none; a table with fewer items than shards leaves
shards without rows. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import materialize

DIMENSIONS = ("lang", "source", "n_chars")
#: Parts of a shard that copies of one text may weigh before they are dealt out.
SLICES = 256
#: Sums that come to the driver in a round.
SUMS = 1 << 16
#: Values and hashes have as many bits.
BITS = 31


@dataclass
class Cell:
    """An open cell: shards to make, the first one's number, and its split."""

    shards: int
    first: int
    dim: int = 0
    goal: float = 0.0  # bytes for the left side
    low: int = 0
    high: int = 0
    below: int = 0  # bytes before the range
    cut: int | None = None  # last position of the left side


def shard_by_metadata(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (place in the shard, from 0) of every row.

    ``shards`` says how many, or ``target_bytes`` how much a shard should weigh: then there
    are as many as it takes for equal shards not to exceed it.
    """
    return _placed(_numbered(docs, dimensions, id_col, text_col), shards, target_bytes).drop("row")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write all columns of ``docs`` as Parquet below ``path``, one folder a shard.

    Rows meet their places by number, so the numbered rows are written once in between.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "numbered")
    own = [F.col(f"doc.`{c}`").alias(f"m{i}") for i, c in enumerate(dimensions)]
    narrow = rows.select(
        "row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"), *own
    )
    places = _placed(_narrow(narrow), shards, target_bytes).select("row", "shard")
    rows.join(places, "row").select("doc.*", F.col("shard").alias("__shard")).repartition(
        F.col("__shard"), F.pmod(F.xxhash64("__shard", *[F.col(f"`{id_col}`")]), F.lit(64))
    ).write.partitionBy("__shard").parquet(path)


def _numbered(docs: DataFrame, dimensions: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    own = [docs[c].alias(f"m{i}") for i, c in enumerate(dimensions)]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *own)
    return _narrow(rows.withColumn("row", F.monotonically_increasing_id()))


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without their texts, written once: later passes read a few bytes a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = []
    for field in rows.schema.fields:
        if field.name[0] == "m":
            value = F.col(field.name)
            if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                value = F.unix_micros(value.cast("timestamp")).cast("double")
            elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
                value = value.cast("double")
                value = F.when(~F.isnan(value), F.signum(value) * F.log1p(F.abs(value)))
            else:
                value = value.cast("string")
            meta.append(value.alias(field.name))
    return materialize(
        rows.select(
            "row",
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            *meta,
        ),
        "sizes",
    )


def _placed(rows: DataFrame, shards: int | None, target_bytes: int | None) -> DataFrame:
    """row, doc_id, size, text_crc32, shard and slot of the rows of ``_narrow``."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    meta = [c for c in rows.columns if c[0] == "m"]
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in meta for f in (F.min, F.max)]
    seen = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ranges).first()
    total, n = seen["bytes"] or 0, seen["n"]
    shards = shards or max(1, -(-total // target_bytes))
    items = _items(rows, shards, total, n)
    scaled = [
        _scaled(F.col(c), seen[f"min_{c}"], seen[f"max_{c}"]).alias(f"v{i}") for i, c in enumerate(meta)
    ]
    items = materialize(
        items.select(
            "row", "doc_id", "size", "text_crc32", "tie", F.spark_partition_id().alias("part"), *scaled
        ),
        "items",
    )
    leaves = _split(items, shards, len(meta)) if n else items.withColumn("shard", F.lit(0))
    # slots: rows before the own part of the table, and rows before in that part
    counts = leaves.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard",
        "part",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"),
    )
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return (
        leaves.withColumn("place", place.cast("long") - 1)
        .join(before, ["shard", "part"])
        .select(
            "row",
            "doc_id",
            "size",
            "text_crc32",
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("place")).alias("slot"),
        )
    )


def _items(rows: DataFrame, shards: int, total: int, n: int) -> DataFrame:
    """Rows with their item's least metadata and its hash ``tie``."""
    text = ["key", "text_crc32", "size"]
    meta = [c for c in rows.columns if c[0] == "m"]
    most = shards * SLICES
    copies = rows.groupBy(*text).agg(F.count("*").alias("copies"))
    parts = F.ceil(
        F.greatest(
            F.col("copies") * F.col("size") * F.lit(most / max(total, 1)),
            F.col("copies") * F.lit(most / max(n, 1)),
        )
    )
    # a text that exists once cannot be dealt out, however long it is
    heavy = copies.where("copies > 1").withColumn("parts", F.least(parts, "copies")).where("parts > 1")
    dealt = rows.join(F.broadcast(heavy.drop("copies")), text, "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))
    )
    item = Window.partitionBy(*text, "piece")
    return dealt.withColumns({c: F.min(c).over(item) for c in meta}).withColumn(
        "tie", F.shiftrightunsigned(F.xxhash64(*text, "piece"), 64 - BITS)
    )


def _scaled(value: Column, least, most) -> Column:
    """A value's place in the range of its column: 1 to 2^31 - 1, and 0 for null."""
    if least is None or least == most:
        return F.when(value.isNotNull(), 1).otherwise(0).cast("long")
    if isinstance(least, str):
        low, high = least.encode(), most.encode()
        shared = len(os.path.commonprefix([low, high]))

        def number(text: bytes) -> int:
            return int.from_bytes(text[shared : shared + 6].ljust(6, b"\0"), "big")

        start, span = number(low), max(1, number(high) - number(low))
        after = F.hex(F.substring(value.cast("binary"), shared + 1, 6))
        value = F.conv(F.rpad(after, 12, "0"), 16, 10).cast("long")
    else:
        start, span = float(least), float(most) - float(least)
    top = (1 << BITS) - 2
    return F.coalesce(
        F.least(F.floor((value - F.lit(start)) * F.lit(top / span)).cast("long"), F.lit(top)) + 1, F.lit(0)
    )


def _split(items: DataFrame, shards: int, dims: int) -> DataFrame:
    """``items`` with their leaf's number as ``shard``."""
    cells = {1: Cell(shards, 0)}
    leaves: list[tuple[int, int]] = []
    rows = items.withColumn("cell", F.lit(1).cast("long"))
    while cells:
        for number in [c for c, cell in cells.items() if cell.shards == 1]:
            leaves.append((number, cells.pop(number).first))
        if not cells:
            break
        _choose(rows, cells, dims)
        while any(cell.cut is None for cell in cells.values()):
            _narrow_down(rows, cells, dims)
        cuts = items.sparkSession.createDataFrame(
            [(number, cell.dim, cell.cut) for number, cell in cells.items()], "cell long, dim int, cut long"
        )
        deeper = F.col("cell") * 2 + (_position(dims) > F.col("cut")).cast("long")
        rows = rows.join(F.broadcast(cuts), "cell", "left").withColumn(
            "cell", F.when(F.col("cut").isNull(), F.col("cell")).otherwise(deeper)
        ).drop("dim", "cut")
        split = {}
        for number, cell in cells.items():
            left = cell.shards // 2
            split[2 * number] = Cell(left, cell.first)
            split[2 * number + 1] = Cell(cell.shards - left, cell.first + left)
        cells = split
    numbers = items.sparkSession.createDataFrame(leaves, "cell long, shard int")
    return rows.join(F.broadcast(numbers), "cell")


def _position(dims: int) -> Column:
    """Place along the dimension ``dim`` of the row's cell."""
    value = F.lit(0).cast("long")
    for d in range(dims):
        value = F.when(F.col("dim") == d, F.col(f"v{d}")).otherwise(value)
    return F.shiftleft(value, BITS) + F.col("tie")


def _choose(rows: DataFrame, cells: dict[int, Cell], dims: int) -> None:
    """Each open cell's widest dimension, range and goal."""
    ends = [f(f"v{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)]
    for row in rows.groupBy("cell").agg(F.sum("size").alias("bytes"), *ends).collect():
        cell = cells.get(row["cell"])
        if cell is None:
            continue
        widths = [row[f"max{d}"] - row[f"min{d}"] for d in range(dims)] or [0]
        cell.dim = max(range(len(widths)), key=lambda d: (widths[d], -d))
        low, high = (row[f"min{cell.dim}"], row[f"max{cell.dim}"]) if dims else (0, 0)
        cell.goal = row["bytes"] * (cell.shards // 2) / cell.shards
        cell.low, cell.high = low << BITS, (high << BITS) + (1 << BITS) - 1
    for cell in cells.values():
        if not cell.goal:  # no rows
            cell.cut = 0


def _narrow_down(rows: DataFrame, cells: dict[int, Cell], dims: int) -> None:
    """One round: the stretch of each cell's range that holds its weighted median."""
    open_ = {number: cell for number, cell in cells.items() if cell.cut is None}
    stretches = max(16, SUMS // len(open_))
    ranges = rows.sparkSession.createDataFrame(
        [(k, c.dim, c.low, c.high, (c.high - c.low) // stretches + 1) for k, c in open_.items()],
        "cell long, dim int, low long, high long, step long",
    )
    sums = (
        rows.join(F.broadcast(ranges), "cell")
        .withColumn("position", _position(dims))
        .where("position between low and high")
        .groupBy("cell", F.expr("(position - low) div step").alias("stretch"))
        .agg(F.sum("size").alias("bytes"), F.min("position").alias("low"), F.max("position").alias("high"))
    )
    found: dict[int, list] = {number: [] for number in open_}
    for row in sums.collect():  # at most SUMS rows, or 16 a cell
        found[row["cell"]].append((row["low"], row["high"], row["bytes"]))
    for number, cell in open_.items():
        for low, high, weight in sorted(found[number]):
            if cell.below + weight >= cell.goal:
                break
            cell.below += weight
        cell.low, cell.high = low, high
        if low == high:
            nearer_before = cell.goal - cell.below < cell.below + weight - cell.goal
            cell.cut = low - 1 if nearer_before else low
