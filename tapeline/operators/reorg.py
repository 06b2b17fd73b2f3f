"""Chain reorganisations: blocks that do not continue the block held before them.

The rule. Blocks come in order of arrival, and at most ``max_depth - 1`` of them are held
when one comes: those of the highest numbers. A block of number n whose parent is not the
hash held for n - 1 is a fork at n - 1: what is held from there on is forgotten and the
block is not held itself. Any other block is held, in place of one of its number.

Most blocks cannot be a fork, whatever is held: no block of the number before has another
hash than their parent. An equi-join with the least and greatest hash of every number tells
the doubtful ones. Between two doubtful blocks holding is plain: the later hash of a number
counts and the highest numbers stay, in any order, so a stretch is taken at once.

Segments. What is held depends on all earlier blocks, but only through at most
``max_depth - 1`` hashes. Blocks are dealt by range of (chain, arrival), and the segments of
a chain run side by side, each from what it supposes to be held at its start: at first
nothing, then what the segment before it ended with. Segments whose supposition changed run
again, until none does; then every segment has run from the true end of the one before it.
Holdings forget their past after ``max_depth`` higher blocks, so that two or three rounds do,
however long a chain is. (Only chains that keep falling need more, at most one a segment.)
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import nlargest
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import materialize

#: Blocks of a segment, about; a task's Python holds one segment at a time.
SEGMENT_ROWS = 100_000

_HELD = "array<struct<number:long,hash:string>>"
_FORKS = "array<struct<block_number:long,fork_point:long,expected:string,got:string>>"


def advance(
    held: dict[int, Any],
    numbers: Sequence[int],
    hashes: Sequence[Any],
    parents: Sequence[Any],
    doubtful: Sequence[int],
    max_depth: int,
) -> tuple[list[tuple], dict[int, Any]]:
    """Forks among blocks in order of arrival, and what is held after them.

    ``doubtful`` are the places of blocks that may be forks, in order.
    """
    keep = max_depth - 1

    def taken(held: dict[int, Any], start: int, end: int) -> dict[int, Any]:
        held.update(zip(numbers[start:end], hashes[start:end]))
        if len(held) > keep + 8:
            return {n: held[n] for n in nlargest(keep, held)}
        while len(held) > keep:
            del held[min(held)]
        return held

    forks, start = [], 0
    for at in doubtful:
        held, start = taken(held, start, at), at
        fork = numbers[at] - 1
        expected = held.get(fork)
        if expected is not None and expected != parents[at]:
            forks.append((numbers[at], fork, expected, parents[at]))
            held = {n: h for n, h in held.items() if n < fork}
            start = at + 1
    return forks, taken(held, start, len(numbers))


def reorg_detect(
    blocks: DataFrame,
    *,
    keys: Sequence[str] = ("chain",),
    max_depth: int = 100,
    arrival: str = "arrival",
    segments: int | None = None,
) -> DataFrame:
    """The keys, block_number, fork_point, expected and got of every fork.

    ``blocks`` has the keys, ``arrival`` (equal ones follow by number and hash),
    block_number, block_hash and parent_hash; rows without a number are left out.
    ``segments`` sets their number, otherwise one for every ``SEGMENT_ROWS`` rows.
    """
    keys = list(keys)
    rows = blocks.select(
        *keys, F.col(arrival).alias("_at"), "block_number", "block_hash", "parent_hash"
    ).where(F.col("block_number").isNotNull())
    marked = _mark_doubtful(rows, keys)
    # a number of its own, as partitions without one are merged until they are many MB
    segments = segments or rows.count() // SEGMENT_ROWS + 1
    dealt = marked.repartitionByRange(segments, *keys, "_at")
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "blocks")
    segment = [*keys, "_part"]
    starts = dealt.select(*segment).distinct().withColumn("start", F.array().cast(_HELD))
    done = None
    while True:
        ran = materialize(_run(dealt, starts, segment, max_depth), "segments")
        if done is not None:
            again = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in segment]
            kept = done.alias("d").join(ran.alias("r"), again, "left_anti")
            ran = materialize(kept.unionByName(ran), "segments")
        done = ran
        before = F.lag("held").over(Window.partitionBy(*keys).orderBy("_part"))
        supposed = F.coalesce(before, F.array().cast(_HELD))
        starts = materialize(
            done.withColumn("_now", supposed)
            .where(~F.col("_now").eqNullSafe(F.col("start")))
            .select(*segment, F.col("_now").alias("start")),
            "starts",
        )
        if starts.isEmpty():
            return done.select(*keys, F.inline("forks"))


def _mark_doubtful(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``doubtful``: a block of the number before has another hash than the parent."""
    before = rows.groupBy(*keys, "block_number").agg(
        F.min("block_hash").alias("_low"), F.max("block_hash").alias("_high")
    )
    named = before.select(
        *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)],
        (F.col("block_number") + 1).alias("_next"),
        "_low",
        "_high",
    )
    on = [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)]
    joined = rows.join(named, [*on, F.col("block_number") == F.col("_next")], "left")
    parent = F.col("parent_hash")
    same = parent.eqNullSafe(F.col("_low")) & parent.eqNullSafe(F.col("_high"))
    doubtful = F.col("_low").isNotNull() & ~same
    return joined.select(
        *keys, "_at", "block_number", "block_hash", "parent_hash", doubtful.alias("doubtful")
    )


def _run(dealt: DataFrame, starts: DataFrame, segment: list[str], max_depth: int) -> DataFrame:
    """Forks of the segments that ``starts`` names, and what each holds at its end."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in segment]

    def run(rows: Any, start: Any) -> Any:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not start.num_rows:
            return start.select(segment).append_column("start", start.column("start")).append_column(
                "held", start.column("start")
            ).append_column("forks", pa.array([], pa.list_(_fork_type())))
        rows = rows.sort_by([(c, "ascending") for c in ("_at", "block_number", "block_hash")])
        number, hash_, parent = (
            rows.column(c).to_pylist() for c in ("block_number", "block_hash", "parent_hash")
        )
        doubtful = pc.indices_nonzero(rows.column("doubtful")).to_pylist()
        held = {e["number"]: e["hash"] for e in start.column("start")[0].as_py()}
        forks, held = advance(held, number, hash_, parent, doubtful, max_depth)
        ends = [[{"number": n, "hash": held[n]} for n in sorted(held)]]
        found = [[dict(zip(("block_number", "fork_point", "expected", "got"), f)) for f in forks]]
        return (
            start.select([*segment, "start"])
            .append_column("held", pa.array(ends, start.schema.field("start").type))
            .append_column("forks", pa.array(found, pa.list_(_fork_type())))
        )

    return (
        dealt.groupBy(*segment)
        .cogroup(starts.groupBy(*segment))
        .applyInArrow(run, f"{', '.join(kinds)}, start {_HELD}, held {_HELD}, forks {_FORKS}")
    )


def _fork_type() -> Any:
    import pyarrow as pa

    return pa.struct(
        [
            ("block_number", pa.int64()),
            ("fork_point", pa.int64()),
            ("expected", pa.string()),
            ("got", pa.string()),
        ]
    )
