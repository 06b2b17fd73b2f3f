"""Sequence numbers and book-delta continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.ordered import DAY_NS, Segment, lag_columns, lay_out, running


def seq_gap(
    records: DataFrame,
    *,
    seq: str = "seq",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts",),
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Compare each sequence number with the one expected.

    A forward jump is reported with the numbers skipped and becomes the new baseline;
    a step back (or a repeat) is reported and leaves the baseline. The baseline never
    falls, so it is the running maximum of the earlier rows.
    """
    layout = running(
        lay_out(records, keys, order, segment), {"_base": ("max", F.col(seq))}, inclusive=False
    )
    expected = F.col("_base") + 1
    got = F.col(seq)
    is_gap = F.col("_base").isNotNull() & (got != expected)
    return (
        layout.done()
        .withColumns(
            {
                "expected": expected,
                "is_gap": is_gap,
                "skipped": F.when(is_gap, got - expected),
                "kind": F.when(is_gap, F.when(got > expected, "forward").otherwise("backward")),
            }
        )
        .drop("_base")
    )


def book_gap(
    records: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("local_ts", "seq"),
    segment: Segment = DAY_NS,
) -> DataFrame:
    """Continuity of book deltas within the stretch that a snapshot starts.

    ``records`` mixes snapshots and deltas: ``is_snapshot``, ``seq`` (the snapshot's
    or the delta's number), ``prev_seq`` and ``content`` (anything that equals when
    two deltas carry the same levels). Rows before the first snapshot have no status.
    Statuses: ok, duplicate, gap.
    """
    snap = F.col("is_snapshot")
    layout = running(
        lay_out(records, keys, order, segment),
        {
            "_snaps": ("count", F.when(snap, F.lit(1))),
            # a snapshot without a number clears the last one, hence the wrapped value
            "_last": (
                "last",
                F.when(snap | F.col("seq").isNotNull(), F.struct(F.col("seq").alias("v"))),
            ),
        },
        inclusive=False,
    )
    layout = lag_columns(layout, {"_prev": (F.struct("is_snapshot", "content"), 1)})
    last = F.col("_last.v")
    seq, prev = F.col("seq"), F.col("prev_seq")
    first = F.col("_prev.is_snapshot")
    same = seq == last
    repeat = F.when(~first & (F.col("_prev.content") != F.col("content")), "gap").otherwise(
        "duplicate"
    )
    with_prev = F.when(last.isNull(), "gap").when(
        F.when(first, (prev < last) & (last <= seq)).otherwise(prev == last), "ok"
    ).otherwise("gap")
    without_prev = F.when(seq.isNotNull() & last.isNotNull() & (seq != last + 1), "gap").otherwise("ok")
    status = F.when(snap, F.lit("ok")).when(F.col("_snaps") > 0, F.when(same, repeat).when(prev.isNotNull(), with_prev).otherwise(without_prev))
    return layout.done().withColumn("status", status).drop("_snaps", "_last", "_prev")
