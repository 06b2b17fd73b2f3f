"""Order books from snapshots and deltas, without replaying rows one by one.

A book table has one row per record: keys, ``local_ts``, ``seq`` (any tie-break
within a timestamp), ``is_snapshot``, ``bids`` and ``asks``. A delta level sets the
absolute size at its price, size 0 removes it, and a snapshot starts a new epoch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.resample import time_grid

_PLACE = ("local_ts", "seq")
#: Groups of prices that a key's levels are dealt to.
DEALS = 8
#: Boundaries whose books are put together in one task.
CELL = 16
#: Where a record without a time stands.
_NO_TIME = -(2**62)


def book_records(snapshots: DataFrame, deltas: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Snapshots and deltas as one book table. At equal times a snapshot goes first."""
    cols = [*keys, "local_ts", "bids", "asks"]
    return snapshots.select(
        *cols, F.lit(True).alias("is_snapshot"), F.lit(-1).cast("long").alias("seq")
    ).unionByName(
        deltas.select(
            *cols,
            F.lit(False).alias("is_snapshot"),
            F.coalesce(F.col("seq_id"), F.lit(0)).cast("long").alias("seq"),
        )
    )


def _place() -> Column:
    return F.struct(*_PLACE)


def _named(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(key).isNotNull() for key in keys], F.lit(True))


_NO_LEVELS = "array<struct<price:double,size:double>>"


def _levels(records: DataFrame, keep: Sequence[str], marks: Column | None = None) -> DataFrame:
    """One row per level with its position ``i`` in the record; price rounded to 8 digits.

    ``marks`` are entries of the same fields that a record has besides.
    """

    def entries(name: str, side: str) -> Column:
        return F.transform(
            F.coalesce(F.col(name), F.array().cast(_NO_LEVELS)),
            lambda v, i: F.struct(
                F.lit(side).alias("side"),
                F.round(v["price"], 8).alias("price"),
                v["size"].alias("size"),
                i.alias("i"),
            ),
        )

    sided = F.concat(entries("bids", "bid"), entries("asks", "ask"), *([] if marks is None else [marks]))
    return records.select(*keep, F.explode(sided).alias("_lv")).select(*keep, "_lv.*")


def book_rebuild(records: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Final book per key: (side, price, size).

    Only records from the last snapshot on count, and the last size per price wins;
    both are aggregates with a map-side part.
    """
    last = records.where("is_snapshot").groupBy(*keys).agg(F.max(_place()).alias("_from"))
    live = records.join(last, list(keys)).where(_place() >= F.col("_from"))
    return (
        _levels(live, [*keys, *_PLACE])
        .groupBy(*keys, "side", "price")
        .agg(F.max_by("size", F.struct(*_PLACE, "i")).alias("size"))
        .where(F.col("size") > 0)
    )


def best_prices(book: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Highest bid and lowest ask of a rebuilt book."""
    return book.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"),
    )


def book_resample(
    records: DataFrame,
    interval_ns: int,
    *,
    top_n: int | None = None,
    keys: Sequence[str] = ("symbol",),
    as_levels: bool = False,
) -> DataFrame:
    """Books at interval boundaries: (keys, local_ts, bids, asks, depth).

    The first boundary follows the first snapshot; boundaries run up to the last
    record, and a quiet interval repeats the book. A boundary shows the records before
    it plus the first record exactly on it. Each level lives from its record to the
    next record that sets the same price, or to the next snapshot, so it lands on
    every boundary of that stretch without a join of books and boundaries.
    """
    if interval_ns <= 0:
        raise ValueError(f"interval_ns must be positive; got {interval_ns!r}")
    ts, step = F.col("local_ts"), F.lit(interval_ns)
    # first boundary whose book includes the record: on the boundary itself only
    # the first record of that timestamp counts
    up = ts + F.pmod(-ts, step)
    nth = F.row_number().over(Window.partitionBy(*keys, "local_ts").orderBy(F.col("seq").asc_nulls_first()))
    placed = records.withColumn("_nth", nth).withColumn("_late", (up == ts) & (F.col("_nth") > 1)).drop("_nth")

    # with a snapshot ahead of all times, a key starts at its least time
    untimed = F.max(F.when(F.col("is_snapshot"), ts.isNull()))
    spans = records.groupBy(*keys).agg(
        F.when(untimed, F.min("local_ts")).otherwise(F.min(F.when(F.col("is_snapshot"), ts))).alias("_t0"),
        # the empty books of records without a key end with their last snapshot
        F.max(F.when(_named(keys) | F.col("is_snapshot"), ts)).alias("_hi"),
        F.min(F.when(F.col("is_snapshot"), _place())).alias("_start"),
    )
    spans = spans.where(F.col("_start").isNotNull()).select(
        *keys,
        (F.col("_t0") - F.pmod(F.col("_t0"), step) + step).alias("_first"),
        (F.col("_hi") - F.pmod(F.col("_hi"), step)).alias("_last"),
        "_start",
    )
    lives = _lives(placed, spans, interval_ns, keys)
    if as_levels and top_n is None:
        return time_grid(lives, interval_ns, "local_ts").select(*keys, "local_ts", "side", "price", "size")
    return _assemble(lives, spans, interval_ns, top_n, keys, as_levels)


def _lives(placed: DataFrame, spans: DataFrame, interval_ns: int, keys: Sequence[str]) -> DataFrame:
    """(keys, side, price, size, _lo, _hi): first and last boundary of each level.

    The prices of a key are dealt to ``DEALS`` groups. Each group gets the key's snapshots
    and its end as marks among its levels, so that one shuffle serves the next record of a
    price as well as the next snapshot.
    """
    named = _named(keys)
    # a mark has its group's number below zero for a position, so it lies before the levels
    marks = F.transform(
        F.when(F.col("is_snapshot"), F.sequence(F.lit(1), F.lit(DEALS))).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(
            F.lit(None).cast("string").alias("side"),
            F.lit(None).cast("double").alias("price"),
            F.lit(None).cast("double").alias("size"),
            (-n).alias("i"),
        ),
    )
    rows = _levels(placed.where(named), [*keys, *_PLACE, "_late"], marks)
    deal = F.when(F.col("i") < 0, -F.col("i")).otherwise(F.pmod(F.hash("side", "price"), F.lit(DEALS)) + 1)
    ends = spans.where(named).select(
        *keys,
        F.explode(F.sequence(F.lit(1), F.lit(DEALS))).alias("_deal"),
        F.col("_last").alias("local_ts"),
        F.lit(True).alias("_late"),  # counts from the boundary after the last
        "_first",
        "_start",
    )
    rows = rows.withColumn("_deal", deal).unionByName(ends, allowMissingColumns=True)
    rows = rows.repartition(*keys, "_deal")
    up, step = F.col("local_ts") + F.pmod(-F.col("local_ts"), F.lit(interval_ns)), F.lit(interval_ns)
    # a record without a time comes before all others
    rows = rows.withColumn("_from", F.coalesce(F.when(F.col("_late"), up + step).otherwise(up), F.lit(_NO_TIME)))

    backwards = [F.col(c).desc_nulls_last() for c in (*_PLACE, "i")]
    # the end of a key is met first
    ahead = Window.partitionBy(*keys, "_deal").orderBy(F.col("_start").isNull(), *backwards)
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.when((F.col("i") < 0) | F.col("_start").isNotNull(), F.col("_from"))
    rows = rows.withColumns(
        {
            "_stop": F.last(stop, ignorenulls=True).over(ahead),
            "_open": F.last("_first", ignorenulls=True).over(ahead),
            "_begin": F.last("_start", ignorenulls=True).over(ahead),
        }
    )
    # no level before the first snapshot
    rows = rows.where((F.col("i") >= 0) & (_place() >= F.col("_begin")))
    price = Window.partitionBy(*keys, "_deal", "side", "price").orderBy(*backwards)
    rows = rows.withColumn("_next", F.lag("_from").over(price)).where(F.col("size") > 0)
    return rows.select(
        *keys,
        "side",
        "price",
        "size",
        F.greatest("_from", "_open").alias("_lo"),
        (F.least("_next", "_stop") - F.lit(interval_ns)).alias("_hi"),
    )


def _assemble(lives, spans, interval_ns, top_n, keys, as_levels):
    # the boundaries of a key stand as lives without a level, so that empty books show
    spans = spans.select(*keys, F.col("_first").alias("_lo"), F.col("_last").alias("_hi"))
    lives = lives.unionByName(spans, allowMissingColumns=True).where(F.col("_lo") <= F.col("_hi"))
    # lives are shuffled by cells of boundaries, before they grow to points
    cell = interval_ns * max(1, min(CELL, 2**60 // interval_ns))
    lives = lives.withColumns({"_a": F.col("_lo"), "_z": F.col("_hi")})
    lives = lives.withColumns({c: F.col(c) - F.pmod(c, F.lit(cell)) for c in ("_lo", "_hi")})
    dealt = time_grid(lives, cell, "_cell").repartition(*keys, "_cell")
    bounds = {"_lo": F.greatest("_a", "_cell"), "_hi": F.least("_z", F.col("_cell") + (cell - interval_ns))}
    points = time_grid(dealt.withColumns(bounds).drop("_a", "_z"), interval_ns, "local_ts")
    moment = [*keys, "_cell", "local_ts"]
    if top_n is not None:
        best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
        spec = Window.partitionBy(*moment, "side").orderBy(best)
        points = points.withColumn("_r", F.row_number().over(spec))
        points = points.where((F.col("_r") <= top_n) | F.col("side").isNull()).drop("_r")
    if as_levels:
        return points.where(F.col("side").isNotNull()).select(*keys, "local_ts", "side", "price", "size")

    def side(name: str) -> Column:
        # the levels of one book at one moment
        held = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("price", "size"))))
        return F.reverse(held) if name == "bid" else held

    books = points.groupBy(*moment).agg(side("bid").alias("bids"), side("ask").alias("asks"))
    return books.drop("_cell").withColumn("depth", (F.size("bids") + F.size("asks")).cast("long"))
