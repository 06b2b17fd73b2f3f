"""Ordered work per key (lag, rolling frames, running totals, recurrences) that
holds when one key owns a large part of the table.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key is cut
into segments by a column of the row itself, by default the UTC day of a nanosecond
time, so the same plan serves tables of every size and a row's segment never changes.
Segments are tied together exactly: rolling frames get the last rows of the segments
before them, running totals and recurrences the summary of the segments before them.
Building a plan starts no job. A caller who knows that keys are short (bars hold one row
per interval) passes ``segment=None`` and gets the plain window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nanoseconds of a day: the width of a segment along a time.
DAY_NS = 86_400_000_000_000
# The width of a segment along an integer of another unit, such as a sequence number.
STEPS = 65_536
Segment = Column | int | None
SEGMENT = "_seg"
OWN = "_own"


def sort_columns(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """``"x"`` sorts ascending (nulls first), ``"-x"`` the other way round."""
    out = []
    for name in order:
        descending = name.startswith("-")
        col = F.col(name.lstrip("-"))
        out.append(col.desc_nulls_last() if descending != reverse else col.asc_nulls_first())
    return out


@dataclass(frozen=True)
class Layout:
    """A table laid out for ordered work: use ``window()`` over ``df``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @property
    def part(self) -> list[str]:
        return [*self.keys, SEGMENT] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*sort_columns(self.order))

    def segments(self) -> WindowSpec:
        """The segments of a key in the order of its rows."""
        col = F.col(SEGMENT)
        return Window.partitionBy(*self.keys).orderBy(col.desc() if self.descending else col.asc())

    @property
    def descending(self) -> bool:
        return self.order[0].startswith("-")

    def place(self) -> Column:
        """Rises along the order, for ``max_by``; descending columns must be numeric."""
        return F.struct(*[-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in self.order])

    def with_df(self, df: DataFrame) -> Layout:
        return replace(self, df=df)

    def settle(self) -> Layout:
        """Drop the rows lent by ``with_context`` but stay laid out."""
        if OWN not in self.df.columns:
            return self
        return self.with_df(self.df.where(F.col(OWN)).drop(OWN))

    def done(self) -> DataFrame:
        out = self.df
        if OWN in out.columns:
            out = out.where(F.col(OWN))
        return out.drop(SEGMENT, OWN)


def is_time(name: str) -> bool:
    """Whether a column's name says nanoseconds, as the channel tables have them."""
    return name == "bar" or name == "ts" or name.endswith("_ts")


def _segment_of(df: DataFrame, order: Sequence[str], width: int) -> Column | None:
    """Segments along the first order column: steps of ``width``, or days of a timestamp.

    A day is no step for integers whose name says no time; these are cut every ``STEPS``.

    Dates fall into years, other types are not cut. A missing time counts as the first.
    """
    name = order[0].lstrip("-")
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        at = col.cast("long")
        if width == DAY_NS and not is_time(name):
            width = STEPS
        return F.coalesce(F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width)), F.lit(-(2**62)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_date(F.to_date(col)), F.lit(-(2**30)))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.year(col), F.lit(-(2**30)))
    return None


def lay_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Segment = DAY_NS
) -> Layout:
    """Cut ``df`` for ordered work.

    ``segment`` is a column that never falls along the order (never rises, if the first
    order column is descending), or the width of a step along the first order column, or
    None for keys that are short as a whole. Without one, nanosecond times are cut by
    days and other integers, whose unit nobody knows, every ``STEPS``. Results are the
    same at any width; pass one where values are further apart.
    """
    if isinstance(segment, int):
        segment = _segment_of(df, order, segment)
    if segment is None:
        return Layout(df, tuple(keys), tuple(order), split=False)
    return Layout(df.withColumn(SEGMENT, segment), tuple(keys), tuple(order), split=True)


def with_context(layout: Layout, rows: int) -> Layout:
    """Give each segment the ``rows`` rows of its key that precede it.

    The added rows carry ``_own = false`` and are dropped by ``Layout.done``.
    A segment shorter than ``rows`` lets the next ones reach further back.
    """
    if not layout.split or rows <= 0:
        return layout
    part = layout.part
    backwards = Window.partitionBy(*part).orderBy(*sort_columns(layout.order, reverse=True))
    tails = layout.df.withColumn("_back", F.row_number().over(backwards)).where(
        F.col("_back") <= rows
    )
    by_segment = layout.segments()
    pieces = (
        layout.df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_len"))
        .withColumn("_end", F.sum("_len").over(by_segment))
        .withColumn(
            "_later",
            F.collect_list(F.struct(F.col(SEGMENT).alias("seg"), (F.col("_end") - F.col("_len")).alias("start"))).over(
                by_segment.rowsBetween(1, rows)
            ),
        )
    )
    place = F.col("_end") - F.col("_back") + 1
    wanted = F.transform(
        F.filter("_later", lambda p: p["start"] < place + rows), lambda p: p["seg"]
    )
    lent = (
        tails.join(pieces.drop("_len"), [*part], "inner")
        .withColumn("_to", F.explode(wanted))
        .withColumn(SEGMENT, F.col("_to"))
        .withColumn(OWN, F.lit(False))
        .drop("_back", "_end", "_later", "_to")
    )
    return layout.with_df(layout.df.withColumn(OWN, F.lit(True)).unionByName(lent))


def running(
    layout: Layout, columns: dict[str, tuple[str, Column]], inclusive: bool = True
) -> Layout:
    """Running ``max``, ``min``, ``sum``, ``count`` or ``last`` (non-null) per key.

    ``inclusive=False`` covers the earlier rows only.
    """
    last_row = Window.currentRow if inclusive else -1
    frame = layout.window().rowsBetween(Window.unboundedPreceding, last_row)
    aggregate = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    df = layout.df
    for name, (kind, expr) in columns.items():
        if kind == "last":
            df = df.withColumn(name, F.last(expr, ignorenulls=True).over(frame))
        else:
            df = df.withColumn(name, aggregate[kind](expr).over(frame))
    if not layout.split:
        return layout.with_df(df)

    place = layout.place()
    totals = []
    for name, (kind, expr) in columns.items():
        if kind == "last":
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), place)).alias(f"_t_{name}"))
        else:
            totals.append(aggregate[kind](expr).alias(f"_t_{name}"))
    before = layout.segments().rowsBetween(Window.unboundedPreceding, -1)
    carried = layout.df.groupBy(*layout.part).agg(*totals)
    for name, (kind, _) in columns.items():
        total = F.col(f"_t_{name}")
        if kind == "last":
            carry = F.last(total, ignorenulls=True)
        else:
            carry = (F.sum if kind == "count" else aggregate[kind])(total)
        carried = carried.withColumn(f"_c_{name}", carry.over(before))
    carried = carried.select(*layout.part, *[f"_c_{name}" for name in columns])
    df = df.join(carried, layout.part, "left")
    for name, (kind, _) in columns.items():
        here, carry = F.col(name), F.col(f"_c_{name}")
        if kind == "max":
            df = df.withColumn(name, F.greatest(here, carry))
        elif kind == "min":
            df = df.withColumn(name, F.least(here, carry))
        elif kind == "last":
            df = df.withColumn(name, F.coalesce(here, carry))
        elif kind == "count":
            df = df.withColumn(name, here + F.coalesce(carry, F.lit(0)))
        else:
            df = df.withColumn(
                name,
                F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0))),
            )
        df = df.drop(f"_c_{name}")
    return layout.with_df(df)


def rows_since(layout: Layout, marked: Column, place: str, gap: str) -> Layout:
    """Add each row's place in its key (from 1) and the rows since the last earlier one where
    ``marked`` holds (null before the first).

    Segments are numbered by themselves. A segment is summarised by its length and the
    place of its last marked row; these give the rows ahead of the next segments.
    """
    spec = layout.window()
    df = layout.df.withColumn("_row", F.row_number().over(spec))
    df = df.withColumn("_hit", F.when(marked, F.col("_row")))
    # hits rise along the order, so the greatest is the last
    earlier = spec.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_last", F.max("_hit").over(earlier))
    if not layout.split:
        out = df.withColumns({place: F.col("_row"), gap: F.col("_row") - F.col("_last")})
        return layout.with_df(out.drop("_row", "_hit", "_last"))

    before = layout.segments().rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*layout.part).agg(F.max("_row").alias("_rows"), F.max("_hit").alias("_end"))
    ends = ends.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    ends = ends.withColumn("_past", F.max(F.col("_start") + F.col("_end")).over(before))
    # rows lie by the join's key already, so only the summaries are shuffled
    out = df.join(ends.select(*layout.part, "_start", "_past"), layout.part, "left")
    start = F.coalesce(F.col("_start"), F.lit(0))
    last = F.coalesce(start + F.col("_last"), F.col("_past"))
    out = out.withColumns({place: start + F.col("_row"), gap: start + F.col("_row") - last})
    return layout.with_df(out.drop("_row", "_hit", "_last", "_start", "_past"))


@dataclass(frozen=True)
class Blend:
    """The input of a second-stage recurrence: ``scale * sum(weight * first-stage value)``."""

    scale: str
    weights: dict[str, float]


def _solve(a: Any, b: Any) -> tuple[Any, Any]:
    """``y[t] = a[t] * y[t-1] + b[t]`` with ``y[-1] = 0``, plus the products of ``a``.

    Affine steps compose, so ranges of doubling length are merged.
    """
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        step *= 2
    return b, a


def recurrences(
    layout: Layout, terms: dict[str, tuple[str, str | Blend]]
) -> Layout:
    """Add ``y[t] = a[t] * y[t-1] + b[t]`` columns, where ``a`` and ``b`` are columns.

    ``terms`` maps an output name to its (a, b) column names; ``b`` may be a
    ``Blend`` of outputs named before it. ``a`` must be 0 on the row that seeds a key
    and neither may be null; rows ahead of the seed yield 0. One sorted pass over Arrow batches serves all
    keys of a partition at once.
    """
    plain = {n: t for n, t in terms.items() if not isinstance(t[1], Blend)}
    if layout.split and len(plain) < len(terms):
        out = recurrences(layout, plain)
        for name, (a, blend) in terms.items():
            if isinstance(blend, Blend):
                value = sum((F.col(n) * w for n, w in blend.weights.items()), F.lit(0.0))
                col = f"_b_{name}"
                out = out.with_df(out.df.withColumn(col, F.col(blend.scale) * value))
                out = recurrences(out, {name: (a, col)})
                out = out.with_df(out.df.drop(col))
        return out

    # both readers of the solved rows reuse this one exchange
    numbered = (
        layout.df.repartition(*[F.col(c) for c in layout.part])
        .sortWithinPartitions(*[F.col(c) for c in layout.part], *sort_columns(layout.order))
        .withColumn("_head", F.row_number().over(layout.window()) == 1)
    )
    names = list(terms)
    added = [*names, *[f"_p_{n}" for n in names]] if layout.split else names
    fields = [*numbered.drop("_head").schema.fields]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in added])
    split = layout.split

    def solve(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        y_last = dict.fromkeys(names, 0.0)
        p_last = dict.fromkeys(names, 1.0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            head = batch.column("_head").to_numpy(zero_copy_only=False)
            y, p = {}, {}
            for name in names:
                a_name, source = terms[name]
                a = batch.column(a_name).to_numpy(zero_copy_only=False).astype(float)
                if isinstance(source, Blend):
                    mix = sum(y[n] * w for n, w in source.weights.items())
                    b = batch.column(source.scale).to_numpy(zero_copy_only=False) * mix
                else:
                    b = batch.column(source).to_numpy(zero_copy_only=False).astype(float)
                gains = a.copy()
                a = np.where(head, 0.0, a)
                y[name], _ = _solve(np.concatenate([[0.0], a]), np.concatenate([[y_last[name]], b]))
                y[name] = y[name][1:]
                y_last[name] = float(y[name][-1])
                if split:
                    # product of a since the head of the segment, head included:
                    # log-free, as a recurrence of its own
                    grow = np.where(head, 0.0, gains)
                    seed = np.where(head, gains, 0.0)
                    prod, _ = _solve(
                        np.concatenate([[0.0], grow]), np.concatenate([[p_last[name]], seed])
                    )
                    p[name] = prod[1:]
                    p_last[name] = float(p[name][-1])
            keep = [c for c in batch.schema.names if c != "_head"]
            arrays = [batch.column(c) for c in keep] + [pa.array(y[n]) for n in names]
            cols = keep + names
            if split:
                arrays += [pa.array(p[n]) for n in names]
                cols += [f"_p_{n}" for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    solved = numbered.mapInArrow(solve, schema)
    if not layout.split:
        return layout.with_df(solved)

    # entry value of a segment = what the segments before it end with
    place = layout.place()
    ends = solved.groupBy(*layout.part).agg(
        *[F.max_by(n, place).alias(f"_y_{n}") for n in names],
        *[F.max_by(f"_p_{n}", place).alias(f"_a_{n}") for n in names],
    )
    folded = recurrences(
        Layout(ends, layout.keys, ("-" + SEGMENT if layout.descending else SEGMENT,), split=False),
        {f"_e_{n}": (f"_a_{n}", f"_y_{n}") for n in names},
    ).df
    earlier = layout.segments()
    entry = folded.select(
        *layout.part, *[F.lag(f"_e_{n}").over(earlier).alias(f"_e_{n}") for n in names]
    )
    out = solved.join(entry, layout.part, "left")
    for n in names:
        out = out.withColumn(
            n, F.col(n) + F.col(f"_p_{n}") * F.coalesce(F.col(f"_e_{n}"), F.lit(0.0))
        )
    return layout.with_df(out.drop(*[f"_p_{n}" for n in names], *[f"_e_{n}" for n in names]))


def lag_columns(
    layout: Layout, columns: dict[str, tuple[Column, int]]
) -> Layout:
    """Earlier values within the key: ``{out: (expr, rows back)}``."""
    reach = max(back for _, back in columns.values())
    wide = with_context(layout, reach)
    spec = wide.window()
    return wide.with_df(
        wide.df.withColumns({n: F.lag(e, back).over(spec) for n, (e, back) in columns.items()})
    )
