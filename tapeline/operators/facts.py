"""Fundamental facts: newest restatement, ratio inputs and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.ratios import RATIOS


def facts_latest(
    facts: DataFrame, *, keys: Sequence[str] = ("symbol",), ord: str | None = None, by_unit: bool = False
) -> DataFrame:
    """One fact per (taxonomy, tag, end, fy, fp): the latest filed, then one with a
    frame, then the first by ``ord``, a number or an array of numbers."""
    key = [*keys, "taxonomy", "tag", "end", "fy", "fp"] + (["unit"] if by_unit else [])
    framed = F.coalesce(F.col("frame") != "", F.lit(False))
    first = F.lit(0)
    if ord and isinstance(facts.schema[ord].dataType, T.ArrayType):
        first = F.transform(ord, lambda x: -x)
    elif ord:
        first = -F.col(ord)
    place = F.struct(F.coalesce("filed", F.lit("")), framed, first)
    rest = [c for c in facts.columns if c not in key]
    newest = facts.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("_r"))
    return newest.select(*key, "_r.*").select(*facts.columns)


def ratios(
    facts: DataFrame,
    inputs: dict[str, str],
    *,
    keys: Sequence[str] = ("symbol", "end", "fy", "fp"),
    ord: str | None = None,
) -> DataFrame:
    """Pivot facts to the ratio inputs of one fiscal period and compute every ratio.

    ``inputs`` maps a ratio input (price, eps, ...) to the fact tag that holds it. A
    quarter and a year that end on one day stay apart; ``ord`` settles equal facts.
    """
    latest = facts_latest(facts, keys=["symbol"], ord=ord)
    wide = latest.groupBy(*keys).agg(
        *[F.max(F.when(F.col("tag") == tag, F.col("val"))).alias(name) for name, tag in inputs.items()]
    )
    out = {
        name: fn(F.col(a), F.col(b))
        for name, (fn, a, b) in RATIOS.items()
        if a in inputs and b in inputs
    }
    return wide.withColumns(out)
