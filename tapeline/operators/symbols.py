"""User-typed symbols to lake symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PROVIDER = "alpaca"


def symbol_resolve(
    spark: SparkSession,
    typed: Sequence[str],
    symbols: DataFrame,
    *,
    symbol: str = "symbol",
    default_provider: str = DEFAULT_PROVIDER,
) -> DataFrame:
    """(ord, input, symbol) for each non-blank input.

    ``PROVIDER:RAW`` passes through with RAW upper-cased. Otherwise the best match
    wins: exact, same but for case, same after the colon, contained in; the first in
    sort order within a kind; else the default provider is put in front. Each lake
    symbol is tested against the typed list in place, and the best match per input is
    a partial aggregate.
    """
    inputs = [(i, t.strip()) for i, t in enumerate(typed) if t.strip()]
    asked = spark.createDataFrame(inputs, "ord int, input string")
    plain = [(i, t) for i, t in inputs if ":" not in t]
    out = F.when(
        F.col("input").contains(":"),
        F.concat_ws(
            ":",
            F.substring_index("input", ":", 1),
            F.upper(F.expr("trim(substring(input, instr(input, ':') + 1))")),
        ),
    ).otherwise(F.concat(F.lit(f"{default_provider}:"), F.upper("input")))
    if not plain:
        return asked.withColumn("symbol", out)

    reg, low = F.col(symbol), F.lower(F.col(symbol))
    tail = F.when(reg.contains(":"), F.lower(F.expr(f"substring(`{symbol}`, instr(`{symbol}`, ':') + 1)")))

    def kind(text: Column) -> Column:
        folded = F.lower(text)
        return (
            F.when(reg == text, 0)
            .when(low == folded, 1)
            .when(tail == folded, 2)
            .when(low.contains(folded), 3)
        )

    listed = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("text")) for i, t in plain]
    )
    tested = F.filter(
        F.transform(listed, lambda p: F.struct(p["ord"].alias("ord"), kind(p["text"]).alias("kind"))),
        lambda p: p["kind"].isNotNull(),
    )
    best = (
        symbols.select(symbol)
        .where(reg != "")
        .select(reg.alias("_sym"), F.explode(tested).alias("_m"))
        .groupBy(F.col("_m.ord").alias("ord"))
        .agg(F.min(F.struct(F.col("_m.kind").alias("kind"), F.col("_sym").alias("sym"))).alias("_b"))
    )
    return (
        asked.join(best, "ord", "left")
        .withColumn("symbol", F.coalesce(F.col("_b.sym"), out))
        .select("ord", "input", "symbol")
    )
