"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.session import tune

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; ``sql`` is the same result in DuckDB SQL."""

    def add(run: Run) -> Run:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            tune(spark)
            return run(spark, sf_dir.rstrip("/"))

        prepared.__name__ = run.__name__
        prepared.__doc__ = run.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *names: str, digits: int = 6, keep_nan: bool = False) -> DataFrame:
    """Round doubles so that the order of a sum does not show; NaN becomes null unless kept.

    Exact halves are common in prices with few decimals and could fall either way, so
    both sides shift by a small part of the last digit before they round.
    """
    shift = 2.7 * 10.0 ** -(digits + 2)
    value = {n: F.col(n) if keep_nan else F.when(~F.isnan(F.col(n)), F.col(n)) for n in names}
    return df.withColumns({n: F.round(v + shift, digits) for n, v in value.items()})


def rnd(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``r6``."""
    return f"round({expr} + 2.7e-{digits + 2}, {digits})"
