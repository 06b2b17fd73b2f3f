"""Queries: option values, Greeks and implied volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import options as op
from tapeline.plans.registry import query, r6, rnd, table


def chain(spark, d):
    """lineitem as an option chain near the money; open items are calls."""
    spot = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("contract"),
        spot.alias("spot"),
        (spot * (1.0 + (F.col("l_tax") - F.col("l_discount")) / 10.0)).alias("strike"),
        (F.col("l_quantity") / 50.0).alias("years"),
        F.lit(0.03).alias("rate"),
        (0.1 + F.col("l_discount") * 3.0 + F.col("l_tax")).alias("sigma"),
        F.lit(0.01).alias("dividend"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("type"),
    )


def _horner_sql(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _cdf(x: str) -> str:
    """The same rational approximation as the engine's."""
    a = f"abs({x})"
    near = f"exp(-0.5::DOUBLE * {a} * {a}) * {_horner_sql(op.HART_P, a)} / {_horner_sql(op.HART_Q, a)}"
    frac = f"({a} + 0.65::DOUBLE)"
    for n in (4, 3, 2, 1):
        frac = f"({a} + {n}::DOUBLE / {frac})"
    far = f"exp(-0.5::DOUBLE * {a} * {a}) / {frac} / {op.ROOT_2PI!r}::DOUBLE"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < {op.HART_SPLIT!r} THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE ({tail}) END"


CHAIN = f"""chain AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS contract, l_extendedprice / l_quantity AS s,
         l_extendedprice / l_quantity * (1.0 + (l_tax - l_discount) / 10.0) AS k, l_quantity / 50.0 AS t, 0.03::DOUBLE AS r, 0.01::DOUBLE AS q,
         0.1 + l_discount * 3.0 + l_tax AS v, l_linestatus = 'O' AS call FROM lineitem),
d AS (
  SELECT *, (ln(s / k) + (r - q + 0.5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM chain),
n AS (
  SELECT *, exp(-q * t) AS dq, exp(-r * t) AS dr, exp(-0.5 * d1 * d1) / {op.ROOT_2PI!r}::DOUBLE AS pdf, d1 - v * sqrt(t) AS d2 FROM d),
c AS (SELECT *, {_cdf('d1')} AS n1, {_cdf('d2')} AS n2, {_cdf('(-d1)')} AS m1, {_cdf('(-d2)')} AS m2 FROM n)"""


@query(
    "option_price",
    f"""WITH {CHAIN} SELECT contract, {rnd('CASE WHEN call THEN s * dq * n1 - k * dr * n2 ELSE k * dr * m2 - s * dq * m1 END')} AS model_price FROM c""",
)
def option_price(spark, d):
    return r6(op.enrich_chain(chain(spark, d)).select("contract", "model_price"), "model_price")


GREEKS = ["delta", "gamma", "theta", "vega", "rho"]


@query(
    "option_greeks",
    f"""WITH {CHAIN} SELECT contract, {rnd('CASE WHEN call THEN dq * n1 ELSE -dq * m1 END')} AS delta,
       {rnd('dq * pdf / (s * v * sqrt(t))')} AS gamma,
       {rnd('-(s * dq * pdf * v) / (2 * sqrt(t)) + CASE WHEN call THEN q * s * dq * n1 - r * k * dr * n2 ELSE r * k * dr * m2 - q * s * dq * m1 END')} AS theta,
       {rnd('s * dq * sqrt(t) * pdf')} AS vega, {rnd('CASE WHEN call THEN k * t * dr * n2 ELSE -k * t * dr * m2 END')} AS rho FROM c""",
)
def option_greeks(spark, d):
    return r6(op.enrich_chain(chain(spark, d)).select("contract", *GREEKS), *GREEKS)


@query(
    "option_iv",
    f"WITH {CHAIN} SELECT contract, {rnd('v', 3)} AS implied_volatility FROM c",
)
def option_iv(spark, d):
    """The volatility found from the model price is the one that made it."""
    args = [F.col(c) for c in ("model_price", "spot", "strike", "years", "rate", "dividend", "type")]
    priced = op.enrich_chain(chain(spark, d))
    out = priced.select("contract", op.option_iv(*args).alias("implied_volatility"))
    return r6(out, "implied_volatility", digits=3)
