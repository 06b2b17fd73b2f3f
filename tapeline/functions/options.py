"""European option value, Greeks and implied volatility.

Value and Greeks are column expressions; implied volatility iterates, so it is one
vectorised pandas UDF over Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rational approximation of the normal tail (Hart 1968, algorithm 5666, as given by
# West 2005). Fixed values, highest power first.
HART_P = [
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
HART_Q = [
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
HART_SPLIT = 7.07106781186547
ROOT_2PI = 2.506628274631000502


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / ROOT_2PI


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, good to about 1e-15."""
    a = F.abs(x)
    near = F.exp(-0.5 * a * a) * _horner(HART_P, a) / _horner(HART_Q, a)
    frac = a + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(n) / frac
    far = F.exp(-0.5 * a * a) / frac / ROOT_2PI
    tail = F.when(a > 37.0, 0.0).when(a < HART_SPLIT, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def is_call(kind: Column) -> Column:
    return F.lower(kind).isin("c", "call")


def valid_inputs(s: Column, k: Column, t: Column, kind: Column) -> Column:
    """Rows that can be valued: non-negative spot, strike and time and a known type."""
    return (s >= 0) & (k >= 0) & (t >= 0) & F.lower(kind).isin("c", "call", "p", "put")


def _sign(kind: Column) -> Column:
    return F.when(is_call(kind), 1.0).otherwise(-1.0)


def _d1(s, k, t, r, sigma, q) -> Column:
    drift = (r - q + 0.5 * sigma * sigma) * t
    return F.try_divide(F.ln(F.try_divide(s, k)) + drift, sigma * F.sqrt(t))


def _value(s, k, t, r, sigma, q, kind, n1: Column, n2: Column) -> Column:
    """Value from the two probabilities, signed by the option type."""
    sign = _sign(kind)
    fwd, pv = s * F.exp(-q * t), k * F.exp(-r * t)
    zero = F.lit(0.0)
    value = (
        F.when(t == 0, F.greatest(zero, sign * (s - k)))
        .when(s == 0, zero)
        .when(k == 0, F.when(is_call(kind), fwd).otherwise(zero))
        .when(sigma <= 0, F.greatest(zero, sign * (fwd - pv)))
        .otherwise(sign * (fwd * n1 - pv * n2))
    )
    return F.when(valid_inputs(s, k, t, kind), value)


def _greeks(s, k, t, r, sigma, q, kind, d1, n1: Column, n2: Column) -> dict[str, Column]:
    sign, call = _sign(kind), is_call(kind)
    ok = valid_inputs(s, k, t, kind)
    dq, dr = F.exp(-q * t), F.exp(-r * t)
    root = F.sqrt(t)
    density = norm_pdf(d1)
    zero = F.lit(0.0)
    no_strike = (k == 0) & (s > 0) & (t > 0)
    flat = (t == 0) | (s == 0) | (k == 0) | (sigma <= 0)
    step = F.when(sign * (s - k) > 0, sign).otherwise(0.0)
    decay = F.try_divide(-(s * dq * density * sigma), 2.0 * root)

    def pick(at_no_strike: Column, at_flat: Column, value: Column) -> Column:
        return F.when(ok, F.when(no_strike, at_no_strike).when(flat, at_flat).otherwise(value))

    return {
        "delta": pick(F.when(call, dq).otherwise(zero), step, sign * dq * n1),
        "gamma": pick(zero, zero, F.try_divide(dq * density, s * sigma * root)),
        "theta": pick(
            F.when(call, -q * s * dq).otherwise(zero),
            zero,
            decay + sign * (q * s * dq * n1 - r * k * dr * n2),
        ),
        "vega": pick(zero, zero, s * dq * root * density),
        "rho": pick(zero, zero, sign * k * t * dr * n2),
    }


def option_price(
    s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column, kind: Column
) -> Column:
    """Value with continuous yield; null for invalid inputs.

    At expiry the intrinsic value; with a worthless underlying 0 for calls and puts
    alike; without volatility the discounted intrinsic value.
    """
    sign, d1 = _sign(kind), _d1(s, k, t, r, sigma, q)
    n1, n2 = norm_cdf(sign * d1), norm_cdf(sign * (d1 - sigma * F.sqrt(t)))
    return _value(s, k, t, r, sigma, q, kind, n1, n2)


def option_greeks(
    s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column, kind: Column
) -> dict[str, Column]:
    """delta, gamma, theta (per year), vega and rho; null for invalid inputs."""
    sign, d1 = _sign(kind), _d1(s, k, t, r, sigma, q)
    n1, n2 = norm_cdf(sign * d1), norm_cdf(sign * (d1 - sigma * F.sqrt(t)))
    return _greeks(s, k, t, r, sigma, q, kind, d1, n1, n2)


def _cdf_batch(x):
    """``norm_cdf`` on an array."""
    import numpy as np

    a = np.minimum(np.abs(x), 38.0)
    bell = np.exp(-0.5 * a * a)
    frac = a + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        frac = a + n / frac
    near = bell * np.polyval(HART_P, a) / np.polyval(HART_Q, a)
    tail = np.where(a < HART_SPLIT, near, bell / frac / ROOT_2PI)
    return np.where(x > 0, 1.0 - tail, tail)


def _iv_batch(price, s, k, t, r, q, call, steps: int = 100, tol: float = 1e-6):
    """Safeguarded Newton on arrays; rows leave the working set as they finish."""
    import numpy as np

    root_t = np.sqrt(np.maximum(t, 0.0))
    dq, dr = np.exp(-q * t), np.exp(-r * t)
    fwd, pv = s * dq, k * dr

    def value(rows, sigma):
        sd = sigma * root_t[rows]
        d1 = (np.log(s[rows] / k[rows]) + (r[rows] - q[rows] + 0.5 * sigma**2) * t[rows]) / sd
        n1, n2 = _cdf_batch(d1), _cdf_batch(d1 - sd)
        as_call = fwd[rows] * n1 - pv[rows] * n2
        out = np.where(call[rows], as_call, as_call - fwd[rows] + pv[rows])
        vega = fwd[rows] * root_t[rows] * np.exp(-0.5 * d1 * d1) / math.sqrt(2.0 * math.pi)
        return out, vega

    out = np.full(len(price), np.nan)
    with np.errstate(all="ignore"):
        gap = np.where(call, fwd - pv, pv - fwd)
        low_value, high_value = np.maximum(0.0, gap), np.where(call, fwd, pv)
        usable = (t > 0) & (s > 0) & (k > 0) & (price > 0)
        usable &= (price >= low_value - 1e-9) & (price <= high_value + 1e-9)
        rows = np.flatnonzero(usable)
        target = np.clip(price, low_value, high_value)
        lo, hi = np.full(len(price), 1e-6), np.full(len(price), 10.0)
        at_lo, _ = value(rows, lo[rows])
        done = target[rows] <= at_lo
        out[rows[done]] = 1e-6
        rows = rows[~done]
        at_hi, _ = value(rows, hi[rows])
        beyond = target[rows] >= at_hi
        hi[rows[beyond]] = 50.0
        at_hi, _ = value(rows, hi[rows])
        rows = rows[target[rows] < at_hi]
        sigma = np.full(len(price), 0.4)
        for step in range(steps + 1):
            if len(rows) == 0:
                break
            x = sigma[rows]
            now, vega = value(rows, x)
            diff = now - target[rows]
            close = np.abs(diff) < tol
            out[rows[close]] = x[close]
            if step == steps:
                break
            rows, x, diff, vega = rows[~close], x[~close], diff[~close], vega[~close]
            hi[rows] = np.where(diff > 0, x, hi[rows])
            lo[rows] = np.where(diff > 0, lo[rows], x)
            newton = x - diff / np.where(vega > 1e-4, vega, np.nan)
            inside = (newton > lo[rows]) & (newton < hi[rows])
            sigma[rows] = np.where(inside, newton, 0.5 * (lo[rows] + hi[rows]))
    return out


@F.pandas_udf(T.DoubleType())
def _iv_udf(
    price: pd.Series,
    s: pd.Series,
    k: pd.Series,
    t: pd.Series,
    r: pd.Series,
    q: pd.Series,
    call: pd.Series,
) -> pd.Series:
    cols = [c.to_numpy(dtype=float, na_value=float("nan")) for c in (price, s, k, t, r, q)]
    return pd.Series(_iv_batch(*cols, call.fillna(False).to_numpy(dtype=bool)))


def option_iv(
    price: Column, s: Column, k: Column, t: Column, r: Column, q: Column, kind: Column
) -> Column:
    """Implied volatility; NaN outside the no-arbitrage bounds or without convergence."""
    # Arrow carries NaN as null
    return F.coalesce(_iv_udf(price, s, k, t, r, q, is_call(kind)), F.lit(float("nan")))


def register(spark) -> None:
    """Make ``option_iv(price, s, k, t, r, q, is_call)`` callable from SQL."""
    spark.udf.register("option_iv", _iv_udf)


def enrich_chain(
    chain: DataFrame,
    *,
    spot: str = "spot",
    strike: str = "strike",
    years: str = "years",
    rate: str = "rate",
    sigma: str = "sigma",
    dividend: str = "dividend",
    kind: str = "type",
) -> DataFrame:
    """Option rows with their value and Greeks."""
    args = [F.col(c) for c in (spot, strike, years, rate, sigma, dividend, kind)]
    s, k, t, r, v, q, kind_ = args
    # intermediate columns keep the distribution function from being repeated per Greek
    staged = (
        chain.withColumn("_d1", _d1(s, k, t, r, v, q))
        .withColumns({"_x1": _sign(kind_) * F.col("_d1"), "_x2": _sign(kind_) * (F.col("_d1") - v * F.sqrt(t))})
        .withColumns({"_n1": norm_cdf(F.col("_x1")), "_n2": norm_cdf(F.col("_x2"))})
    )
    n1, n2 = F.col("_n1"), F.col("_n2")
    out = staged.withColumns(
        {"model_price": _value(*args, n1, n2), **_greeks(*args, F.col("_d1"), n1, n2)}
    )
    return out.drop("_d1", "_x1", "_x2", "_n1", "_n2")
