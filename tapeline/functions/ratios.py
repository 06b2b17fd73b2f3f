"""Financial ratios as column builders: NaN when a side is missing or the divisor is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_ratio(a: Column, b: Column) -> Column:
    """The quotient of doubles by IEEE 754: by zero an infinity or NaN; null if a side is null."""
    return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_ln(a: Column) -> Column:
    """The logarithm by IEEE 754: -inf of zero, NaN below; null if ``a`` is null."""
    below = F.when(a == 0.0, F.lit(float("-inf"))).when(a < 0.0, F.lit(float("nan")))
    return F.when(a <= 0.0, below).otherwise(F.ln(a))


def ratio(a: Column, b: Column) -> Column:
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (b != 0.0)
    return F.when(ok, F.try_divide(a, b)).otherwise(F.lit(float("nan")))


def pe_ratio(price: Column, eps: Column) -> Column:
    return ratio(price, eps)


def pb_ratio(price: Column, book_value_per_share: Column) -> Column:
    return ratio(price, book_value_per_share)


def roe(net_income: Column, book_value: Column) -> Column:
    return ratio(net_income, book_value)


def gross_margin(gross_profit: Column, revenue: Column) -> Column:
    return ratio(gross_profit, revenue)


def operating_margin(operating_income: Column, revenue: Column) -> Column:
    return ratio(operating_income, revenue)


def net_margin(net_income: Column, revenue: Column) -> Column:
    return ratio(net_income, revenue)


# output: (builder, numerator input, denominator input)
RATIOS = {
    "pe_ratio": (pe_ratio, "price", "eps"),
    "pb_ratio": (pb_ratio, "price", "book_value_per_share"),
    "roe": (roe, "net_income", "book_value"),
    "gross_margin": (gross_margin, "gross_profit", "revenue"),
    "operating_margin": (operating_margin, "operating_income", "revenue"),
    "net_margin": (net_margin, "net_income", "revenue"),
}
