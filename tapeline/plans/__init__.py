"""Registered queries."""

from tapeline.plans import (  # noqa: F401
    books,
    chainq,
    derivs,
    lakeq,
    market,
    refdata,
    streams,
    vendorq,
)
from tapeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
