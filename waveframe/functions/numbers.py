"""Rounding of doubles to decimal places by their exact value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^27 + 1, which splits a double into halves whose products are exact.
SPLITTER = 134217729.0
MOST_PLACES = 15


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * F.lit(SPLITTER)
    high = big - (big - x)
    return high, x - high


def round_exact(x: Column, places: int) -> Column:
    """The double nearest to x's exact value rounded to `places` decimals, exact ties to even; null, NaN and infinities stay.

    x times the power of ten is had as a product and its error, which are exact together, so that what is
    beyond the half is known exactly; beyond 2^53 steps a double has no such decimals and stays as it is.
    """
    if not 0 <= places <= MOST_PLACES:
        raise ValueError(f"places are 0 to {MOST_PLACES}")
    scale = 10.0**places
    size = F.abs(x.cast("double"))
    inside = F.when(size * F.lit(scale) < float(1 << 53), size)  # null beyond, and of NaN
    product = inside * F.lit(scale)
    high, low = _halves(inside)
    top = SPLITTER * scale - (SPLITTER * scale - scale)
    rest = scale - top
    error = ((high * F.lit(top) - product) + high * F.lit(rest) + low * F.lit(top)) + low * F.lit(rest)
    down = F.floor(product).cast("double")
    whole = down - F.when((product == down) & (error < 0), 1.0).otherwise(0.0)
    beyond = (product - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    return F.when(rounded.isNull() | (x == 0), x.cast("double")).otherwise(F.when(x < 0, -rounded).otherwise(rounded))
