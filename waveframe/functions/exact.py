"""Sums of doubles that are exact until they are rounded once, whatever the order or the partitions.

A double is a whole number of 53 bits times a power of two. The whole numbers are summed for each
exponent, in two halves so that no sum of a chunk leaves 53 bits; such parts add up as integers in any order.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np

HALF = 27


def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponents, high halves, low halves) of the sum of x, which has 2^25 finite values at most."""
    fraction, exponent = np.frexp(x)
    whole = np.ldexp(fraction, 53).astype(np.int64)
    held, place = np.unique(exponent, return_inverse=True)
    high, low = whole >> HALF, whole & ((1 << HALF) - 1)
    return held.astype(np.int32), *(np.bincount(place, part, len(held)).astype(np.int64) for part in (high, low))


def total(exponents: Iterable[int], high: Iterable, low: Iterable) -> float:
    """The sum of such parts, rounded to the nearest double; infinite if it is beyond all."""
    found = [(int(e), (int(h) << HALF) + int(w)) for e, h, w in zip(exponents, high, low, strict=True)]
    least = min((e for e, _ in found), default=0)
    whole = sum(m << (e - least) for e, m in found)
    try:
        return float(Fraction(whole) * Fraction(2) ** (least - 53))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")
