"""Bit operations on ids and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def trailing_zeros(x: Column) -> Column:
    """64 for zero."""
    return F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1))


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is at least x; 1 for what is under 1."""
    y = F.greatest(x.cast("long"), F.lit(1)) - 1
    for k in (1, 2, 4, 8, 16, 32):
        y = y.bitwiseOR(F.shiftrightunsigned(y, k))
    return y + 1
