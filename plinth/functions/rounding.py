"""Rounding: money is half-up, statistics are half-even, each at a stated number of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places of statistics: fixed values.
PRICE_DP, LEVEL_DP, SHARE_DP, GROWTH_DP, SCORE_DP = 2, 8, 10, 6, 6


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def money(c: Column) -> Column:
    """decimal(12,2), half-up; what doesn't fit is null."""
    return F.round(c, 2).try_cast("decimal(12,2)")
