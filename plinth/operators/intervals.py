"""Joins of points with half-open intervals, by bins: an equi-join, where a condition alone would be a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins over the range of the points. An interval is in so many rows at most; a bin's points meet the intervals that touch it.
BINS = 256


def contained(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, how: str = "inner", bins: int = BINS) -> DataFrame:
    """points joined with the intervals [start, end) that contain them; all are dates.

    An end that is null is open, a null start or point is in nothing. Intervals may overlap, nest, be empty or repeat; each pair comes
    once. how: inner, or left for points that are in none as well. The two sides share no column name.
    """
    if shared := set(points.columns) & set(intervals.columns):
        raise ValueError(f"both sides have columns named {sorted(shared)}")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    low, high = points.agg(F.min(day(F.col(point))), F.max(day(F.col(point)))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) // bins))

    def bin_of(c: Column) -> Column:
        return F.floor((day(c) - low) / width).cast("long")

    # of an interval, only what is within the points' range is in a bin
    first = F.greatest(bin_of(F.col(start)), F.lit(0))
    last = F.least(F.coalesce(bin_of(F.date_sub(F.col(end), 1)), F.lit((high - low) // width)), F.lit((high - low) // width))
    spread = intervals.withColumn("_bin", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    placed = points.withColumn("_at", bin_of(F.col(point)))
    inside = (placed["_at"] == spread["_bin"]) & (F.col(start) <= F.col(point)) & (F.col(end).isNull() | (F.col(end) > F.col(point)))
    return placed.join(spread, inside, how).drop("_at", "_bin")
