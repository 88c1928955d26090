"""Reports kept up as data arrives: daily partials that are appended or restated, and finished on reading.

A partial says how often each value occurs on a day, by the report's keys and marks. Partials add up, so reports over any
span of days need no row again: counts, extremes, shares and geometric means are sums over them, and quantiles stay exact
(see robust.quantiles_of_counts). What a change costs depends on the rows that it brings, never on those that are there.

The table takes several writers (see sources.commits). A commit either adds to its days or replaces them: of a day, the
newest commit that restated it and all later ones count. A commit with a token that is there already adds nothing, so
a batch that a stream hands over twice counts once.

Defined results: rows without a day are a day of their own, which can be restated like others; a null value is an unpriced row; a mark
that is null is left out of its share; a day that is restated with no rows is gone; a table without commits gives no
windows, and a summary of zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.rounding import half_even
from plinth.operators.robust import quantiles_of_counts
from plinth.sources import commits


class _Known(Exception):
    """The token is among those of the state that was read."""


@dataclass(frozen=True)
class Gold:
    """A table of partials at path: of value by day, by keys and by marks (booleans). schema has the types of all of them."""

    path: str
    schema: T.StructType
    day: str
    keys: tuple[str, ...]
    value: str
    marks: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if taken := {"_k", "_token", "_commit", "_since"} & set(self._names):
            raise ValueError(f"names that the table needs itself: {sorted(taken)}")

    @property
    def _names(self) -> list[str]:
        return [self.day, *self.keys, self.value, *self.marks]

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*[self.schema[c] for c in self._names], T.StructField("_k", T.LongType()), T.StructField("_token", T.StringType())])

    def _row(self, **given: Column) -> list[Column]:
        return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._stored.fields]

    def _commit(self, spark: SparkSession, part: DataFrame, token: str | None) -> int | None:
        def make(seen: int) -> DataFrame:
            if token is None:
                return part
            if not commits.read(spark, self.path, self._stored, seen).where(F.col("_token") == token).isEmpty():
                raise _Known
            return part.unionAll(spark.range(1).select(*self._row(_token=F.lit(token))))

        try:
            return commits.append(spark, self.path, make)
        except _Known:
            return None

    def append(self, rows: DataFrame, token: str | None = None) -> int | None:
        """Count rows in. The commit's number, or None where the token was there already."""
        return self._commit(rows.sparkSession, self._partials(rows), token)

    def restate(self, rows: DataFrame, days: DataFrame | None = None, token: str | None = None) -> int | None:
        """Put rows in the place of all that was known of days (a column of them; without it, the days that rows are of)."""
        replaced = (rows if days is None else days).select(F.col(self.day).alias("_day")).distinct()
        kept = rows if days is None else rows.join(replaced, rows[self.day].eqNullSafe(F.col("_day")), "left_semi")
        return self._commit(rows.sparkSession, self._partials(kept).unionAll(replaced.select(*self._row(**{self.day: F.col("_day")}))), token)

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: counts each batch in once, under the name of the stream and the batch's number."""

        def take(batch: DataFrame, number: int) -> None:
            self.append(batch, f"{name}-{number}")

        return take

    def _partials(self, rows: DataFrame) -> DataFrame:
        counted = rows.groupBy(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self._names]).agg(F.count("*").alias("_k"))
        return counted.select(*self._row(**{c: F.col(c) for c in [*self._names, "_k"]}))

    def partials(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The partials that count now, or as of a commit: day, keys, value, marks and _k. Filter it by day and keys for a report."""
        known = commits.read(spark, self.path, self._stored, upto, "_commit").where(F.col("_token").isNull())
        since = known.where(F.col("_k").isNull()).groupBy(F.col(self.day).alias("_day")).agg(F.max("_commit").alias("_since"))
        live = known.where(F.col("_k").isNotNull()).join(since, F.col(self.day).eqNullSafe(F.col("_day")), "left")
        return live.where(F.col("_since").isNull() | (F.col("_commit") >= F.col("_since"))).select(*self._names, "_k")

    def summary(self, partials: DataFrame) -> DataFrame:
        """One row, as serving.summary(): counts, a count n_<mark> of each mark, extremes and the exact median of the value."""
        priced = F.col(self.value).isNotNull()
        count = lambda test: F.coalesce(F.sum(F.when(test, F.col("_k"))), F.lit(0))
        marks = [count(F.col(m)).alias(f"n_{m}") for m in self.marks]
        out = partials.agg(count(F.lit(True)).alias("n"), count(priced).alias("n_priced"), count(~priced).alias("n_unpriced"), *marks, F.min(self.value).cast("double").alias("lowest"), F.max(self.value).cast("double").alias("highest"))
        middle = self._quantiles(partials, [], {"median": 0.5}).select(half_even(F.col("median"), 2).alias("median"), F.lit(0).alias("_one"))
        return out.withColumn("_one", F.lit(0)).join(middle, "_one", "left").drop("_one")

    def curve(self, partials: DataFrame, window: str, sold_out: str) -> DataFrame:
        """As serving.lead_time_curve(): per window (one of keys) count, exact quartiles, geometric mean and the share of a mark."""
        x, k, sold = F.col(self.value).cast("double"), F.col("_k"), F.col(sold_out)
        logs = F.sum(F.when(x > 0, F.ln(x) * k)) / F.sum(F.when(x > 0, k))
        share = F.sum(F.when(sold, k).when(~sold, F.lit(0))) / F.sum(F.when(sold.isNotNull(), k))
        out = partials.groupBy(window).agg(F.coalesce(F.sum(F.when(x.isNotNull(), k)), F.lit(0)).alias("n"), half_even(F.exp(logs), 4).alias("geomean"), half_even(share, 4).alias("sold_out_share"))
        quarters = self._quantiles(partials, [window], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n", "mean").withColumnRenamed(window, "_window")
        joined = out.join(quarters, out[window].eqNullSafe(quarters["_window"]), "left")
        return joined.select(window, "n", *[half_even(F.col(q), 4).alias(q) for q in ("p25", "p50", "p75")], "geomean", "sold_out_share")

    def _quantiles(self, partials: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
        counts = partials.where(F.col(self.value).isNotNull()).groupBy(*by, F.col(self.value).cast("double").alias("_x")).agg(F.sum("_k").alias("_n"))
        return quantiles_of_counts(counts, by, "_x", "_n", at)
