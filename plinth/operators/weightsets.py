"""Weight sets: seeding a versioned set, and what a set says of itself.

Defined results: a set whose units are listed twice or whose total is not positive is refused by seed() and named in facts(); a null
quantity counts as nothing; a null unit is a unit; an empty set has no positive total.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.rounding import LEVEL_DP, SHARE_DP, half_even
from plinth.operators.index import publishable
from plinth.sources import sinks


def _share(quantity: Column, total: Column) -> Column:
    """An exact quotient of decimals, half-even to ten places."""
    return half_even(F.coalesce(quantity, F.lit(0)).cast("decimal(18,2)") / total.cast("decimal(18,2)"), SHARE_DP).cast("decimal(12,10)")


def facts(weights: DataFrame, by: list[str], unit: str, quantity: str, published_on: str, as_of: Column) -> DataFrame:
    """Per set: its units, total, largest share, days since it was published, and why it can't be used (else null)."""
    units = weights.groupBy(*by, unit).agg(F.count("*").alias("_n"), F.sum(quantity).alias("_q"), F.max(published_on).alias("_on"))
    total = F.coalesce(F.sum("_q"), F.lit(0))
    out = units.groupBy(*by).agg(F.sum("_n").alias("n_units"), total.alias("total"), F.max("_q").alias("_most"), (F.max("_n") > 1).alias("_twice"), F.max("_on").alias("_on"))
    error = F.when(F.col("_twice"), "duplicate unit").when(F.col("total") <= 0, "zero total")
    return out.select(*by, "n_units", "total", F.when(error.isNull(), _share(F.col("_most"), F.col("total"))).alias("largest_share"), F.date_diff(as_of, "_on").alias("staleness_days"), error.alias("error"))


def seed(weights: DataFrame, path: str, unit: str, quantity: str, valid_from: date, period: str) -> None:
    """Put one set in force from a day on: a row of each unit with its share, in the place of what that day had for it.

    Seeding again changes nothing but what differs, so it can be repeated; other days' sets are not touched. One writer at a time.
    """
    checked = facts(weights.withColumn("_on", F.lit(valid_from)), [], unit, quantity, "_on", F.lit(valid_from))
    found = checked.first()
    error = "zero total" if found is None else found["error"]
    if error:
        raise ValueError(f"weight set {period}: {error}")
    rows = weights.select(
        F.col(unit), F.col(quantity).cast("decimal(18,2)").alias(quantity), _share(F.col(quantity), F.lit(found["total"])).alias("share"), F.lit(period).alias("reference_period"),
        F.lit(None).cast("date").alias("valid_to"), F.lit(valid_from).alias("published_on"), F.lit(valid_from).alias("valid_from"),
    )
    sinks.upsert(rows, path, [unit, "valid_from"], [], "valid_from")


def summary(headline: DataFrame, by: list[str], least: float, **said: str) -> DataFrame:
    """What is told of each value beside it: level and coverage as plain texts, strata, pairs, whether it is published and else why not."""
    ok, reason = publishable(F.col("level"), F.col("coverage"), least)
    text = lambda c, places: F.col(c).cast(f"decimal(38,{places})").cast("string")
    return headline.select(*by, text("level", LEVEL_DP).alias("level"), text("coverage", SHARE_DP).alias("weight_coverage"), F.col("n_included").alias("strata_included"), (F.col("n_included") + F.col("n_excluded")).alias("strata_total"), F.coalesce("n_pairs", F.lit(0)).alias("pairs_used"), ok.alias("publishable"), reason.alias("suppression_reason"), *[F.lit(v).alias(k) for k, v in said.items()])
