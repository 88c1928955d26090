"""Price index numbers: geometric means, matched pairs, trimmed elementary indices, Laspeyres aggregates, growth, chains.

All operators work on whole sets of cells at once: keys are column names, and every cell of every period is in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.rounding import GROWTH_DP, LEVEL_DP, PRICE_DP, SHARE_DP, half_even
from plinth.operators.intervals import contained


def geomean(value: Column) -> Column:
    """exp(mean(ln v)) over positive values; null where there are none."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value.cast("double")))))


def item_prices(rows: DataFrame, keys: list[str], price: str = "total") -> DataFrame:
    """One price an item: the geometric mean of its positive prices, half-even to cents."""
    return rows.where(F.col(price) > 0).groupBy(*keys).agg(half_even(geomean(F.col(price)), PRICE_DP).alias("price"), F.count("*").alias("n_observations"))


def matched_pairs(current: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Items with a price in both periods and a positive base price."""
    left = current.select(*[c for c in current.columns if c not in ("price", "n_observations")], F.col("price").alias("current_price"))
    return left.join(base.where("price > 0").select(*on, F.col("price").alias("base_price")), on)


def trimmed(pairs: DataFrame, cell: list[str], item: str, fraction: float, min_pairs: int) -> DataFrame:
    """Pairs with their log relative, without the floor(n * fraction) lowest and highest of each cell of enough pairs.

    Pairs of no positive price are left out first (n_rejected has their number in each row of the cell).
    """
    positive = (F.col("current_price") > 0) & (F.col("base_price") > 0)
    logs = pairs.withColumn("log_relative", F.when(positive, F.ln(F.col("current_price") / F.col("base_price"))))
    whole = Window.partitionBy(*cell)
    ranked = logs.withColumns({"n": F.count("log_relative").over(whole), "n_rejected": F.count(F.when(F.col("log_relative").isNull(), 1)).over(whole)}).where("log_relative is not null")
    ranked = ranked.withColumn("place", F.row_number().over(whole.orderBy("log_relative", item)))
    cut = F.floor(F.col("n") * F.lit(fraction))
    cut = F.when((F.col("n") < min_pairs) | (F.col("n") - 2 * cut < 1), F.lit(0)).otherwise(cut)
    return ranked.withColumn("cut", cut).where((F.col("place") > F.col("cut")) & (F.col("place") <= F.col("n") - F.col("cut")))


def jevons(pairs: DataFrame, cell: list[str], item: str, fraction: float = 0.02, min_pairs: int = 5, base: float = 100.0) -> DataFrame:
    """Elementary index of each cell: level (null where fewer than min_pairs pairs are left), mean log, and counts."""
    kept = trimmed(pairs, cell, item, fraction, min_pairs)
    mean = F.avg("log_relative")
    enough = F.count("*") >= min_pairs
    return kept.groupBy(*cell).agg(
        F.when(enough, half_even(base * F.exp(mean), LEVEL_DP)).alias("level"),
        half_even(mean, 12).alias("mean_log"),
        F.count("*").alias("n_pairs"),
        (2 * F.max("cut")).alias("n_trimmed"),
        F.max("n_rejected").alias("n_rejected"),
        enough.alias("is_computable"),
    )


def shares(weights: DataFrame, by: list[str], quantity: str = "passengers", places: int = SHARE_DP) -> DataFrame:
    """weights with share: each row's part of its group's total, or equal shares where the total is not positive."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.sum(quantity).over(whole)
    return weights.withColumn("share", half_even(F.when(total > 0, F.col(quantity) / total).otherwise(1 / F.count("*").over(whole)), places))


def weights_in_force(weights: DataFrame, days: DataFrame) -> DataFrame:
    """For each day the weight rows of half-open validity [valid_from, valid_to); an open end is null."""
    return contained(days, "day", weights, "valid_from", "valid_to")


def overlapping_weights(weights: DataFrame, by: list[str]) -> DataFrame:
    """Versions that begin before some version before them (in the order of their starts, then ends) has ended."""
    order = Window.partitionBy(*by).orderBy("valid_from", F.col("valid_to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in ("latest", "open") if c in weights.columns]
    if names:
        raise ValueError(f"weights have columns that are needed here: {names}")
    ends = weights.withColumns({"latest": F.max("valid_to").over(order), "open": F.coalesce(F.bool_or(F.col("valid_to").isNull()).over(order), F.lit(False))})
    return ends.where("open or latest > valid_from").drop("latest", "open")


def laspeyres(elementary: DataFrame, weights: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Contribution of each unit with a share in each group: share, level, effective weight and contribution.

    Units without a computable level are excluded, with a reason, and their share goes to the others in proportion.
    """
    groups = elementary.select(*by).distinct()
    shared = [c for c in by if c in weights.columns]
    frame = groups.join(weights.select(*shared, unit, "share"), shared) if shared else groups.crossJoin(weights.select(unit, "share"))
    joined = frame.join(elementary.select(*by, unit, "level", "n_pairs", "is_computable"), [*by, unit], "left")
    included = F.coalesce("is_computable", F.lit(False))
    total = F.sum(F.when(included, F.col("share"))).over(Window.partitionBy(*by))
    effective = F.when(included & (total > 0), half_even(F.col("share") / total, SHARE_DP))
    return joined.withColumns({
        "included": included,
        "effective_weight": effective,
        "contribution": half_even(effective * F.col("level"), LEVEL_DP),
        "exclusion": F.when(F.col("is_computable").isNull(), "no elementary index").when(~included, "too few pairs"),
    })


def headline(contributions: DataFrame, by: list[str]) -> DataFrame:
    """The aggregate of each group: level, coverage (the included shares) and counts."""
    return contributions.groupBy(*by).agg(
        half_even(F.sum(F.col("effective_weight") * F.col("level")), LEVEL_DP).alias("level"),
        half_even(F.coalesce(F.sum(F.when(F.col("included"), F.col("share"))), F.lit(0.0)), SHARE_DP).alias("coverage"),
        F.count(F.when(F.col("included"), 1)).alias("n_included"),
        F.count(F.when(~F.col("included"), 1)).alias("n_excluded"),
        F.sum("n_pairs").alias("n_pairs"),
    )


def laspeyres_direct(base: DataFrame, current: DataFrame, quantities: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """100 * sum(p_t q_0) / sum(p_0 q_0) over the items of all three inputs; null where the base value isn't positive."""
    pairs = matched_pairs(current, base, on).join(quantities, on)
    now, then = F.sum(F.col("current_price") * F.col("quantity")), F.sum(F.col("base_price") * F.col("quantity"))
    return pairs.groupBy(*by).agg(F.when(then > 0, half_even(100 * now / then, LEVEL_DP)).alias("level"), F.count("*").alias("n_items"))


def chained(series: DataFrame, by: list[str], order: str, link: str = "relative", base: float = 100.0) -> DataFrame:
    """series with level: the running product of links, from base."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("level", half_even(base * F.exp(F.sum(F.ln(link)).over(run)), LEVEL_DP))


def growth(series: DataFrame, by: list[str], day: str, value: str, lags: dict[str, int]) -> DataFrame:
    """Percent growth against the value exactly so many days before, per named lag; null over gaps."""
    number = F.datediff(day, F.lit("1970-01-01"))
    out = series.withColumn("_day", number)
    for name, back in lags.items():
        then = F.max(value).over(Window.partitionBy(*by).orderBy("_day").rangeBetween(-back, -back))
        out = out.withColumn(name, F.when(then > 0, half_even((F.col(value) / then - 1) * 100, GROWTH_DP)))
    return out.drop("_day")


def publishable(level: Column, coverage: Column, least: float) -> tuple[Column, Column]:
    """Whether a value is published, and otherwise why not."""
    reason = F.when(level.isNull() | (level <= 0), "no computable level").when(coverage < least, F.concat(F.lit("coverage "), F.format_number(coverage * 100, 1), F.lit(f"% below {least * 100:.1f}%")))
    return reason.isNull(), reason
