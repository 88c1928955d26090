"""Robust outlier screening: medians, MAD, modified z-scores in log or linear space, and a cap on what is flagged."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.rounding import SCORE_DP, half_even
from plinth.lineage import written

#: Scale constants: the normal's upper quartile, and the square root of pi / 2 as rounded there: fixed values.
MAD_SCALE, MEAN_SCALE = 0.6745, 1.253314
THRESHOLD, MIN_SAMPLES, CAP = 3.5, 5, 0.25


#: Slots a unit of log1p: only how finely ranks are sought, never what is found.
SLOTS = 1024


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, x (value as a double) and k: how often each value occurs. Partial counts leave little of a hot group to shuffle."""
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull()).groupBy(*by, x.alias("x")).agg(F.count("*").alias("k"))


def _of_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A null-safe join that keeps left's keys."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    joined = left.join(named, reduce(and_, [left[c].eqNullSafe(named[f"_of_{c}"]) for c in on]), how)
    return joined.drop(*[f"_of_{c}" for c in on])


def quantiles_of_counts(counts: DataFrame, by: list[str], value: str, weight: str, at: dict[str, float]) -> DataFrame:
    """by, n, mean and one exact quantile (linear between ranks) for each name of at, over values with weights.

    No group is ever in one task: values fall into slots in their order, the slots' sums say which ones hold the wanted ranks,
    and only those slots' values are put in order, slot by slot. NaN is the highest value.
    """
    x = F.col(value)
    slot = F.when(F.isnan(x), F.lit(2**62)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * SLOTS).cast("long"))
    placed = counts.select(*(by or [F.lit(0).alias("_all")]), x.alias("_v"), F.col(weight).alias("_k"), slot.alias("_slot"))
    keys = by or ["_all"]
    slots = placed.groupBy(*keys, "_slot").agg(F.sum("_k").alias("_inside"), F.sum(F.col("_v") * F.col("_k")).alias("_sum"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumns({"n": F.sum("_inside").over(whole), "mean": F.sum("_sum").over(whole) / F.sum("_inside").over(whole), "_before": F.coalesce(F.sum("_inside").over(before), F.lit(0))})
    rank = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in at.items()}
    ranks = F.array_distinct(F.array(*[f(r).cast("long") for r in rank.values() for f in (F.floor, F.ceil)]))
    slots = slots.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_inside")))).where(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = _of_same(placed, slots.drop("_inside", "_sum"), [*keys, "_slot"])
    near = near.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_k").over(inside), F.lit(0)))
    hit = near.select(*keys, "n", "mean", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_k")))).alias("_rank"))
    found = hit.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(r: Column) -> Column:
        low, high = F.floor(r).cast("long"), F.ceil(r).cast("long")
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when(a.eqNullSafe(b), a).otherwise((high - r) * a + (r - low) * b)

    return found.select(*by, "n", "mean", *[between(r).alias(name) for name, r in rank.items()])


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of a column by group; nulls are left out, a group of nulls alone has no row."""
    return quantiles_of_counts(value_counts(rows, by, value), by, "x", "k", at)


def median_by_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median without leaving decimals: the mean of the two middle ranks."""
    whole = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(whole.orderBy(value)).alias("r"), F.count("*").over(whole).alias("n"))
    return ranked.where("r in ((n + 1) div 2, (n + 2) div 2)").groupBy(*by).agg(F.avg(value).alias("median"))


#: Different values of a stratum that one task may hold as an exact percentile's counts: some 100 MB.
ONE_TASK = 1 << 20


def centres(rows: DataFrame, by: list[str], value: str, log: bool | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Per stratum: n, whether logs are used (only where all values are positive), median, MAD and mean deviation; all exact.

    Rows are read once, into counts of values, which are written once (see lineage.written). Where no stratum has more than one_task
    different values, two aggregates of exact percentiles over those counts find them, with a stratum's counts in one task at most.
    Beyond that no stratum is ever in one task: see spread_centres().
    """
    counts = written(value_counts(rows, by, value))
    most = counts.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is not None and most > one_task:
        return spread_centres(counts, by, log)
    uses = F.min("x") > 0 if log is None or log else F.lit(False)
    half = F.lit(0.5)
    mid = counts.groupBy(*by).agg(F.sum("k").alias("n"), uses.alias("uses_log"), F.percentile("x", half, F.col("k")).alias("_plain"), F.percentile(F.ln("x"), half, F.col("k")).alias("_log"))
    mid = mid.select(*by, "n", "uses_log", F.when(F.col("uses_log"), F.col("_log")).otherwise(F.col("_plain")).alias("centre"))
    off = F.abs(F.when(F.col("uses_log"), F.ln("x")).otherwise(F.col("x")) - F.col("centre"))
    return counts.join(mid, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "uses_log", "centre")], F.percentile(off, half, F.col("k")).alias("mad"), (F.sum(off * F.col("k")) / F.sum("k")).alias("mean_deviation"))


def spread_centres(counts: DataFrame, by: list[str], log: bool | None = None) -> DataFrame:
    """As centres(), over counts of values (see value_counts()), whatever a stratum's size: none is sorted in one task.

    Deviations are used several times, so they are written once, where a plan of all would make them again and again.
    """
    if log is None or log:
        level = counts.groupBy(*by).agg((F.min("x") > 0).alias("uses_log"))
        work = counts.join(level, by).select(*by, "uses_log", F.when(F.col("uses_log"), F.ln("x")).otherwise(F.col("x")).alias("w"), "k")
    else:
        work = counts.select(*by, F.lit(False).alias("uses_log"), F.col("x").alias("w"), "k")
    mid = quantiles_of_counts(work, [*by, "uses_log"], "w", "k", {"centre": 0.5}).drop("n", "mean", "uses_log")
    off = written(work.join(mid, by).select(*by, "uses_log", "centre", F.abs(F.col("w") - F.col("centre")).alias("d"), "k"))
    scale = quantiles_of_counts(off, [*by, "uses_log", "centre"], "d", "k", {"mad": 0.5})
    return scale.select(*by, "n", "uses_log", "centre", "mad", F.col("mean").alias("mean_deviation"))


def scored(rows: DataFrame, by: list[str], value: str, log: bool | None = None) -> DataFrame:
    """rows with n, uses_log, centre, method, scale and score. Small strata and equal values score 0.

    Centres are written first, so their size is known when the join is planned: rows are not shuffled for a few strata.
    """
    c = written(centres(rows, by, value, log))
    joined = rows.join(c, by, "left")
    x = F.col(value).cast("double")
    w = F.when(F.col("uses_log"), F.ln(x)).otherwise(x)
    method = F.when(F.coalesce("n", F.lit(0)) < MIN_SAMPLES, "INSUFFICIENT_DATA").when(F.col("mad") > 0, "MODIFIED_Z_MAD").when(F.col("mean_deviation") > 0, "MODIFIED_Z_MEANAD").otherwise("DEGENERATE_ZERO_SCALE")
    joined = joined.withColumn("method", method)
    score = F.when(F.col("method") == "MODIFIED_Z_MAD", (w - F.col("centre")) * MAD_SCALE / F.col("mad")).when(F.col("method") == "MODIFIED_Z_MEANAD", (w - F.col("centre")) / (MEAN_SCALE * F.col("mean_deviation"))).otherwise(0.0)
    scale = F.when(F.col("method") == "MODIFIED_Z_MAD", F.col("mad")).when(F.col("method") == "MODIFIED_Z_MEANAD", F.col("mean_deviation"))
    return joined.withColumns({"score": F.when(x.isNotNull(), half_even(score, SCORE_DP)), "scale": scale})


def flagged(scores: DataFrame, by: list[str], tie: str, threshold: float = THRESHOLD, cap: float = CAP) -> DataFrame:
    """scores with is_outlier: beyond the threshold, and among the max(floor(n * cap), 1) largest of the stratum.

    Only rows beyond the threshold are ranked; of all others the sort sees no key. Where outliers alone are wanted, pass those rows
    alone (see outliers()); for their number see screening().
    """
    beyond = F.coalesce(F.abs("score") > threshold, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*by, beyond).orderBy(F.when(beyond, F.abs("score")).desc(), F.when(beyond, F.col(tie))))
    return scores.withColumn("is_outlier", beyond & (rank <= _most(cap)))


def capped(scores: DataFrame, by: list[str], tie: str, threshold: float = THRESHOLD, cap: float = CAP) -> DataFrame:
    """As flagged(), where tie differs among a stratum's rows beyond the threshold. Those alone are ranked, and scores are not shuffled.

    Of each stratum that has more of them than may be flagged, the last one that may is found and written first (see lineage.written).
    """
    size, beyond = F.abs("score"), F.coalesce(F.abs("score") > threshold, F.lit(False))
    whole = Window.partitionBy(*by)
    ranked = scores.where(beyond).select(*by, "n", size.alias("_least"), F.col(tie).alias("_tie")).withColumns({"_rank": F.row_number().over(whole.orderBy(F.col("_least").desc(), "_tie")), "_beyond": F.count("*").over(whole)})
    last = written(ranked.where((F.col("_beyond") > _most(cap)) & (F.col("_rank") == _most(cap))).select(*by, "_least", "_tie"))
    within = F.col("_least").isNull() | (size > F.col("_least")) | ((size == F.col("_least")) & (F.col(tie) <= F.col("_tie")))
    return scores.join(last, by, "left").withColumn("is_outlier", beyond & within).drop("_least", "_tie")


def _most(cap: float) -> Column:
    """How many of a stratum may be flagged."""
    return F.greatest(F.floor(F.col("n") * cap), F.lit(1))


def outliers(scores: DataFrame, by: list[str], tie: str, threshold: float = THRESHOLD, cap: float = CAP) -> DataFrame:
    """The rows that flagged() marks: rows beyond the threshold alone are shuffled and sorted."""
    return flagged(scores.where(F.abs("score") > threshold), by, tie, threshold, cap).where("is_outlier")


def screening(scores: DataFrame, by: list[str], threshold: float = THRESHOLD, cap: float = CAP) -> DataFrame:
    """report() of flagged(), by numbers alone: as many are flagged as are beyond the threshold, up to the cap. Nothing is ranked."""
    cols = [F.max(c).alias(c) for c in ("n", "method", "uses_log", "centre", "scale")]
    counts = scores.groupBy(*by).agg(*cols, F.count("*").alias("_rows"), F.count_if(F.abs("score") > threshold).alias("_beyond"))
    counts = counts.withColumn("n_outliers", F.least("_beyond", _most(cap)).cast("long"))
    return counts.withColumn("contamination", half_even(F.col("n_outliers") / F.col("_rows"), 4)).drop("_rows", "_beyond")


def report(flags: DataFrame, by: list[str]) -> DataFrame:
    """Per stratum: n, method, centre, scale, log space, outliers and their share."""
    return flags.groupBy(*by).agg(F.max("n").alias("n"), F.max("method").alias("method"), F.max("uses_log").alias("uses_log"), F.max("centre").alias("centre"), F.max("scale").alias("scale"), F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"), half_even(F.avg(F.col("is_outlier").cast("int")), 4).alias("contamination"))
