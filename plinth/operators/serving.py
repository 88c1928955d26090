"""Reads on top: filter sets, series, latest prints, summaries, lead-time curves, paging."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.rounding import half_even
from plinth.operators.index import geomean
from plinth.operators.robust import quantiles

GRADES = ("A", "B")
PAGE, PAGE_MOST = 100, 1000


def eligible(total: str = "total", duplicate: str = "is_duplicate", outlier: str = "is_outlier", grade: str = "quality_grade", flags: str | None = None) -> Column:
    """What may enter an index: a surviving, priced row of grade A or B that is neither an outlier nor modelled."""
    out = F.col(total).isNotNull() & (F.col(total) > 0) & ~F.col(duplicate) & F.col(grade).isin(*GRADES) & ~F.col(outlier)
    return out & ~F.array_contains(flags, "MODELLED") if flags else out


#: How a filter's name ends, and its test on a column.
TESTS = {
    "iexact": lambda c, v: F.lower(c) == str(v).lower(),
    "in": lambda c, v: c.isin(*v),
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "nonempty": lambda c, v: (c != "") if v else (c == ""),
    "exact": lambda c, v: c.eqNullSafe(F.lit(v)),
}


def filtered(rows: DataFrame, wanted: Mapping[str, Any], allowed: Mapping[str, Column] | None = None) -> DataFrame:
    """rows that pass all of wanted: {column__test: value}, a bare column being exact. Unknown names raise ValueError."""
    tests = []
    for name, value in wanted.items():
        column, _, test = name.partition("__")
        known = allowed.get(column) if allowed else (F.col(column) if column in rows.columns else None)
        if known is None or (test or "exact") not in TESTS:
            raise ValueError(f"no such filter: {name}")
        tests.append(TESTS[test or "exact"](known, value))
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def visible(series: DataFrame, role: str, published: str = "is_published") -> DataFrame:
    """What a role may read: only the statistics office sees what is not published. Applied before users' filters."""
    return series if role in ("nso", "admin") else series.where(F.col(published))


def ordered(rows: DataFrame, ordering: str, allowed: tuple[str, ...]) -> DataFrame:
    """rows in the order of a text like '-observed_at,route'; names outside the list raise ValueError."""
    keys = []
    for name in filter(None, ordering.split(",")):
        if name.lstrip("-") not in allowed:
            raise ValueError(f"cannot order by {name}")
        keys.append(F.col(name.lstrip("-")).desc() if name[0] == "-" else F.col(name).asc())
    return rows.orderBy(*keys)


def keyset_page(rows: DataFrame, order: str, key: str, after: tuple[Any, Any] | None = None, size: int = PAGE) -> DataFrame:
    """The page after a cursor (order value, key; values or columns), newest first: a top-k, whatever the depth of the page."""
    if after is not None:
        rows = rows.where((F.col(order) < F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.col(order).desc(), F.col(key).desc()).limit(min(size, PAGE_MOST))


def numbered_page(rows: DataFrame, order: list[Column], number: int, size: int = 500) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * min(size, 5000)).limit(min(size, 5000))


def summary(rows: DataFrame, total: str = "total", marks: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: counts, lowest, highest and exact median price, and for each name of marks how many rows it holds for."""
    priced = F.col(total).isNotNull()
    extra = [F.count_if(test).alias(name) for name, test in (marks or {}).items()]
    counted = rows.agg(F.count("*").alias("n"), F.count_if(priced).alias("n_priced"), F.count_if(~priced).alias("n_unpriced"), *extra, F.min(total).cast("double").alias("lowest"), F.max(total).cast("double").alias("highest"))
    middle = quantiles(rows, [], total, {"median": 0.5}).select(half_even(F.col("median"), 2).alias("median"), F.lit(0).alias("_one"))
    return counted.withColumn("_one", F.lit(0)).join(middle, "_one", "left").drop("_one")


def latest(series: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group, by one aggregation."""
    rest = [c for c in series.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return series.groupBy(*by).agg(newest.alias("x")).select(*by, *[F.col(f"x.{c}").alias(c) for c in rest])


def lead_time_curve(rows: DataFrame, window: str, total: str = "total", sold_out: str = "is_sold_out") -> DataFrame:
    """Per lead window: count, exact quartiles (linear), geometric mean and sold-out share."""
    out = rows.groupBy(window).agg(F.count(total).alias("n"), half_even(geomean(F.col(total)), 4).alias("geomean"), half_even(F.avg(F.col(sold_out).cast("int")), 4).alias("sold_out_share"))
    quarters = quantiles(rows, [window], total, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n", "mean").withColumnRenamed(window, "_window")
    joined = out.join(quarters, out[window].eqNullSafe(quarters["_window"]), "left")
    return joined.select(window, "n", *[half_even(F.col(q), 4).alias(q) for q in ("p25", "p50", "p75")], "geomean", "sold_out_share")


def top_by(rows: DataFrame, by: list[str], score: Column, tie: str, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), tie))).where(F.col("place") <= k)


def unknown_codes(requested: DataFrame, known: DataFrame, code: str) -> DataFrame:
    return requested.select(code).subtract(known.select(code))


def collection_plan(sources: DataFrame, routes: DataFrame, windows: DataFrame, bound: int = 10_000_000) -> DataFrame:
    """Every source for every route and window. The three inputs are dimensions; their product is checked against bound."""
    product = sources.count() * routes.count() * windows.count()
    if product > bound:
        raise ValueError(f"the plan would have {product} tasks; the bound is {bound}")
    return sources.crossJoin(routes).crossJoin(windows)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row: decimals as texts, nulls kept."""
    cols = [F.col(n).cast("string").alias(n) if t.startswith("decimal") else F.col(n) for n, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
