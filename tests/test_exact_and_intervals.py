"""Exact indices whatever way pairs are spread, and interval joins without nested loops, against brute force."""

import datetime as dt
import random
import time
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from plinth.operators import exact, index, intervals, reports


def level_by_hand(pairs):
    """The group at once: logarithms of 34 digits, added up exactly."""
    ctx, wide = Context(prec=34, rounding=ROUND_HALF_EVEN), Context(prec=200)
    total = Decimal(0)
    for now, then in pairs:
        total = wide.add(total, ctx.ln(ctx.divide(now, then)))
    mean = ctx.divide(total, Decimal(len(pairs)))
    return ctx.multiply(Decimal(100), ctx.exp(mean)).quantize(Decimal("1e-8"), context=ctx), mean.quantize(Decimal("1e-12"), context=ctx)


@pytest.mark.parametrize("rows_a_batch", [3, 10_000])
def test_exact_levels_are_those_of_the_whole_group(spark, rows_a_batch):
    rng = random.Random(5)
    cents = lambda: Decimal(rng.choice([rng.randint(1, 10**9), rng.randint(400_000, 500_000)])).scaleb(-2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(1, 3), cents(), cents()) for _ in range(900)] + [("same", 1, Decimal("5.00"), Decimal("5.00")), ("none", 1, Decimal("0.00"), Decimal("1.00"))]
    df = spark.createDataFrame(rows, "cell string, year int, current_price decimal(12,2), base_price decimal(12,2)").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows_a_batch)
    try:
        got = {(r["cell"], r["year"]): (r["level"], r["mean_log"], r["n_pairs"]) for r in exact.jevons_exact(df, ["cell", "year"]).collect()}
    finally:
        spark.conf.set(name, before)
    groups = {}
    for c, y, now, then in rows:
        if now > 0 and then > 0:
            groups.setdefault((c, y), []).append((now, then))
    assert got == {k: (*level_by_hand(v), len(v)) for k, v in groups.items()}
    assert exact.jevons_exact(df, ["cell", "year"], min_pairs=2).where("cell = 'same'").first()["level"] is None


def test_a_cell_of_a_million_pairs(spark):
    """One cell holds all pairs; they are a hundred relatives, so the exact level is known."""
    rows = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("cell"), (F.col("id") % 100 + 950).cast("decimal(12,2)").alias("current_price"), F.lit(1000).cast("decimal(12,2)").alias("base_price"))
    began = time.perf_counter()
    r = exact.jevons_exact(rows, ["cell"]).first()
    assert (r["level"], r["mean_log"]) == level_by_hand([(Decimal(950 + i), Decimal(1000)) for i in range(100)]) and r["n_pairs"] == 1_000_000
    assert time.perf_counter() - began < 120


def test_exact_national_shares_are_half_even(spark):
    rng = random.Random(6)
    levels = [(w, f"r{i}", None if rng.random() < 0.2 else Decimal(rng.randint(1, 10**11)).scaleb(-8)) for w in range(6) for i in range(9)] + [(9, "r1", None), (10, "unknown", Decimal(100))]
    weights = [(f"r{i}", rng.choice([Decimal("0.1"), Decimal("0.25"), Decimal(rng.randint(1, 10**9)).scaleb(-10)])) for i in range(9)]
    out = exact.laspeyres_exact(spark.createDataFrame(levels, "w int, route string, level decimal(20,8)"), spark.createDataFrame(weights, "route string, share decimal(12,10)"), ["w"], "route")
    got, shares, ctx = {r["w"]: (r["level"], r["coverage"], r["n_included"]) for r in out.collect()}, dict(weights), Context(prec=60, rounding=ROUND_HALF_EVEN)
    for w in {x for x, *_ in levels}:
        own = [(shares[r], v) for x, r, v in levels if x == w and v is not None and r in shares]
        covered = sum((s for s, _ in own), Decimal(0))
        want = sum((ctx.multiply(ctx.divide(s, covered).quantize(Decimal("1e-10"), context=ctx), v) for s, v in own), Decimal(0)).quantize(Decimal("1e-8"), context=ctx) if own else None
        assert got[w] == (want, covered, len(own))
    assert "Nested" not in out._jdf.queryExecution().executedPlan().toString()


def day(n):
    return None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("bins", [1, 3, 256])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_contained_against_brute_force(spark, bins, how):
    rng = random.Random(9)
    points = [(i, day(rng.choice([None, rng.randint(-20, 400)]) if i % 10 == 0 else rng.randint(0, 300))) for i in range(60)]
    spans = [(j, day(None if j == 7 else rng.randint(-50, 350)), day(rng.choice([None, rng.randint(-60, 420)]))) for j in range(40)] + [(40, day(5), day(5)), (41, day(9), day(3)), (42, day(-900), day(9000))]
    p, s = spark.createDataFrame(points, "p int, d date"), spark.createDataFrame(spans, "s int, lo date, hi date")
    out = intervals.contained(p, "d", s, "lo", "hi", how, bins)
    pairs = [(i, j) for i, d in points for j, lo, hi in spans if d is not None and lo is not None and lo <= d and (hi is None or hi > d)]
    if how == "left":
        pairs += [(i, None) for i, _ in points if i not in {x for x, _ in pairs}]
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted([(r["p"], r["s"]) for r in out.collect()], key=key) == sorted(pairs, key=key)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.contained(p.where("p < 0"), "d", s, "lo", "hi", how, bins).isEmpty()


def test_versions_and_weights_in_force(spark):
    rng = random.Random(4)
    versions = [(f"{v}", day(rng.randint(0, 60))) for v in range(30)] + [("9x", None)]
    days = [(day(n),) for n in range(-5, 80)]
    got = {r["day"]: r["version"] for r in reports.in_force(spark.createDataFrame(versions, "version string, effective_from date"), spark.createDataFrame(days, "day date")).collect()}
    for (d,) in days:
        known = [(since, v) for v, since in versions if since is not None and since <= d]
        assert got[d] == (max(known)[1] if known else None)
    weights = spark.createDataFrame([("a", day(0), day(10)), ("b", day(10), None), ("a", day(5), day(30))], "route string, valid_from date, valid_to date")
    assert sorted((r["day"].day, r["route"]) for r in index.weights_in_force(weights, spark.createDataFrame([(day(0),), (day(9),), (day(10),)], "day date")).collect()) == [(1, "a"), (10, "a"), (10, "a"), (11, "a"), (11, "b")]


def test_equal_pairs_have_one_logarithm(spark):
    """Their level is as if each was taken, and what goes to Python is counted."""
    rows = [("c", 1999, 10.0, 9.5)] * 500 + [("c", 1999, 7.0, 9.0)] * 3 + [("c", 1998, 10.0, 9.5)] * 2
    out = exact.jevons_exact(spark.createDataFrame(rows, "cell string, year int, current_price double, base_price double").repartition(3), ["cell", "year"])
    got = {r["year"]: (r["level"], r["n_pairs"]) for r in out.collect()}
    with localcontext() as ctx:
        ctx.prec = 50
        mean = (500 * (Decimal(10) / Decimal("9.5")).ln() + 3 * (Decimal(7) / Decimal(9)).ln()) / 503
        assert got[1999] == ((100 * mean.exp()).quantize(Decimal("1e-8")), 503)
        assert got[1998] == ((100 * Decimal(10) / Decimal("9.5")).quantize(Decimal("1e-8")), 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [cell" in plan[plan.rindex("MapInArrow") :]
