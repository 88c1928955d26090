"""Seeding of weight sets, and what sets say of themselves."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plinth.operators import weightsets

SET = "unit string, passengers long"
DAY = date(2024, 1, 1)


def held(spark, path):
    return {(r["unit"], r["valid_from"].year): (r["passengers"], r["share"], r["reference_period"]) for r in spark.read.parquet(path).collect()}


def test_seeding_is_repeatable_and_keeps_other_days(spark, tmp_path):
    path = f"{tmp_path}/weights"
    first = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), (None, None)], SET)
    for _ in range(2):
        weightsets.seed(first, path, "unit", "passengers", DAY, "2023")
    want = {("a", 2024): (1, Decimal("0.3333333333"), "2023"), ("b", 2024): (2, Decimal("0.6666666667"), "2023"), ("c", 2024): (0, 0, "2023"), (None, 2024): (None, 0, "2023")}
    assert held(spark, path) == want
    weightsets.seed(first.where("unit in ('a', 'b')"), path, "unit", "passengers", date(2025, 1, 1), "2024")
    weightsets.seed(spark.createDataFrame([("b", 7)], SET), path, "unit", "passengers", DAY, "2023b")
    now = held(spark, path)
    assert now[("b", 2024)] == (7, 1, "2023b") and now[("a", 2024)] == want[("a", 2024)] and now[("b", 2025)] == (2, Decimal("0.6666666667"), "2024") and len(now) == 6


@pytest.mark.parametrize("rows, why", [([("a", 1), ("a", 2)], "duplicate unit"), ([(None, 1), (None, 1)], "duplicate unit"), ([("a", 0)], "zero total"), ([("a", None)], "zero total"), ([("a", -1)], "zero total"), ([], "zero total")])
def test_sets_that_are_refused(spark, tmp_path, rows, why):
    with pytest.raises(ValueError, match=why):
        weightsets.seed(spark.createDataFrame(rows, SET), f"{tmp_path}/weights", "unit", "passengers", DAY, "x")


def test_facts(spark):
    rows = spark.createDataFrame([(1, "a", 3, DAY), (1, "b", 1, DAY), (2, "a", 1, DAY), (2, "a", 1, DAY), (None, "a", 0, None)], "period int, unit string, passengers long, on date")
    got = {r["period"]: tuple(r)[1:] for r in weightsets.facts(rows, ["period"], "unit", "passengers", "on", F.lit(date(2024, 3, 1))).collect()}
    assert got == {1: (2, 4, Decimal("0.7500000000"), 60, None), 2: (2, 2, None, 60, "duplicate unit"), None: (1, 0, None, None, "zero total")}
