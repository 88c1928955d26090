"""Short ways of the cleaning chain give what the long ways give, and no step of it deals payloads out by a few keys."""

import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from plinth.functions import canonical
from plinth.functions.money import MISSING, parse_all, parse_money, plain_money
from plinth.operators import audit, robust
from plinth.plans.cleaned_queries import MAPPING
from plinth.sources.payload import Mapping, extract
from plinth.streaming import cleaning

RAW = "raw_id string, source string, route string, lead_window int, captured_at timestamp, payload string"


def texts():
    rng = random.Random(5)
    pieces = ["₹", "Rs", "Rs.", "rs", "INR", "inr ", "$", "-", "--", ",", ".", " ", "1", "12", "123", "0", "00", "4521", "1,234", "12,34,567", ".50", "(", ")", "/-", "k", "lakh", "usd", "\n", "९"]
    given = ["₹ 1,234.00", "INR 12.5", "Rs. 12,34,567.89", "1,23", "12,34", "1,2345", "1,234,567", "1,234,567,890", "1234567890", "-0", "-0.00", "-500", "N/A", "Sold Out", "₹1234", "₹-5", "1.234", "1.23\n", "Rs.", "1,234.567", *MISSING, None]
    return given + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(3000)]


def test_plain_money_is_what_the_long_way_reads(spark):
    """A blank before a text changes no amount, but takes the long way."""
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    for more in ({}, {"expected": "INR"}, {"expected": "USD"}, {"allow_negative": True}):
        both = rows.select("t", parse_money(F.col("t"), **more).alias("a"), parse_money(F.concat(F.lit(" "), "t"), **more).alias("b"))
        assert [r for r in both.where("not (a <=> b)").collect()] == []
    assert rows.where(plain_money(F.col("t")).isNotNull()).count() > 100
    # those writings that most feeds have need no long way
    assert rows.where(F.col("t").isin("₹ 1,234.00", "INR 12.5", "Rs. 12,34,567.89", "-500", "N/A") & plain_money(F.col("t")).isNull()).isEmpty()


def test_all_amounts_at_once(spark):
    rows = spark.createDataFrame([(t, u) for t, u in zip(texts(), reversed(texts()))], "t string, u string").withColumn("both", F.array("t", "u"))
    read = parse_all(rows, "both", 2, "x")
    assert read.columns == ["t", "u", "both", "x0", "x1"]
    assert read.where(~F.col("x0").eqNullSafe(parse_money(F.col("t"))) | ~F.col("x1").eqNullSafe(parse_money(F.col("u")))).isEmpty()


def test_items_read_as_structs_or_by_paths(spark):
    fields = ["total_fare", "Cabin", "note"]
    items = [{"total_fare": "1"}, {"total_fare": 4521.00, "note": None}, {"total_fare": 1e30, "Cabin": True}, {"cabin": "Y", "note": {"a": [1]}}, {"note": [1, "x"]}, None, 7, "x", [], {}, {"total_fare": "2024-01-01", "Cabin": ""}]
    payloads = [json.dumps({"fares": items}), '{"fares": {}}', '{"fares": []}', '{"fares": 1}', "[]", "", '{"fares": [{"total_fare": "1", "total_fare": "2"}]}', '{"fares": [{"note": 12345678901234567890.5}]}', '{"fares": [1]', None]
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    for types in ({}, {"total_fare": "decimal(12,2)", "note": "boolean"}):
        named, by_path = (extract(raw, Mapping("$.fares", {c: path(c) for c in fields}, types=types)) for path in (lambda c: f"$.{c}", lambda c: f"$['{c}']"))
        assert named.schema == by_path.schema and named.count() == len(items) + 1
        assert sorted(map(str, named.collect())) == sorted(map(str, by_path.collect()))


def test_layouts_are_asked_only_of_texts_that_may_fit(spark):
    known = ["2024-06-03 10:35:07", "2024-06-03 10:35", "03-06-2024 10:35", "03/06/2024 10:35", "2024-06-03T10:35:07", "2024-06-03t10:35", "+12024-06-03T10:35:07"]
    odd = [*known, "2024-6-3 10:35", "soon", "", None, "2024-13-03 10:35", "2024-06-03 10:35\n", " 2024-06-03 10:35", "2024-06-03 10:35:07.5", "2024-06-03T10:35:07Z", "2024-06-03T10:35:07+05:30", "03-06-24 10:35", "2024-06-03"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    naive = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")])
    offset = F.col("t").rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$") & F.col("t").contains(":")
    want = F.when(offset, F.col("t").try_cast("timestamp")).otherwise(F.to_utc_timestamp(naive, canonical.ZONE))
    assert rows.where(~canonical.local_timestamp(F.col("t")).eqNullSafe(want)).isEmpty()


def test_flags_of_tests_that_hold(spark):
    rows = spark.createDataFrame([(True, None), (False, True), (None, False)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(audit.named((F.col("a"), "A"), (F.col("b"), "B"))).collect()] == [["A"], ["B"], []]


def test_the_cap_is_found_among_rows_beyond_alone(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"s{i % 7}", rng.choice([0.0, 1.0, 3.6, 4.0, 9.0, -4.0, -9.0]) if i % 7 else 0.0, f"t{i:04d}", 60 if i % 7 else 1) for i in range(420)] + [(None, None, "t", None)], "s string, score double, tie string, n long")
    want = {(r["tie"], r["is_outlier"]) for r in robust.flagged(rows, ["s"], "tie").collect()}
    assert {(r["tie"], r["is_outlier"]) for r in robust.capped(rows, ["s"], "tie").collect()} == want and 0 < sum(x for _, x in want) < 200


def test_payloads_of_one_source_are_not_one_task(spark, tmp_path):
    """Stages read a batch without a shuffle; of a single batch nothing is ranked again on reading."""
    trust = spark.createDataFrame([("own", 1), ("agent", 2)], "source string, trust_rank int")
    routes = spark.createDataFrame([("DEL-BOM", "DEL", "BOM")], "route string, origin string, destination string")
    made = cleaning.Chain(MAPPING, trust, routes, str(tmp_path))
    item = {"carrier_iata": "6E", "flight_number": "6E 0615", "departure_local": "2026-09-08T06:10:00", "total_fare": "4521.00"}
    rows = [(f"r{i}", ("own", "agent")[i % 2], "DEL-BOM", 7, datetime(2026, 9, 1, 4), json.dumps({"fares": [item | {"flight_number": str(i // 4)}]})) for i in range(12)]
    raw = spark.createDataFrame(rows, RAW)
    assert "hashpartitioning" not in made.stages(raw)._jdf.queryExecution().executedPlan().toString()
    made.batch(raw, 0)
    assert "Window" not in made.fares(spark)._jdf.queryExecution().executedPlan().toString()
    got = [(r["source"], r["flight_number"]) for r in made.fares(spark).collect()]
    assert len(got) == len(set(got)) == made.counters(spark).first()["written"] == 6
    made.batch(raw.where("raw_id = 'r3'"), 1)
    assert made.fares(spark).count() == 6 and made.counters(spark).first()["written"] == 7
    # a folder of before batches marked what leads
    older = cleaning.Chain(MAPPING, trust, routes, f"{tmp_path}/older")
    spark.read.parquet(made.at("marked", 0)).drop("leads").write.parquet(older.at("marked", 0))
    spark.range(1).write.parquet(older.at("done", 0))
    assert sorted((r["source"], r["flight_number"]) for r in older.fares(spark).collect()) == sorted(got)
