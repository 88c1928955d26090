"""Digest tokens and buckets: what they are, and that they are read once, mostly without patterns."""

from decimal import Decimal

from pyspark.sql import functions as F

from plinth.functions import canonical
from plinth.operators import dedup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_tokens_equal_the_patterns_that_they_stand_for(spark):
    """Every character of white space around and inside of a text, one that looks like it (U+200B) and none."""
    blanks = [*map(chr, (*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)), ""]
    texts = [None, "", "ß", *(b + t + b + t + b for b in blanks for t in ("", "aé", "\0"))]
    old = F.coalesce(F.upper(F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")), F.lit("\0MISSING"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dedup.token(F.col("t")).alias("new"), dedup.token(F.col("t"), blank="B").alias("blank"), old.alias("old")).collect()
    assert len(rows) == len(texts)
    assert all(r["new"] == r["old"] and r["blank"] == (r["old"] or "B") for r in rows)


def test_decimal_tokens(spark):
    values = ["100.00", "0.00", "-0.50", "10", "1.2a0", "1.50\n", "7.", "1.0E10", None]
    old = F.regexp_replace(F.regexp_replace("t", r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(dedup.token(F.col("t"), "decimal").alias("new"), F.coalesce(old, F.lit("\0MISSING")).alias("old")).collect()
    assert all(r["new"] == r["old"] for r in rows)
    numbers = spark.createDataFrame([(Decimal(v),) for v in ("100.00", "0", "-0.50", "12.34", "1000000000.10")], "n decimal(12,2)")
    assert [r[0] for r in numbers.select(dedup.token(F.col("n"), "decimal")).collect()] == ["100", "0", "-0.5", "12.34", "1000000000.1"]
    small = spark.createDataFrame([(Decimal("0.00000120"), 1e10)], "n decimal(18,8), x double").select(dedup.token(F.col("n"), "decimal"), dedup.token(F.col("x"), "decimal")).first()
    assert tuple(small) == ("0.0000012", "1.0E10")


def test_tokens_of_known_types_need_no_pattern(spark):
    df = spark.createDataFrame([(1, Decimal("1.50"), "a")], "i int, n decimal(12,2), t string").select(dedup.token(F.col("i"), blank="B").alias("i"), dedup.token(F.col("n"), "decimal").alias("n"), dedup.token(F.col("t")).alias("t"))
    assert tuple(df.first()) == ("1", "1.5", "A")
    assert "regexp" not in plan(df.select("i", "t"))


def test_buckets_read_their_patterns_once(spark):
    df = spark.createDataFrame([("9:59",), ("23:15",), ("99:99",), ("soon",), ("7",), (None,), ("5:07:30",)], "t string").select(canonical.minute_bucket(F.col("t")).alias("b"))
    assert [r[0] for r in df.collect()] == ["09:45", "23:15", "10:30", "soon", "7", None, "05:00"]
    assert plan(df).count("regexp_extract") == 2
