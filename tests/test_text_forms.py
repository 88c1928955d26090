"""Compatibility forms against Unicode's own data, and the amounts that are read of them."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import money, text_forms
from plinth.functions.money import parse_money
from plinth.functions.text_forms import changeable, nfkc, nfkc_of_each

POINTS = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def test_every_code_point_alone_and_after_a_letter(spark):
    texts = [t for c in POINTS for t in (c, "a" + c)]
    rows = spark.createDataFrame([("\x00".join(texts[at : at + 500]),) for at in range(0, len(texts), 500)], "all string")
    got = rows.select(F.explode(F.split("all", "\x00")).alias("t")).repartition(8).select("t", nfkc(F.col("t")).alias("f"))
    wrong = [r["t"] for r in got.toLocalIterator(prefetchPartitions=True) if r["f"] != unicodedata.normalize("NFKC", r["t"])]
    assert wrong == [] and got.count() == len(texts)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé₹€£ 0̧́Å각ᅡᄀﬁ①＄½ßΩK₨ड़़"), max_size=12))
def test_a_text_without_changeable_characters_does_not_change(text):
    python = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", changeable()))
    assert python.search(text) or unicodedata.normalize("NFKC", text) == text


def test_nulls_and_arrays(spark):
    one = spark.createDataFrame([(["ﬁ", None, "a", "₹ 5"],), ([],), (None,), (["x", None],)], "t array<string>")
    assert [r[0] for r in one.select(nfkc_of_each(F.col("t"))).collect()] == [["fi", None, "a", "₹ 5"], [], None, ["x", None]]
    assert [r[0] for r in spark.createDataFrame([("",), (None,), ("e\u0301",)], "t string").select(nfkc(F.col("t"))).collect()] == ["", None, "é"]


@pytest.mark.parametrize("text, value", [("₹ ４，５２１．５０", "4521.50"), ("𝟒𝟓𝟐𝟏", "4521.00"), ("㍐ 4521", "4521.00"), ("₨ 4,521", "4521.00"), ("４５２１㎏", None), ("¹²³", "123.00"), ("4521／-", None), ("US＄ 45", "45.00"), ("⑫", "12.00")])
def test_amounts_in_other_forms(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(parse_money(nfkc(F.col("t")))["value"].cast("string")).first()[0]
    assert got == value


def test_lists_of_texts_travel_as_one_text(spark):
    """Arrow is asked for its size after every row, which is slow for lists: so they go as texts, and nothing in them is lost."""
    assert text_forms._forms_of_each.returnType.simpleString() == "string"
    odd = ["４", None, "", 'a "b" \\ ,[]', "\n\t\x01", "ﬁ", "𝟎", "null"]
    got = spark.createDataFrame([(odd,), (None,), ([],), ([None],)], "t array<string>").select(text_forms.nfkc_of_each(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [[t if t is None else unicodedata.normalize("NFKC", t) for t in odd], None, [], [None]]


def test_plain_amounts_are_what_they_are_with_a_sign(spark):
    """Plain numbers take a short way; with a currency's sign before them they take the long one."""
    texts = ["0", "0.00", "4521", "007", "1.5", "12.34", "999999999.99", "1.234", "1234567890", "12.", ".5", "5\n", " 7"]
    m = spark.createDataFrame([(t,) for t in texts], "t string").select(money.parse_money(F.col("t"), expected="INR").alias("a"), money.parse_money(F.concat(F.lit("₹"), "t"), expected="INR").alias("b"), F.regexp_like("t", F.lit(money._PLAIN)).alias("plain")).collect()
    assert all(r["a"] == r["b"] for r in m) and [r["plain"] for r in m] == [True] * 7 + [False] * 6
