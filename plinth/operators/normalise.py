"""The older way of normalising observations: every field is read, each failure is an issue, and rows with one are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.canonical import clock_time
from plinth.functions.money import fold

#: Cabin words and currency signs of the older profile: fixed values.
CABINS = {
    "ECONOMY": ("y", "e", "eco", "econ", "economy", "economy class", "coach", "main cabin"),
    "PREMIUM_ECONOMY": ("w", "pe", "premium", "premium economy"),
    "BUSINESS": ("c", "j", "biz", "business", "business class"),
    "FIRST": ("f", "first", "first class"),
}
SIGNS = {"₹": "INR", "rs": "INR", "rs.": "INR", "₨": "INR", "$": "USD", "us$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "د.إ": "AED", "s$": "SGD", "฿": "THB"}


def _given(c: Column, otherwise: str = "") -> Column:
    return fold(F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise)))


def _code(c: Column, pattern: str) -> Column:
    text = F.replace(F.upper(_given(c)), F.lit(" "), F.lit(""))
    return F.when(F.regexp_like(text, F.lit(pattern)), text)


def cabin(c: Column) -> Column:
    """The cabin that a word means, economy without one; null for an unknown word."""
    words = F.create_map(*[F.lit(x) for name, listed in CABINS.items() for word in listed for x in (word, name)])
    return F.try_element_at(words, F.lower(_given(c, "economy")))


def currency(c: Column, default: str = "INR") -> Column:
    """The code of a currency's sign or name; null where it isn't three letters."""
    text = _given(c, default)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.lower(text)), F.upper(text))
    return F.when(F.regexp_like(code, F.lit("^[A-Z]{3}$")), code)


def flight(c: Column) -> Column:
    """Designator and number without leading zeros; null for any other text."""
    text, pattern = F.upper(fold(c)), r"^([A-Z0-9]{2,3})\s*-?\s*([0-9]{1,4})$"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2).cast("int").cast("string")))


def normalised(rows: DataFrame, total: str = "total_value") -> DataFrame:
    """rows with origin, destination, carrier_code, cabin, currency, departure_date and observation_ts as they should be,
    days_to_departure (as given, or from the two times; never below none), issues (field and code of all that failed) and is_clean.
    A departure_time, where rows have one, becomes HH:MM or null, which is no issue.

    An unusable total (null, zero or less) is an issue; only an unknown one, or a field that can't be read, rejects the row.
    """
    clean = {
        "origin": _code(F.col("origin"), "^[A-Z]{3}$"), "destination": _code(F.col("destination"), "^[A-Z]{3}$"), "carrier_code": _code(F.col("carrier_code"), "^[A-Z0-9]{2,3}$"),
        "cabin": cabin(F.col("cabin")), "currency": currency(F.col("currency")),
        "departure_date": F.left(F.trim(F.col("departure_date").cast("string")), F.lit(10)).try_cast("date"),
        "observation_ts": F.trim(F.col("observation_ts").cast("string")).try_cast("timestamp"),
    }
    codes = {"origin": "invalid_station", "destination": "invalid_station", "carrier_code": "invalid_carrier", "cabin": "unknown_cabin", "currency": "invalid_currency", "departure_date": "unparseable", "observation_ts": "unparseable"}
    out = rows.withColumns(clean)
    amount = F.col(total)
    failed = [F.when(F.col(name).isNull(), F.concat_ws(":", F.lit(name), F.lit(code))) for name, code in codes.items()]
    issues = F.filter(F.array(*failed, F.when(F.coalesce(amount <= 0, F.lit(True)), F.lit("total_fare:unusable_total"))), lambda x: x.isNotNull())
    known = amount.isNotNull()
    for name in codes:
        known = known & F.col(name).isNotNull()
    counted = F.datediff("departure_date", F.to_date("observation_ts"))
    given = F.col("days_to_departure").cast("int") if "days_to_departure" in rows.columns else F.lit(None).cast("int")
    ahead = F.greatest(F.coalesce(given, counted), F.lit(0))
    if "departure_time" in rows.columns:
        out = out.withColumn("departure_time", clock_time(F.col("departure_time")))
    return out.withColumns({"days_to_departure": ahead, "issues": issues, "is_clean": known})


def split(marked: DataFrame, good: str = "is_clean") -> tuple[DataFrame, DataFrame]:
    """The rows that are good, and all others, nulls among them. Both are filters of one plan."""
    return marked.where(F.coalesce(F.col(good), F.lit(False))), marked.where(~F.coalesce(F.col(good), F.lit(False)))
