"""Money text to amounts, as one column expression: unknown is never zero, and nothing raises.

parse_money() gives a struct (value decimal(12,2), status, currency). A status is ok, missing, unparseable,
negative_rejected or wrong_currency; value is set for ok alone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that say that no value is published: fixed values.
MISSING = (
    "", "-", "--", "---", "n/a", "na", "n.a.", "nil", "none", "null",
    "not available", "unavailable", "tba", "tbd", "?", "sold out", "soldout",
    "no seats", "no fare", "call for price", "on request", "price on request",
)
#: Currency signs and codes, in the order in which they are tried: fixed values.
CURRENCIES = (
    ("₹", "INR"), ("₨", "INR"), ("rs", "INR"), ("rs.", "INR"), ("inr", "INR"),
    ("$", "USD"), ("us$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"),
    ("£", "GBP"), ("gbp", "GBP"), ("aed", "AED"), ("sgd", "SGD"), ("thb", "THB"),
)
#: Magnitude words: fixed values.
MAGNITUDES = (
    ("k", 1_000), ("thousand", 1_000), ("m", 1_000_000), ("mn", 1_000_000), ("million", 1_000_000),
    ("l", 100_000), ("lac", 100_000), ("lakh", 100_000), ("lakhs", 100_000),
    ("cr", 10_000_000), ("crore", 10_000_000), ("crores", 10_000_000),
)
#: The shape of an amount: fixed value.
_AMOUNT = r"^([-+])?([^0-9\s]{0,6}?)\s*([0-9][0-9.,]*)\s*([^0-9\s]{0,8})$"
#: Amounts that need no reading: digits that fit, without any mark or with a point before one or two, with or without a minus: fixed value.
_PLAIN = r"^-?[0-9]{1,9}(?:\.[0-9]{1,2})?\z"
#: Amounts after a sign or code of the rupee, grouped or not, for which all steps come to a cast as well: fixed value.
_RUPEES = r"^(?:(?i:₹|rs\.?|inr) ?)?((?:[0-9]{1,9}|[0-9]{1,3}(?:,[0-9]{2,3})?,[0-9]{3})(?:\.[0-9]{1,2})?)\z"
#: Compatibility forms that money text is seen with: other digits, dashes and blanks, and the rupee sign's long form.
_FROM = "०१२३४५६७८९０１２３４５６７８９−–—－    　．，"
_TO = "01234567890123456789----     .,"


def fold(raw: Column) -> Column:
    """One kind of digits, dashes and blanks; runs of white space are one blank; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(raw, _FROM, _TO), "₨", "Rs"), r"\s+", " "))


def _let(value: Column, then) -> Column:
    """then(value) with value evaluated once: a lambda's variable is bound, where a column's expression would be repeated."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _bound(fields: dict[str, Column], then) -> Column:
    """then(struct of fields), each evaluated once."""
    return _let(F.struct(*[c.alias(k) for k, c in fields.items()]), then)


def resolve_separators(number: Column) -> Column:
    """Grouping marks dropped and the decimal mark a point; a lone mark before three digits is grouping."""

    def resolved(n: Column) -> Column:
        number, head, tail = n["number"], n["head"], n["tail"]
        plain = F.translate(number, ".,", "")
        pointed = F.concat(F.coalesce(F.nullif(F.translate(head, ".,", ""), F.lit("")), F.lit("0")), F.lit("."), tail)
        return (
            F.when(n["dots"] + n["commas"] == 0, number)
            .when((n["dots"] > 0) & (n["commas"] > 0), pointed)
            .when(n["dots"] + n["commas"] > 1, plain)
            .when((F.length(tail) == 3) & (head != ""), plain)
            .when(F.length(tail).isin(1, 2) | (head == ""), pointed)
            .otherwise(plain)
        )

    def cut(n: Column) -> Column:
        last = F.length(n["number"]) - F.length(n["tail"])
        return _bound({"number": n["number"], "tail": n["tail"], "dots": n["dots"], "commas": n["commas"], "head": F.substring(n["number"], F.lit(1), last - 1)}, resolved)

    dots, commas = (F.length(number) - F.length(F.replace(number, F.lit(c), F.lit(""))) for c in ".,")
    return _bound({"number": number, "dots": dots, "commas": commas, "tail": F.substring_index(F.translate(number, ",", "."), ".", -1)}, cut)


def _first(pairs, test, otherwise: Column) -> Column:
    out = reduce(lambda c, p: F.when(test(p[0]), F.lit(p[1])) if c is None else c.when(test(p[0]), F.lit(p[1])), pairs, None)
    return out.otherwise(otherwise)


def _result(status: Column | str, value: Column | None, currency: Column) -> Column:
    return F.struct((F.lit(None) if value is None else value).cast("decimal(12,2)").alias("value"), (F.lit(status) if isinstance(status, str) else status).alias("status"), currency.cast("string").alias("currency"))


def plain_money(raw: Column, expected: str | None = None, allow_negative: bool = False) -> Column:
    """As parse_money(), of texts in the most common writings, without any lambda (those are interpreted); null for all others."""
    default = F.lit(expected).cast("string")
    rupees = F.translate(F.regexp_extract(raw, _RUPEES, 1), ",", "").try_cast("decimal(12,2)")
    told = F.when(raw.isNull(), _result("missing", None, default))
    if not allow_negative:
        told = told.when(F.regexp_like(raw, F.lit(_PLAIN)) & (raw.try_cast("decimal(12,2)") < 0), _result("negative_rejected", None, default))
    told = told.when(F.regexp_like(raw, F.lit(_PLAIN)), _result("ok", raw.try_cast("decimal(12,2)"), default))
    marked = F.when(F.regexp_like(raw, F.lit("^[0-9]")), default).otherwise("INR")
    told = told.when(rupees.isNotNull() & (marked != F.lit(expected)), _result("wrong_currency", None, marked)).when(rupees.isNotNull(), _result("ok", rupees, marked))
    return told.when(F.lower(raw).isin(*MISSING), _result("missing", None, default))


def parse_money(raw: Column, expected: str | None = None, allow_negative: bool = False) -> Column:
    default = F.lit(expected).cast("string")

    def result(status: Column | str, value: Column | None = None, currency: Column = default) -> Column:
        return _result(status, value, currency)

    # each step is bound once, with what later steps need of the ones before
    def judge(a: Column) -> Column:
        is_code, magnitude = F.upper(a["word"]).isin(*sorted({c for _, c in CURRENCIES})), a["word"].isin(*(w for w, _ in MAGNITUDES))
        known = (a["word"] == "") | is_code | magnitude | a["word"].isin(*(t for t, _ in CURRENCIES))
        final = F.when(is_code & ~magnitude, F.upper(a["word"])).otherwise(a["currency"])
        negative = (a["bracketed"] | (a["sign"] == "-")) & (a["value"] != 0)
        status = (
            F.when(~a["digit"] & ~a["matched"], F.lit("missing"))
            .when(~a["fits"] | a["value"].isNull() | ~known, F.lit("unparseable"))
            .when(negative & F.lit(not allow_negative), F.lit("negative_rejected"))
            .when(final != F.lit(expected), F.lit("wrong_currency"))
            .otherwise(F.lit("ok"))
        )
        signed = F.when(negative, -a["value"]).otherwise(a["value"])
        return _bound({"status": status, "signed": signed, "final": final}, lambda j: result(j["status"], F.when(j["status"] == "ok", F.round(j["signed"], 2).try_cast("decimal(12,2)")), F.coalesce(j["final"], default)))

    def value(a: Column) -> Column:
        times = _first(MAGNITUDES, lambda w: a["word"] == w, F.lit(1))
        made = resolve_separators(a["number"]).try_cast("decimal(30,10)") * times.cast("decimal(10,0)")
        return _bound({"value": made} | {k: a[k] for k in ("sign", "word", "fits", "digit", "matched", "bracketed", "currency")}, judge)

    def split(a: Column) -> Column:
        sign, number, suffix = (F.regexp_extract(a["source"], _AMOUNT, g) for g in (1, 3, 4))
        word = F.lower(F.regexp_replace(suffix, r"^[. ]+|[. ]+$", ""))
        fits = a["matched"] | F.regexp_like(a["source"], F.lit(_AMOUNT))
        return _bound({"sign": sign, "number": number, "word": word, "fits": fits} | {k: a[k] for k in ("digit", "matched", "bracketed", "currency")}, value)

    def source(a: Column) -> Column:
        digits = F.regexp_replace(a["compact"], r"[^0-9.,\-]", "")
        chosen = F.when(a["matched"], a["compact"]).otherwise(digits)
        return _bound({"source": chosen, "digit": a["matched"] | F.regexp_like(a["compact"], F.lit("[0-9]"))} | {k: a[k] for k in ("matched", "bracketed", "currency")}, split)

    def compact(a: Column) -> Column:
        currency = _first(CURRENCIES, lambda t: a["low"].startswith(t) | a["low"].endswith(t), default)
        return _bound({"compact": a["compact"], "matched": F.regexp_like(a["compact"], F.lit(_AMOUNT)), "currency": currency, "bracketed": a["bracketed"]}, source)

    def of_text(text: Column) -> Column:
        bracketed = text.startswith("(") & text.endswith(")")
        inner = F.when(bracketed, F.trim(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
        parts = _let(inner, lambda t: _bound({"low": F.lower(t), "compact": F.replace(t, F.lit(" "), F.lit("")), "bracketed": bracketed}, compact))
        return F.when(F.lower(text).isin(*MISSING), result("missing")).otherwise(parts)

    # most amounts are plain numbers, for which all of the steps above come to a cast
    return F.coalesce(plain_money(raw, expected, allow_negative), _let(fold(raw), of_text))


def parse_all(rows: DataFrame, texts: str, n: int, into: str) -> DataFrame:
    """rows with the first n texts of an array as parse_money() reads them, in columns {into}0 and on.

    The long way is taken for those texts alone that plain_money() doesn't settle, and in one expression for all of them.
    """
    quick = rows.withColumns({f"{into}{i}": plain_money(F.get(texts, F.lit(i))) for i in range(n)})
    hard = quick.withColumn("_hard", F.array(*[F.when(F.col(f"{into}{i}").isNull(), F.get(texts, F.lit(i))) for i in range(n)]))
    read = hard.withColumn("_hard", F.when(reduce(or_, [F.col(f"{into}{i}").isNull() for i in range(n)]), F.transform("_hard", lambda x: parse_money(x))))
    return read.withColumns({f"{into}{i}": F.coalesce(f"{into}{i}", F.get("_hard", F.lit(i))) for i in range(n)}).drop("_hard")
