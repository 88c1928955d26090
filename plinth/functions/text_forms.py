"""Compatibility composition (NFKC) of texts: one Arrow pass, for texts that it can change only.

Spark has no function for it, and Unicode's tables of decompositions and compositions are Python's own. A pattern that is built from
them says in the JVM which texts may change: those with a character that has another form, or that may join the one before.
All others, signs of currency and accented letters of Western languages among them, go past Python as nulls.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From here on characters may combine with those before them, so all count as changeable but the currency signs.
COMBINING, SIGNS = 0x300, range(0x20A0, 0x20D0)


@functools.cache
def changeable() -> str:
    """A character class of what may change: by Unicode's data below COMBINING and among SIGNS, and all else from there."""
    single = [c for c in (*range(0x80, COMBINING), *SIGNS) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    return "[" + "".join(rf"\x{{{c:x}}}" for c in single) + rf"\x{{{COMBINING:x}}}-\x{{{SIGNS[0] - 1:x}}}\x{{{SIGNS[-1] + 1:x}}}-\x{{10ffff}}]"


#: Rows of an Arrow batch where whole documents are read: a Python worker holds a batch several times over.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> SparkSession:
    """spark with no more than BATCH_ROWS rows in an Arrow batch; it stays so, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def _form(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def _forms(texts: pd.Series) -> pd.Series:
    return texts.map(_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def _forms_of_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: json.dumps([_form(t) for t in json.loads(x)], ensure_ascii=False), na_action="ignore")


def nfkc(text: Column) -> Column:
    """text in its compatibility composition; null stays null."""
    may = F.regexp_like(text, F.lit(changeable()))
    return F.when(may, _forms(F.when(may, text))).otherwise(text)


def nfkc_of_each(texts: Column) -> Column:
    """An array of texts, each in its compatibility composition; one pass for all of them.

    Arrays travel as JSON texts: Arrow's size is asked for after every row, which for lists costs more than the rows themselves.
    """
    # texts of ASCII alone have as many bytes as characters, and nothing that changes
    all_of = F.array_join(texts, "\n")
    may = (F.octet_length(all_of) != F.char_length(all_of)) & F.regexp_like(all_of, F.lit(changeable()))
    return F.when(may, F.from_json(_forms_of_each(F.when(may, F.to_json(texts))), "array<string>")).otherwise(texts)
