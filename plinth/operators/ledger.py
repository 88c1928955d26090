"""A ledger of sealed records on disk: records go to the end of their series' chain, and nothing is ever changed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.provenance import chained, verified
from plinth.sources import commits


def heads(ledger: DataFrame, series: list[str], order: str) -> DataFrame:
    """The last position and hash of each series."""
    return ledger.groupBy(*series).agg(F.max(order).alias("_last"), F.max_by("chain_hash", order).alias("_head"))


def _schema(rows: DataFrame, series: list[str], order: str, body: str) -> T.StructType:
    kept = [rows.schema[c] for c in series]
    return T.StructType([*kept, T.StructField(order, T.LongType()), T.StructField(body, T.StringType()), T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])


def append(rows: DataFrame, path: str, series: list[str], order: str, body: str, renumber: bool = False) -> None:
    """Chain rows onto what the ledger holds and append them.

    A row at or before its series' last position, and one without a position, raises ValueError and nothing is written. With
    renumber, a row's position is the one after the last: rows keep their order among themselves. Several writers may append at the same
    time: what one has chained onto heads that another has moved on meanwhile is chained anew, onto the newer ones.
    """
    spark = rows.sparkSession
    parts = rows.select(*series, F.col(order).cast("bigint").alias(order), F.col(body).cast("string").alias(body))
    schema = _schema(rows, series, order, body)

    def made(upto: int) -> DataFrame:
        held = heads(commits.read(spark, path, schema, upto), series, order).withColumnsRenamed({c: f"_held_{c}" for c in series})
        same = [parts[c].eqNullSafe(held[f"_held_{c}"]) for c in series]
        more = parts.join(held, reduce(and_, same, F.lit(True)), "left").drop(*[f"_held_{c}" for c in series])
        if renumber:
            place = F.row_number().over(Window.partitionBy(*series).orderBy(order, body))
            more = more.withColumn(order, F.coalesce("_last", F.lit(0)) + place)
        elif not more.where((F.col(order) <= F.col("_last")) | F.col(order).isNull()).isEmpty():
            raise ValueError("a record is not after the last one of its series")
        return chained(more, series, order, body, first="_head")

    commits.append(spark, path, made)


def records(spark: SparkSession, path: str, series: T.StructType, order: str, body: str) -> DataFrame:
    """The ledger's committed records."""
    return commits.read(spark, path, T.StructType([*series.fields, *T.StructType.fromDDL(f"{order} long, {body} string, previous_hash string, chain_hash string").fields]))


def checked(spark: SparkSession, path: str, series: list[str], order: str, body: str) -> DataFrame:
    """Whether each series of a ledger still holds: see provenance.verified."""
    kinds = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    return verified(records(spark, path, T.StructType([kinds[c] for c in series]), order, body), series, order, body)
