"""Sinks: a write-once raw log, keyed upserts by partition overwrite, and an append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_once(rows: DataFrame, path: str, key: str = "ingress_hash") -> tuple[int, int]:
    """Append rows whose key is new (one row a key); returns (written, skipped). Nothing there is ever changed.

    The new rows are those of the batch that the log lacks: an anti-join on the key, which Spark may broadcast from
    the batch's side, so the log is read for its key column alone. They become visible by a commit; if another writer has committed
    since the log was read, it is read again, so no two writers both append a key (see sources.commits). What is written is observed on
    the way, so only the batch is counted again.
    """
    from plinth.sources import commits

    spark, one, seen = rows.sparkSession, rows.dropDuplicates([key]), []

    def fresh(upto: int) -> DataFrame:
        seen.append(Observation())
        held = commits.read(spark, path, rows.schema, upto).select(key)
        return one.join(held, key, "left_anti").select(*rows.columns).observe(seen[-1], F.count(F.lit(1)).alias("n"))

    commits.append(spark, path, fresh)
    return seen[-1].get["n"], rows.count() - seen[-1].get["n"]


def upsert(rows: DataFrame, path: str, keys: list[str], order: list, partition: str) -> None:
    """The first row of each key in order wins, among rows and what the touched partitions hold; only those are rewritten."""
    spark = rows.sparkSession
    incoming = rows.withColumn("_new", F.lit(0))
    if exists(spark, path):
        touched = rows.select(partition).distinct()
        held = spark.read.parquet(path).join(touched, partition, "left_semi").withColumn("_new", F.lit(1))
        incoming = incoming.unionByName(held.select(*rows.columns, "_new"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_new", *order))
    best = incoming.withColumn("_place", place).where("_place = 1").drop("_place", "_new")
    from plinth.lineage import cut

    cut(best).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def audit(spark: SparkSession, path: str, *lines: tuple[str, str, str | None, str | None]) -> None:
    """Append lines (action, subject, before, after) to the audit log, as one file."""
    rows = spark.createDataFrame(list(lines), "action string, subject string, before string, after string")
    audit_rows(rows.coalesce(1), path)


def audit_rows(rows: DataFrame, path: str) -> None:
    """Append what a job found to the audit log, with the time of the append. Nothing there is ever changed."""
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
