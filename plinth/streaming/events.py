"""Event streams: tumbling windows, duplicates within a watermark, late and early flags, micro-batch ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.lineage import shared_folder


def file_stream(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files below path, with the time column as a timestamp that takes a watermark."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, it may name a single file too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each tumbling window; state older than the watermark goes."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_timestamp("w.start").alias("window_start"), *by, "n", "total")


def first_of_each(events: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first event of each key, with state bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def flag_timing(departure: Column, observed: Column, lead_days: Column, grace_hours: int = 3, drift_days: int = 1) -> Column:
    """Late and early data are marked, not dropped: rejected, stale or ok."""
    lead = F.datediff(F.to_date(departure), F.to_date(observed))
    return F.when(departure < observed - F.expr(f"interval {grace_hours} hours"), "rejected").when(F.abs(lead - lead_days) > drift_days, "stale").otherwise("ok")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now; its result is a table in the shared folder.

    In complete mode each micro-batch replaces the table; in append mode it adds to it. The checkpoint is beside it,
    so a run that was cut off goes on where it was.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/table"

    def write(batch: DataFrame, number: int) -> None:
        # a repeated micro-batch rewrites its own folder, so that it counts once
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def ingest(raw: DataFrame, checkpoint: str, clean: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch of new raw rows to clean, once: the checkpoint is the processed flag."""
    raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(clean).start().awaitTermination()
