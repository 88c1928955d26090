"""Collection as rows: what a source answers to each task, what has landed in a folder, and what is still to be cleaned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME = "outcome string, error_kind string, error string, http_status int, payload string, ingress_hash string"


class Refused(Exception):
    """Raised by a fetch that policy doesn't allow; with halted, the source takes no further task in this run."""

    def __init__(self, reason: str, halted: bool = False):
        super().__init__(reason)
        self.halted = halted


def collect(tasks: DataFrame, fetch: Callable[[dict], tuple[int, str]], source: str = "source", order: str = "seq", refused: Column | None = None) -> DataFrame:
    """tasks with an outcome each: ok, failed, blocked, halted, abandoned, or refused for what refused says of it.

    fetch takes a task as a dictionary and returns status and payload; whatever it raises becomes the row's error, so one
    task never ends the run. Tasks of one source run in their order (nulls first), since after a halt the rest of that source is
    abandoned without being fetched; sources run side by side. Batches are streamed: no source is held in memory. A lost
    executor fetches its tasks again, so a source's fetch should be repeatable or the raw log write-once.
    """
    names = tasks.columns
    rows = tasks.withColumn("_refused", F.lit(None).cast("string") if refused is None else refused)
    runs = rows.repartition(source).sortWithinPartitions(source, order)
    fields = T.StructType.fromDDL(OUTCOME).fields
    kind, found = T.StructType([*tasks.schema.fields, *fields]), [f.name for f in fields]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        of, halted = object(), False
        for batch in batches:
            out = []
            for task in batch.to_pylist():
                reason = task.pop("_refused")
                of, halted = (task[source], halted) if task[source] == of else (task[source], False)
                done = dict.fromkeys(found)
                if halted or reason is not None:
                    done |= {"outcome": "abandoned"} if halted else {"outcome": "refused", "error": reason}
                else:
                    try:
                        status, payload = fetch(dict(task))
                        done |= {"outcome": "ok", "http_status": status, "payload": payload, "ingress_hash": hashlib.sha256(payload.encode()).hexdigest()}
                    except Refused as error:
                        halted = error.halted
                        done |= {"outcome": "halted" if halted else "blocked", "error_kind": "Refused", "error": str(error)}
                    except Exception as error:  # noqa: BLE001 - a task's failure is its row
                        done |= {"outcome": "failed", "error_kind": type(error).__name__, "error": str(error)}
                out.append(done)
            added = [pa.array([d[c] for d in out], pa.int32() if c == "http_status" else pa.string()) for c in found]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*names, *found])

    return runs.mapInArrow(run, kind)


def landed(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Files that something outside of the engine (a browser, a crawler) left in a folder: a payload a file, with its path,
    time, hash, and whether it is JSON. As a stream it goes on with new files."""
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true")
    rows = reader.text(folder, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("captured_at"))
    return rows.withColumns({"ingress_hash": F.sha2("payload", 256), "is_json": F.try_parse_json("payload").isNotNull()})


def unprocessed(raw: DataFrame, done: DataFrame, run: str | None = None, key: str = "ingress_hash") -> DataFrame:
    """Raw rows (of one run) that no mark says are cleaned. Marks are a table of their own, so the raw log never changes."""
    rows = raw if run is None else raw.where(F.col("run") == run)
    return rows.join(done.select(key), key, "left_anti").select(*raw.columns)
