"""Tables that several writers append to: parts become visible by a commit, and of commits that meet one wins.

Below a table's path, the folder `<id>` holds what an append has written and `_commits/<number>` names the part that each
commit adds. A commit's file is written beside and then put under its number in one step that fails where there is one already, so of
two writers that have read the same state one must look again. Readers see committed parts only: a task or a writer that dies leaves
nothing that anyone reads.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.sources.sinks import exists


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The number of the last commit, or 0."""
    if not exists(spark, f"{path}/_commits"):
        return 0
    at, files = _file_system(spark, f"{path}/_commits")
    return max((int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()), default=0)


def claim(spark: SparkSession, path: str, number: int, part: str) -> bool:
    """Whether part has become the commit of that number; not if there is one."""
    target, files = _file_system(spark, f"{path}/_commits/{number:020d}")
    beside, _ = _file_system(spark, f"{path}/_commits/.{part}")
    out = files.create(beside, True)
    out.write(bytearray(part.encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # its rename replaces a file, a hard link doesn't
            os.link(beside.toUri().getPath(), target.toUri().getPath())
            return True
        return bool(files.rename(beside, target))
    except FileExistsError:
        return False
    finally:
        files.delete(beside, False)


def read(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None, number: str | None = None) -> DataFrame:
    """The rows of all commits, or of those up to a number; with each row's commit as a further column of the name given."""
    if not (version(spark, path) if upto is None else upto):
        return spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField(number, T.LongType())] if number else [])]))
    known = spark.read.text(f"{path}/_commits", pathGlobFilter="[0-9]*").select("value", "_metadata.file_name")
    known = known if upto is None else known.where(known["file_name"] <= f"{upto:020d}")
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path).select("*", F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})/[^/]*$", 1).alias("_part"))
    if number:
        return rows.join(known.select(F.col("value").alias("_part"), F.col("file_name").cast("long").alias(number)), "_part").select(*schema.names, number)
    return rows.join(known.select(F.col("value").alias("_part")), "_part", "left_semi").select(*schema.names)


def append(spark: SparkSession, path: str, make: Callable[[int], DataFrame], tries: int = 20) -> int:
    """Append what make gives for the state after a commit (by its number), and return the new commit's number.

    If another writer commits meanwhile, make is asked again for the newer state, so it should say what is to be added to that. What
    a try has written and not committed is deleted.
    """
    for _ in range(tries):
        seen, part = version(spark, path), uuid.uuid4().hex
        make(seen).write.parquet(f"{path}/{part}")
        if claim(spark, path, seen + 1, part):
            return seen + 1
        at, files = _file_system(spark, f"{path}/{part}")
        files.delete(at, True)
    raise RuntimeError(f"{tries} times another writer was first")
