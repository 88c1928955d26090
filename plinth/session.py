"""A session for the engine: UTC, adaptive execution, state in RocksDB, and no generated method that the JVM would leave interpreted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: HotSpot compiles no method above 8000 bytes: a stage of large expressions that is one such method is interpreted, row by row, at
#: several times the cost. Above the limit Spark takes a projection of many small methods instead.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def session(app: str = "plinth", master: str | None = None, **conf: str) -> SparkSession:
    """The session at hand, or a new one; settings given win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | COMPILED | conf).getOrCreate()


def compiled(spark: SparkSession) -> SparkSession:
    """spark, whoever made it, with large expressions compiled (see COMPILED)."""
    for name, value in COMPILED.items():
        spark.conf.set(name, value)
    return spark


@contextmanager
def tagged(spark: SparkSession, correlation: str) -> Iterator[None]:
    """Jobs started inside bear the correlation id as a tag, so that they are found, and can be cancelled, by it."""
    spark.addTag(correlation)
    try:
        yield
    finally:
        spark.removeTag(correlation)
