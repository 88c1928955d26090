"""Large expressions are compiled, whoever made the session."""

from plinth.plans import registry
from plinth.session import COMPILED


def test_queries_have_large_expressions_compiled(spark, tiny):
    for name in COMPILED:
        spark.conf.unset(name)
    registry.queries()["normalise_split"](spark, tiny)
    assert {k: spark.conf.get(k) for k in COMPILED} == COMPILED


def test_whole_documents_go_to_python_in_small_batches(spark, tiny):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in (("10000", "500"), ("0", "500"), ("50", "50")):
            spark.conf.set(name, given)
            registry.queries()["folded_documents"](spark, tiny)
            assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
