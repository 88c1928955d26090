"""Appends of several writers at once, and of writers that die."""

import threading

import pytest
from pyspark.sql import functions as F

from plinth.operators import ledger
from plinth.sources import commits, sinks

SCHEMA = "ingress_hash string, v int"


def at_once(*jobs):
    """Run jobs in threads that begin together; what they raise."""
    gate, failed = threading.Barrier(len(jobs)), []

    def run(job):
        gate.wait()
        try:
            job()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(job,)) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def test_two_writers_append_a_key_once(spark, tmp_path):
    path, counts = f"{tmp_path}/raw", []
    rows = lambda v, keys: spark.createDataFrame([(f"h{k}", v) for k in keys], SCHEMA)
    assert at_once(*[lambda v=v, keys=keys: counts.append(sinks.write_once(rows(v, keys), path)) for v, keys in ((1, range(0, 30)), (2, range(20, 50)), (3, range(10, 40)))]) == []
    got = commits.read(spark, path, rows(0, [0]).schema)
    assert sorted(r["ingress_hash"] for r in got.collect()) == sorted(f"h{k}" for k in range(50)) and sum(w for w, _ in counts) == 50
    assert commits.version(spark, path) == 3


def test_threads_append_to_one_series(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    rows = lambda who: spark.createDataFrame([("s", k, f"{who}{k}") for k in range(4)] + [(None, 0, who)], "s string, k long, body string")
    assert at_once(*[lambda who=who: ledger.append(rows(who), path, ["s"], "k", "body", renumber=True) for who in ("x", "y", "z")]) == []
    kept = ledger.records(spark, path, rows("x").select("s").schema, "k", "body")
    assert sorted(r["body"] for r in kept.collect()) == sorted([f"{w}{k}" for w in "xyz" for k in range(4)] + list("xyz"))
    assert sorted(r["k"] for r in kept.where("s = 's'").collect()) == list(range(1, 13))
    assert {(r["s"], r["n"], r["valid"]) for r in ledger.checked(spark, path, ["s"], "k", "body").collect()} == {("s", 12, True), (None, 3, True)}


def test_a_writer_that_dies_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/raw", spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    with pytest.raises(Exception, match="dies"):
        sinks.write_once(rows.withColumn("v", F.when(F.col("ingress_hash") == "b", F.raise_error(F.lit("dies"))).otherwise(F.col("v")).cast("int")), path)
    assert commits.version(spark, path) == 0 and commits.read(spark, path, rows.schema).isEmpty()
    monkeypatch.setattr(commits, "claim", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
    with pytest.raises(RuntimeError):
        sinks.write_once(rows, path)
    monkeypatch.undo()
    assert commits.read(spark, path, rows.schema).isEmpty()
    assert sinks.write_once(rows, path) == (2, 0) and sinks.write_once(rows, path) == (0, 2)


def test_a_commit_of_a_number_happens_once(spark, tmp_path):
    path = str(tmp_path)
    assert commits.claim(spark, path, 1, "a" * 32) and not commits.claim(spark, path, 1, "b" * 32)
    assert commits.version(spark, path) == 1
