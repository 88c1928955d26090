"""The cleaning chain over payloads: single cases, batches that are killed, repeated and split."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plinth.plans.cleaned_queries import MAPPING
from plinth.streaming import cleaning

RAW = "raw_id string, source string, route string, lead_window int, captured_at timestamp, payload string"
FULL = {"carrier_iata": "6E", "flight_number": "6E 0615", "cabin": "economy", "departure_local": "2026-09-08T06:10:00", "total_fare": "4521.00", "base_fare": "3800", "udf": "300", "psf": "200", "asf": "100", "gst": "121", "other_charges": "0"}


def raw(spark, *rows):
    """Rows of (raw_id, source, item changes or a payload), all of one route and day."""
    made = [(i, s, "DEL-BOM", 7, datetime(2026, 9, 1, 4 + len(i) % 2), p if isinstance(p, str) else json.dumps({"fares": [FULL | x for x in p]})) for i, s, p in rows]
    return spark.createDataFrame(made, RAW)


def chain(spark, folder, **more):
    trust = spark.createDataFrame([("own", 1), ("agent", 2)], "source string, trust_rank int")
    routes = spark.createDataFrame([("DEL-BOM", "DEL", "BOM")], "route string, origin string, destination string")
    return cleaning.Chain(MAPPING, trust, routes, str(folder), **more)


def staged(spark, tmp_path, *items):
    rows = chain(spark, tmp_path).stages(raw(spark, *[(f"r{i}", "own", [x]) for i, x in enumerate(items)])).collect()
    return sorted(rows, key=lambda r: int(r["raw_id"][1:]))


def test_single_cases(spark, tmp_path):
    saver, flexi, zero, gone, corrupt, junk, late, odd, wide = staged(
        spark, tmp_path, {"fare_basis": "Q07SAVER", "booking_class": "Q"}, {"fare_basis": "M07FLEXI", "booking_class": "M", "total_fare": "7899.00"}, {"total_fare": "0"},
        {"inventory_status": "SOLD_OUT", "departure_local": None, "total_fare": None}, {"base_fare": "-500.00", "udf": None}, {"total_fare": "4,521/-"}, {"departure_local": "2026-08-31 06:10"}, {"departure_local": "soon"},
        {"total_fare": "₹ ４，５２１．𝟎𝟎"},
    )
    assert saver["fingerprint"] != flexi["fingerprint"] and saver["quality_grade"] == "A" and saver["flight_number"] == "615"
    assert (zero["total_fare"], zero["base_fare"], zero["inventory_status"], zero["quality_grade"]) == (None, None, "PRICE_UNAVAILABLE", "D") and "PRICE_UNAVAILABLE" in zero["flags"]
    assert gone["stage"] is None and {"SOLD_OUT", "MODELLED"} <= set(gone["flags"]) and str(gone["departure_utc"]) == "2026-09-07 18:30:00"
    assert wide["stage"] is None and str(wide["total_fare"]) == "4521.00"
    assert corrupt["base_fare"] is None and "COMPONENT_UNPARSEABLE" in corrupt["flags"] and corrupt["quality_grade"] == "C"
    assert [(r["stage"], r["reason"]) for r in (junk, late, odd)] == [("currency", "total_fare unparseable"), ("structural", "departure precedes observation"), ("canonicalisation", "undecodable departure time")]


def test_duplicates_conflicts_and_failures(spark, tmp_path):
    made = chain(spark, tmp_path)
    made.batch(raw(spark, ("a", "own", [{}]), ("b", "agent", [{"total_fare": "9000.00"}]), ("c", "nobody", [{}]), ("d", "own", '{"fares": [')).withColumn("run", F.lit("r1")), 0)
    rows = {r["raw_id"]: r for r in made.fares(spark).collect()}
    assert (rows["a"]["is_duplicate"], rows["a"]["dedup_reason"], rows["b"]["dedup_reason"]) == (False, "source_trust", "lost_tie_break")
    assert all("CROSS_SOURCE_CONFLICT" in r["flags"] and r["run"] == "r1" for r in rows.values())  # further columns go along
    assert {(r["raw_id"], r["stage"]) for r in made.rejections(spark).collect()} == {("c", "extraction"), ("d", "extraction")}
    c = made.counters(spark).first()
    assert (c["extracted"], c["duplicates"], c["cross_source_conflicts"], c["written"]) == (2, 1, 1, 2)


def facts(df):
    return sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_a_batch_that_is_killed_counts_once(spark, tmp_path, monkeypatch, dies_in="screened"):
    """The stream dies inside of its second batch, when some of its tables are written, and is started again."""
    first = raw(spark, ("a", "own", [{}, {"flight_number": "9", "total_fare": "5000"}]), ("b", "agent", [{}]))
    second = raw(spark, ("c", "own", [{"total_fare": "4600.00"}]), ("dd", "own", [{"total_fare": "junk 1,2,3/-"}]))
    log = f"{tmp_path}/raw"
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(log)
    stream = lambda: spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(log)
    whole = chain(spark, tmp_path / "whole")
    whole.run(stream())
    killed, real, calls = chain(spark, tmp_path / "killed"), getattr(cleaning, dies_in), []

    def dies(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*a, **k)

    monkeypatch.setattr(cleaning, dies_in, dies)
    with pytest.raises(Exception, match="killed"):
        killed.run(stream())
    seen = killed.fares(spark).count()
    killed.run(stream())
    assert len(calls) == 3 and seen < whole.fares(spark).count() or seen == 3
    assert facts(killed.fares(spark)) == facts(whole.fares(spark)) and facts(killed.counters(spark)) == facts(whole.counters(spark)) and facts(killed.rejections(spark)) == facts(whole.rejections(spark))
    before = facts(killed.counters(spark))
    killed.batch(first, 0)
    assert facts(killed.counters(spark)) == before
    # the newer batch's offer of one source, fingerprint and day is the one that counts
    assert {str(r["total_fare"]) for r in killed.fares(spark).where("source = 'own' and flight_number = '615'").collect()} == {"4600.00"}


def test_empty_batches(spark, tmp_path):
    made = chain(spark, tmp_path)
    made.batch(raw(spark, ("a", "own", '{"fares": []}')).where("raw_id = 'z'"), 0)
    made.batch(raw(spark, ("a", "own", '{"fares": []}')), 1)
    assert made.fares(spark).isEmpty() and made.counters(spark).first()["extracted"] == 0 and made.rejections(spark).isEmpty()
