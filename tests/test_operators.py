"""Operators on small fixtures, with results worked out by hand or by brute force."""

import hashlib
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plinth import lineage
from plinth.functions import canonical, challenge, robots
from plinth.operators import audit, dedup, exact, filters, index, ledger, normalise, provenance, reports, robust, serving
from plinth.sources import collection, payload, sinks, synthetic
from plinth.streaming import events, policy


def strata(spark, *groups):
    return spark.createDataFrame([(f"s{i}", f"{i}-{k}", None if v is None else float(v)) for i, g in enumerate(groups) for k, v in enumerate(g)], "stratum string, row string, value double")


def test_median_and_mad(spark):
    c = robust.centres(strata(spark, [10, 12, 14, 16, 18]), ["stratum"], "value", log=False).first()
    assert (c["centre"], c["mad"], c["n"]) == (14, 2, 5)
    assert robust.median_by_rank(strata(spark, [1, 2, 3, 10]), ["stratum"], "value").first()["median"] == 2.5


def test_quantiles_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1e-3, 501), "b": rng.integers(-3, 4, 400).astype(float), "c": np.array([7.5]), "d": np.exp(rng.normal(9, 3, 1000)), None: np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("e", None)], "g string, v double")
    got = {r["g"]: r for r in robust.quantiles(rows.repartition(5), ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.99}).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values) and got[g]["mean"] == pytest.approx(values.mean())
        assert [got[g][k] for k in ("low", "mid", "high")] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])))


def test_quantiles_of_nothing_and_of_odd_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (-0.0,)], "v double")
    assert robust.quantiles(rows, [], "v", {"mid": 0.5}).first()["mid"] == 0
    assert robust.quantiles(rows.where("v is null"), [], "v", {"mid": 0.5}).isEmpty()
    empty = serving.summary(rows.where("v is null"), "v").first()
    assert (empty["n"], empty["lowest"], empty["median"]) == (0, None, None)


def test_filters_refuse_unknown_names_and_false_derived_ones_restrict_nothing(spark):
    rows = spark.createDataFrame([("DEL-BOM", None), (None, 5.0), ("", 6.0)], "route string, total double")
    assert filters.asked(rows, {"priced_only": True}, filters.FARES, filters.FARES_DERIVED).count() == 2
    assert filters.asked(rows, {"priced_only": False}, filters.FARES, filters.FARES_DERIVED).count() == 3
    assert filters.asked(rows, {"national": True}, filters.SERIES).count() == 1
    with pytest.raises(ValueError, match="no such filter"):
        filters.asked(rows, {"nothing": 1}, filters.FARES)


def test_weight_sets_that_cannot_be_used(spark):
    sets = {"duplicate unit": [("a", 1.0), ("a", 2.0)], "zero total": [("a", 0.0)], None: [("a", 1.0), ("b", 3.0)]}
    for error, rows in sets.items():
        got = reports.strict_shares(spark.createDataFrame(rows, "unit string, q double"), "unit", "q").collect()
        assert {r["error"] for r in got} == {error} and (error is None) == all(r["share"] is not None for r in got)


def test_a_sweep_leaves_tripped_breakers_alone(spark):
    rows = spark.createDataFrame([("OPEN", 0.0), ("OPEN", 95.0), ("TRIPPED_PERMANENT", 0.0), ("CLOSED", 0.0)], "state string, opened double")
    assert [r["swept"] for r in reports.swept(rows, F.lit(100.0), 10.0).collect()] == ["HALF_OPEN", "OPEN", "TRIPPED_PERMANENT", "CLOSED"]


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert lineage.shared_folder(Session(**{"spark.master": "spark://m:7077", "spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert lineage.shared_folder(Session(**{"spark.master": "local[2]", "spark.sql.warehouse.dir": "/w"})) == "/w/_shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session(**{"spark.master": "local-cluster[2,1,1024]", "spark.sql.warehouse.dir": "/w"}))


def test_one_outlier_is_found_and_no_row_is_lost(spark):
    rows = strata(spark, [5000] * 9 + [5100, 4900, 5200, 48000])
    out = robust.flagged(robust.scored(rows, ["stratum"], "value", log=False), ["stratum"], "row")
    assert out.count() == 13
    assert [r["value"] for r in out.where("is_outlier").collect()] == [48000]


@pytest.mark.parametrize(
    ("values", "log", "method", "n"),
    [([5000] * 9 + [9000], False, "MODIFIED_Z_MEANAD", 10), ([5000] * 12, True, "DEGENERATE_ZERO_SCALE", 12), ([100, 100000], True, "INSUFFICIENT_DATA", 2), ([5000] * 10 + [None], True, "DEGENERATE_ZERO_SCALE", 10), ([-1, 5, 6, 7, 8, 9], None, "MODIFIED_Z_MAD", 6)],
)
def test_methods(spark, values, log, method, n):
    out = robust.scored(strata(spark, values), ["stratum"], "value", log).first()
    assert (out["method"], out["n"]) == (method, n)


def pairs(spark, rows):
    return spark.createDataFrame([("c", f"{i:04d}", float(b), float(c)) for i, (b, c) in enumerate(rows)], "cell string, item string, base_price double, current_price double")


@pytest.mark.parametrize(
    ("rows", "fraction", "least", "level", "used", "trimmed", "rejected"),
    [
        ([(5000, 5400)] * 20, 0.0, 5, 108.0, 20, 0, 0),
        ([(1000, 2000), (1000, 500)], 0.0, 1, 100.0, 2, 0, 0),
        ([(1000, 1100), (1000, 0)], 0.0, 1, 110.0, 1, 0, 1),
        ([(1000, 1000)] * 48 + [(1000, 100000), (1000, 10)], 0.02, 5, 100.0, 48, 2, 0),
        ([(1000, 1100)] * 3, 0.0, 5, None, 3, 0, 0),
    ],
)
def test_jevons(spark, rows, fraction, least, level, used, trimmed, rejected):
    out = index.jevons(pairs(spark, rows), ["cell"], "item", fraction, least).first()
    assert (out["level"], out["n_pairs"], out["n_trimmed"], out["n_rejected"]) == (level, used, trimmed, rejected)


def test_exact_tier(spark):
    from decimal import Decimal

    out = exact.jevons_exact(pairs(spark, [(5000, 5400)] * 20), ["cell"]).first()
    assert out["level"] == Decimal("108.00000000") and out["n_pairs"] == 20


def test_robots_rules(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nCrawl-delay: 2.5\n\nUser-agent: plinth\nDisallow: /\nAllow: /open"
    robots.register(spark)
    spark.createDataFrame([("o", text)], "origin string, text string").createOrReplaceTempView("robots_texts")
    rules = spark.sql("select t.origin, r.* from robots_texts t, lateral robots_rules(t.text) r")
    asked = spark.createDataFrame([("o", "/x/1"), ("o", "/x/y/2"), ("o", "/z"), ("p", "/x")], "origin string, path string")
    got = lambda agent: {(r["origin"], r["path"]): (r["allowed"], r["crawl_delay"]) for r in robots.verdicts(asked, rules, agent).collect()}
    assert got("other") == {("o", "/x/1"): (False, 2.5), ("o", "/x/y/2"): (True, 2.5), ("o", "/z"): (True, 2.5), ("p", "/x"): (True, None)}
    assert {k: v[0] for k, v in got("Plinth-Bot").items()} == {("o", "/x/1"): False, ("o", "/x/y/2"): False, ("o", "/z"): False, ("p", "/x"): True}


def test_laspeyres_leaves_out_and_renormalises(spark):
    elem = spark.createDataFrame([(1, "a", 110.0, 10, True), (1, "b", None, 2, False)], "w int, route string, level double, n_pairs long, is_computable boolean")
    shares = index.shares(spark.createDataFrame([("a", 60.0), ("b", 30.0), ("c", 10.0)], "route string, passengers double"), [])
    parts = index.laspeyres(elem, shares, ["w"], "route")
    reasons = {r["route"]: r["exclusion"] for r in parts.collect()}
    assert reasons == {"a": None, "b": "too few pairs", "c": "no elementary index"}
    head = index.headline(parts, ["w"]).first()
    assert (head["level"], head["coverage"], head["n_included"]) == (110.0, 0.6, 1)


def test_growth_is_null_over_gaps(spark):
    s = spark.createDataFrame([("r", "2024-01-01", 100.0), ("r", "2024-01-02", 110.0), ("r", "2024-01-04", 121.0)], "route string, day string, v double").withColumn("day", F.to_date("day"))
    out = [r["g"] for r in index.growth(s, ["route"], "day", "v", {"g": 1}).orderBy("day").collect()]
    assert out == [None, 10.0, None]


def merkle(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex() if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_merkle_root(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    got = spark.createDataFrame([(leaves,)], "leaves array<string>").select(provenance.merkle_root(F.col("leaves")).alias("r")).first()["r"]
    assert got == merkle(leaves)


def test_merkle_by_in_subtrees(spark):
    sizes = {None: 5, "a": 1, "b": 2, "c": 4, "d": 7, "e": 16, "f": 17, "g": 33, "h": 70, "none": 0}
    leaves = {g: sorted(hashlib.sha256(f"{g}{i}".encode()).hexdigest() for i in range(n)) for g, n in sizes.items()}
    rows = [(g, x) for g, xs in leaves.items() for x in [*xs, *xs[:2], None]]
    for levels, prefix in ((1, 1), (2, 1), (2, 4), (10, 4)):
        out = provenance.merkle_by(spark.createDataFrame(rows, "g string, leaf string"), ["g"], "leaf", levels, prefix).collect()
        assert {r["g"]: (r["n_leaves"], r["root"]) for r in out} == {g: (len(xs), merkle(xs)) for g, xs in leaves.items()} and len(out) == len(sizes)


def test_merkle_root_query_covers_every_line(spark, tmp_path):
    from plinth.plans import registry

    line = [(k, n, 7, 1 + k % 3, f"199{k % 4 + 3}-0{n}-15") for k in range(20) for n in (1, 2, 3)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate string").selectExpr("*", "1.0d as l_extendedprice", "1.0d as l_quantity", "0.0d as l_discount", "0.0d as l_tax", "'N' as l_returnflag", "'O' as l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i}") for i in (1, 2, 3)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, n, s, item, day in line:
        want.setdefault((f"Brand#{item}", day[:7]), []).append(hashlib.sha256("\x1f".join(map(str, (k, n, s, item))).encode()).hexdigest())
    got = {(r["route"], r["month"]): (r["n_leaves"], r["root"]) for r in registry.queries()["merkle_root"](spark, str(tmp_path)).collect()}
    assert got == {g: (len(x), merkle(sorted(x))) for g, x in want.items()}


def test_chain_and_its_verification(spark):
    rows = spark.createDataFrame([("a", i, f"body {i}") for i in range(6)] + [("b", 0, "x")], "s string, k long, body string")
    chain = provenance.chained(rows, ["s"], "k", "body")
    last = ""
    for r in chain.where("s = 'a'").orderBy("k").collect():
        assert r["previous_hash"] == last
        last = hashlib.sha256((last + r["body"]).encode()).hexdigest()
        assert r["chain_hash"] == last
    bad = chain.withColumn("body", F.when((F.col("s") == "a") & (F.col("k") == 3), "changed").otherwise(F.col("body")))
    found = {r["s"]: (r["valid"], r["first_broken"]) for r in provenance.verified(bad, ["s"], "k", "body").collect()}
    assert found == {"a": (False, 3), "b": (True, None)}


def test_ancestors_of_a_long_line(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "child string, parent string")
    out = provenance.ancestors(edges)
    assert out.count() == 45
    assert out.where("node = 'n0' and ancestor = 'n9'").first()["distance"] == 9


def test_ancestors_of_a_lineage_deeper_than_64(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(150)], "child string, parent string")
    out = provenance.ancestors(edges)
    assert out.count() == 150 * 151 // 2
    assert out.where("node = 'n0' and ancestor = 'n150'").first()["distance"] == 150
    assert provenance.ancestors(edges.limit(9), most=9).count() == 45
    with pytest.raises(ValueError):
        provenance.ancestors(edges, most=64)


def test_survivor_order_and_reasons(spark):
    rows = spark.createDataFrame(
        [("f1", 1, 5, 10, "a", 100.0), ("f1", 2, 9, 20, "b", 104.0), ("f2", 1, 5, 10, "a", 100.0), ("f2", 1, 5, 11, "b", 100.5), ("f3", 1, 5, 10, "a", 9.0), ("f3", 1, 5, 10, "a", 9.0), ("f4", 1, 5, 10, "a", 9.0), ("f5", 1, 7, 10, "a", 9.0), ("f5", 1, 5, 10, "b", 9.0)],
        "fp string, trust int, complete int, seen int, content string, price double",
    )
    out = dedup.survivors(rows, "fp", "trust", "complete", "seen", "content", "price")
    got = {r["fp"]: (r["dedup_reason"], r["conflict"], r["seen"]) for r in out.where("place = 1").collect()}
    assert got == {"f1": ("source_trust", True, 10), "f2": ("freshness", False, 11), "f3": ("exact_duplicate", False, 10), "f4": ("unique", False, 10), "f5": ("completeness", False, 10)}


def test_digest_tokens_keep_missing_apart(spark):
    row = spark.createDataFrame([(None, "4521.50", " ab ")], "a string, b string, c string").select(dedup.token(F.col("a")).alias("a"), dedup.token(F.col("b").cast("decimal(12,4)"), "decimal").alias("b"), dedup.token(F.col("c")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("\0MISSING", "4521.5", "AB")


def test_component_audit_grades(spark):
    schema = "id string, total decimal(12,2), base_fare decimal(12,2), udf decimal(12,2), psf decimal(12,2), asf decimal(12,2), gst decimal(12,2), other_charges decimal(12,2)"
    from decimal import Decimal as D

    d = lambda *x: tuple(None if v is None else D(v) for v in x)
    rows = spark.createDataFrame([("full", *d(100, 50, 10, 10, 10, 10, 10)), ("gap", *d(100, 50, 10, 10, 10, None, 10)), ("two", *d(100, 50, None, None, 10, 10, 10)), ("off", *d(100, 50, 10, 10, 10, 10, 5)), ("none", *d(None, 50, 10, 10, 10, 10, 10)), ("zero", *d(90, 50, 0, 10, 10, 10, 10))], schema)
    got = {r["id"]: (r["quality_grade"], r["derived"], list(r["flags"])) for r in audit.component_audit(rows).collect()}
    assert got == {"full": ("A", None, []), "gap": ("A", "gst", ["COMPONENT_DERIVED"]), "two": ("B", None, ["PARTIAL_BREAKDOWN"]), "off": ("C", None, ["TOTAL_MISMATCH"]), "none": ("D", None, []), "zero": ("A", None, ["EXPLICIT_ZERO"])}


def test_filters_refuse_unknown_names(spark):
    rows = spark.range(5)
    assert serving.filtered(rows, {"id__gte": 3}).count() == 2
    with pytest.raises(ValueError):
        serving.filtered(rows, {"nope": 1})
    with pytest.raises(ValueError):
        serving.ordered(rows, "-nope", ("id",))


def test_pages_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i // 3, f"k{i:02d}") for i in range(20)], "day int, key string")
    seen, cursor = [], None
    while part := serving.keyset_page(rows, "day", "key", cursor, 7).collect():
        seen += [r["key"] for r in part]
        cursor = (part[-1]["day"], part[-1]["key"])
    assert sorted(seen) == sorted(r["key"] for r in rows.collect()) and len(seen) == 20


def test_local_times(spark):
    rows = spark.createDataFrame([("2024-03-05 06:10", "Tue-05Mar2024 06:10", "7:05 pm")], "a string, b string, c string")
    r = rows.select(canonical.local_timestamp(F.col("a")).cast("string").alias("a"), canonical.agency_timestamp(F.col("b")).cast("string").alias("b"), canonical.clock_time(F.col("c")).alias("c"), canonical.local_timestamp(F.lit("2024-03-05T06:10:00+05:30")).cast("string").alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("2024-03-05 00:40:00", "2024-03-05 00:40:00", "19:05", "2024-03-05 00:40:00")


def test_challenge_detect_searches_long_pages(spark, tmp_path):
    from plinth.plans import registry

    spark.createDataFrame([(i, "u", "<p>text</p>" * 60_000) for i in (7, 8, 9, 10)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["vendor"] for r in registry.queries()["challenge_detect"](spark, str(tmp_path)).collect()}
    assert got == {7: "cloudflare", 8: "generic_block", 9: "http_block"}
    body = F.concat(F.repeat(F.lit("x"), 9000), F.lit("access denied"))
    r = spark.range(1).select(challenge.detect(F.lit(200), None, body).alias("whole"), challenge.detect(F.lit(200), None, body, snippet=8192).alias("start")).first()
    assert r["whole"]["vendor"] == "generic_block" and r["start"] is None


def test_challenge_order(spark):
    rows = spark.createDataFrame([(200, {"cf-mitigated": "challenge"}, ""), (200, {}, "please solve the hCaptcha at hcaptcha.com"), (403, {}, ""), (200, {}, "fine"), (429, {}, "")], "status int, headers map<string,string>, body string")
    got = [r["v"] for r in rows.select(challenge.detect(F.col("status"), F.col("headers"), F.col("body"))["vendor"].alias("v")).collect()]
    assert got == ["cloudflare", "hcaptcha", "http_block", None, None]


def test_payload_mapping_keeps_absence(spark):
    body = json.dumps({"data": {"fares": [{"p": {"total": "4,500"}, "left": 0}, {"p": {}, "left": 3}]}})
    raw = spark.createDataFrame([(1, body), (2, "not json")], "raw_id int, payload string")
    m = payload.Mapping("$.data.fares", {"total": "$.p.total"}, ("$.left", "equals", 0))
    got = [(r["raw_id"], r["total"], r["is_sold_out"]) for r in payload.extract(raw, m).collect()]
    assert got == [(1, "4,500", True), (1, None, False)]


def test_segment_lookup(spark):
    body = json.dumps({"j": [{"s": [{"b": [{"FL": ["k1"]}], "lstFr": [{"BF": 10.5, "TF": 12.0}]}, {"b": [{"FL": ["k9"]}], "lstFr": []}]}], "dctFltDtl": {"k1": {"AC": "6E", "FN": "615", "DDT": "Tue-05Mar2024", "DTM": "06:10"}}})
    got = [(r["key"], r["carrier"], None if r["total"] is None else float(r["total"])) for r in payload.segment_lookup(spark.createDataFrame([(body,)], "payload string")).collect()]
    assert got == [("k1", "6E", 12.0), ("k9", None, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "ingress_hash string, v int")
    assert sinks.write_once(rows, f"{tmp_path}/raw") == (2, 0)
    assert sinks.write_once(rows.unionAll(spark.createDataFrame([("h3", 3)], rows.schema)), f"{tmp_path}/raw") == (1, 2)
    old = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 1)], "day string, k string, v int")
    sinks.upsert(old, f"{tmp_path}/gold", ["day", "k"], ["v"], "day")
    sinks.upsert(spark.createDataFrame([("d1", "a", 5), ("d1", "c", 6)], old.schema), f"{tmp_path}/gold", ["day", "k"], ["v"], "day")
    assert sorted((r["day"], r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/gold").collect()) == [("d1", "a", 5), ("d1", "c", 6), ("d2", "b", 1)]


def test_breaker_and_bucket_steps():
    b, state, seen = policy.Breaker(threshold=2, cooldown=10), ("CLOSED", 0, 0.0), []
    for at, event in [(0, "failure"), (1, "failure"), (5, "success"), (12, "failure"), (23, "success"), (24, "challenge"), (99, "success"), (100, "resume"), (101, "force_resume")]:
        state, out = b.step(state, at, event)
        seen.append(out[0])
    assert seen == ["allowed", "opened", "denied", "opened", "allowed", "tripped", "denied", "refused", "resumed"]
    k = policy.Bucket(rate=1.0, capacity=2.0)
    state, grants = k.start(), []
    for at in (0, 0, 0, 1, 1):
        state, out = k.step(state, at, "")
        grants.append(out[0])
    assert grants == [True, True, False, True, False]


def test_stream_state_equals_fold(spark, tmp_path):
    rows = [(s, i, float(i), "failure" if (i * 7 + s) % 3 else "success") for s in range(3) for i in range(30)]
    table = spark.createDataFrame(rows, "source long, seq long, at double, event string")
    for part in range(3):
        table.where(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    machine = policy.Breaker(threshold=3, cooldown=5)
    want = sorted(map(tuple, policy.fold(table, "source", machine).collect()))
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, events.run_to_table(policy.stateful(stream, "source", machine), "append").collect()))
    assert got == want


def test_synthetic_source_is_repeatable(spark):
    name = synthetic.register(spark)
    load = lambda: sorted(map(tuple, spark.read.format(name).option("routes", "A-B,C-D").option("windows", "1,30").load().fillna(0).collect()), key=str)
    first = load()
    assert len(first) == 2 * 2 * 18 and first == load()
    assert synthetic.entries() == ["synthetic"]


def test_late_data_is_flagged_not_dropped(spark):
    t = lambda x: datetime.fromisoformat(x)
    rows = spark.createDataFrame([(t("2024-01-10 00:00"), t("2024-01-03 00:00")), (t("2024-01-01 00:00"), t("2024-01-03 00:00")), (t("2024-03-10 00:00"), t("2024-01-03 00:00"))], "d timestamp, o timestamp")
    assert [r["f"] for r in rows.select(events.flag_timing(F.col("d"), F.col("o"), F.lit(7)).alias("f")).collect()] == ["ok", "rejected", "stale"]


def test_overlaps_reach_beyond_the_version_just_before(spark):
    rows = [("a", 1, 10), ("a", 2, 3), ("a", 5, 6), ("a", 10, 12), ("b", 1, None), ("b", 4, 5), ("b", 9, None), ("c", 1, 2), ("c", 2, 3)]
    weights = spark.createDataFrame(rows, "route string, valid_from int, valid_to int")
    got = {tuple(r) for r in index.overlapping_weights(weights, ["route"]).collect()}
    assert got == {("a", 2, 3), ("a", 5, 6), ("b", 4, 5), ("b", 9, None)}


@pytest.mark.parametrize("profile, carriers", [("standard", 6), ("legacy", 5)])
def test_synthetic_source_and_expressions_give_one_feed(spark, profile, carriers):
    name = synthetic.register(spark)
    read = spark.read.format(name).option("routes", "A-B,C-D").option("windows", "1,4,14,60").option("day", "2024-03-09").option("profile", profile).load()
    tasks = spark.createDataFrame([(r, w, datetime(2024, 3, 9).date()) for r in ("A-B", "C-D") for w in (1, 4, 14, 60)], "route string, lead_window int, observed_on date")
    made = synthetic.fares_feed(tasks, profile=profile)
    assert read.count() == 8 * carriers * 3
    assert read.exceptAll(made).isEmpty() and made.exceptAll(read).isEmpty()


def test_raw_feed_leaves_out_what_is_unknown(spark):
    tasks = spark.range(400).select(F.concat(F.lit("R"), "id").alias("route"), F.lit(2).alias("lead_window"), F.lit("2024-03-05").cast("date").alias("observed_on"))
    rows = synthetic.raw_feed(tasks).cache()
    gone = rows.where("inventory_status = 'SOLD_OUT'")
    assert gone.count() > 0 and gone.where("coalesce(total_fare, base_fare, gst, other_charges) is not null").isEmpty()
    partial = rows.where("inventory_status = 'AVAILABLE' and base_fare is null")
    assert partial.count() > 0 and partial.where("total_fare is null or gst is not null").isEmpty()
    assert not rows.where("other_charges = '0.00'").isEmpty() and not rows.where("total_fare like '₹ %,%'").isEmpty() and not rows.where("shock > 1").isEmpty()


def money(value, status="ok"):
    return (None if value is None else Decimal(value), status)


@pytest.mark.parametrize("parts, total, states, value, flags, trusted, eligible", [
    ([money("900"), money("60"), money("40"), money("0")], money("1000"), ["present", "present", "present", "explicit_zero"], "1000.00", {"components_complete", "explicit_zero_present"}, True, True),
    ([money("900"), money(None, "missing"), money("40"), money("0")], money("1000"), ["present", "derived", "present", "explicit_zero"], "1000.00", {"component_missing", "component_derived", "components_complete", "explicit_zero_present"}, True, True),
    ([money("900"), money(None, "missing"), money(None, "unparseable"), money("1")], money("1000"), ["present", "missing", "unparseable", "present"], "1000.00", {"component_missing", "component_unparseable"}, False, True),
    ([money(None, "negative_rejected"), money("60"), money("40"), money("1")], money("1000"), ["derived", "present", "present", "present"], "1000.00", {"component_derived", "component_unparseable", "components_complete", "negative_value"}, False, False),
    ([money(None, "missing")] * 4, money("1000"), ["missing"] * 4, "1000.00", {"all_in_price_only", "component_missing"}, False, True),
    ([money("900"), money("60"), money("40"), money("1")], money(None, "missing"), ["present"] * 4, "1001.00", {"components_complete", "total_derived"}, True, True),
    ([money("900"), money("60"), money("40"), money("200")], money("1000"), ["present"] * 4, "1000.00", {"total_mismatch"}, False, False),
    ([money("2000"), money(None, "missing"), money("40"), money("1")], money("1000"), ["present", "missing", "present", "present"], "1000.00", {"component_missing"}, False, True),
    ([money(None, "missing"), None, money("40"), money("1")], None, ["missing", "missing", "present", "present"], None, {"component_missing", "total_missing"}, False, False),
])
def test_breakdown(spark, parts, total, states, value, flags, trusted, eligible):
    names = ("a", "b", "c", "d")
    kind = "struct<value:decimal(12,2),status:string>"
    rows = spark.createDataFrame([(*parts, total)], ", ".join(f"{n} {kind}" for n in (*names, "t")))
    r = audit.breakdown(rows, names, "t").first()
    assert [r[f"{n}_state"] for n in names] == states and r["t_value"] == (None if value is None else Decimal(value))
    assert set(r["flags"]) == flags and r["flags"] == sorted(r["flags"]) and (r["breakdown_trusted"], r["index_eligible"]) == (trusted, eligible)


def test_breakdown_without_derivation(spark):
    kind = "struct<value:decimal(12,2),status:string>"
    r = audit.breakdown(spark.createDataFrame([(money("9"), money(None, "missing"), money("10"))], f"a {kind}, b {kind}, t {kind}"), ("a", "b"), "t", derive=False).first()
    assert r["b_state"] == "missing" and r["flags"] == ["component_missing"] and r["component_sum"] is None


def test_canonical_text_of_every_kind(spark):
    made = spark.sql("""select cast(100 as decimal(20,8)) as a, cast(0 as decimal(20,8)) as b, cast(-0.00000012 as decimal(20,8)) as c, cast(1200 as decimal(10,0)) as d, true as e, 5L as f, 'a"b\\\\c' || chr(10) as g,
      date '2026-09-01' as h, timestamp '2026-09-01 05:30:00' as i, timestamp '2026-09-01 05:30:00.25' as j, array('x', null) as k, map('z', 1, 'y', null) as l, named_struct('q', 1.50, 'p', array(1)) as m, cast(null as string) as n""")
    text = provenance.with_canonical(made, {c: F.col(c) for c in reversed(made.columns)}).first()["body"]
    assert text == ('{"a":"100","b":"0","c":"-0.00000012","d":"1200","e":true,"f":5,"g":"a\\"b\\\\c\\n","h":"2026-09-01","i":"2026-09-01T05:30:00+00:00",'
                    '"j":"2026-09-01T05:30:00.250000+00:00","k":["x",null],"l":{"y":null,"z":1},"m":{"p":[1],"q":"1.5"},"n":null}')
    with pytest.raises(TypeError):
        provenance.with_canonical(made.withColumn("x", F.lit(1.5)), {"x": F.col("x")})


def test_seals_bind_value_inputs_and_predecessor(spark):
    def heads(value="108.00", hashes=("ab" * 32, "cd" * 32), previous=""):
        rows = spark.createDataFrame([("N", 1, Decimal(value), list(hashes)), ("N", 2, Decimal("109"), ["ef" * 32])], "scope string, seq int, value decimal(20,8), hashes array<string>")
        out = provenance.sealed(rows, ["scope"], "seq", {"scope": F.col("scope"), "index_value": F.col("value"), "diagnostics": F.struct(F.lit(1).alias("n"))}, F.col("hashes"), previous)
        return [(r["previous_hash"], r["provenance_hash"]) for r in out.orderBy("seq").collect()]

    plain = heads()
    root = hashlib.sha256(bytes.fromhex("ab" * 32 + "cd" * 32)).hexdigest()
    body = f'{{"diagnostics":{{"n":1}},"index_value":"108","input_count":2,"inputs_root":"{root}","previous_hash":"","scope":"N"}}'
    assert plain[0] == ("", hashlib.sha256(body.encode()).hexdigest()) and plain[1][0] == plain[0][1]
    assert heads(hashes=("cd" * 32, "ab" * 32, "ab" * 32)) == plain and heads(value="108") == plain
    for other in (heads(value="108.01"), heads(hashes=("ab" * 32,)), heads(previous="x")):
        assert other[0][1] != plain[0][1] and other[1][1] != plain[1][1]


def test_normalised_rows(spark):
    schema = "origin string, destination string, carrier_code string, cabin string, currency string, departure_date string, observation_ts string, total_value decimal(12,2)"
    rows = [("del", "B OM", "6e", None, None, "2026-09-08", "2026-09-01T04:00:00Z", Decimal("5")), (None,) * 8, ("DEL", "BOM", "AI", "biz", "₹", "2026-08-30T10:00", "2026-09-01", Decimal("0"))]
    marked = normalise.normalised(spark.createDataFrame(rows, schema).withColumn("other", F.lit(1)))
    good, bad = normalise.split(marked)
    kept = {(r["origin"], r["destination"], r["carrier_code"], r["cabin"], r["currency"], r["days_to_departure"], *r["issues"]) for r in good.collect()}
    assert kept == {("DEL", "BOM", "6E", "ECONOMY", "INR", 7), ("DEL", "BOM", "AI", "BUSINESS", "INR", 0, "total_fare:unusable_total")}
    assert [r["issues"] for r in bad.collect()] == [["origin:invalid_station", "destination:invalid_station", "carrier_code:invalid_carrier", "departure_date:unparseable", "observation_ts:unparseable", "total_fare:unusable_total"]]


def test_counters_refuse_unknown_names(spark):
    with pytest.raises(ValueError, match="no such counter"):
        reports.run_counters(spark.range(1), [], {"lost": F.lit(True)})
    assert reports.run_counters(spark.range(3), [], {"currency_failures": F.col("id") == 1}).first()["written"] == 2


def test_long_chains_and_null_series(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("s"), F.col("id").alias("k"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("body"), F.lit(1).alias("previous"))
    got = {(r["s"], r["k"]): (r["previous_hash"], r["chain_hash"]) for r in provenance.chained(rows.repartition(5), ["s"], "k", "body", "g").collect()}
    assert len(got) == 3000
    for s, start in ((None, 0), ("s1", 1), ("s2", 2)):
        last = "g"
        for k in range(start, 3000, 3):
            before, last = last, hashlib.sha256((last + ("" if k == 7 else str(k))).encode()).hexdigest()
            assert got[s, k] == (before, last)


def test_ledger_goes_on_from_its_heads(spark, tmp_path):
    rows = spark.createDataFrame([(s, k, f"{s}{k}") for s in ("a", "b", None) for k in range(6)] + [("c", 4, "x")], "s string, k long, body string")
    path = f"{tmp_path}/ledger"
    ledger.append(rows.where("k < 3"), path, ["s"], "k", "body")
    ledger.append(rows.where("k >= 3"), path, ["s"], "k", "body")
    whole = provenance.chained(rows, ["s"], "k", "body")
    kept = ledger.records(spark, path, rows.select("s").schema, "k", "body")
    assert whole.exceptAll(kept).isEmpty() and kept.count() == 19
    for k in (5, None):
        with pytest.raises(ValueError):
            ledger.append(spark.createDataFrame([("a", k, "again")], rows.schema), path, ["s"], "k", "body")
    assert all(r["valid"] for r in ledger.checked(spark, path, ["s"], "k", "body").collect())


def test_a_halt_ends_its_source_only(spark):
    def fetch(task):
        if task["what"] == "raise":
            raise ValueError("no such page")
        if task["what"] in ("halt", "block"):
            raise collection.Refused("challenge", halted=task["what"] == "halt")
        return 200, task["what"] or ""

    rows = [("a", 1, "x"), ("a", 2, "halt"), ("a", 3, "x"), ("b", 1, "raise"), ("b", 2, "block"), ("b", 3, None), (None, 1, "y"), ("b", 9, "y")]
    tasks = spark.createDataFrame(rows, "source string, seq int, what string").withColumn("error_of", F.lit(1))
    out = collection.collect(tasks, fetch, refused=F.when(F.col("seq") == 9, "beyond horizon"))
    got = {(r["source"], r["seq"]): (r["outcome"], r["error_kind"], r["payload"]) for r in out.collect()}
    assert got == {
        ("a", 1): ("ok", None, "x"), ("a", 2): ("halted", "Refused", None), ("a", 3): ("abandoned", None, None), ("b", 1): ("failed", "ValueError", None),
        ("b", 2): ("blocked", "Refused", None), ("b", 3): ("ok", None, ""), (None, 1): ("ok", None, "y"), ("b", 9): ("refused", None, None),
    }
    assert collection.collect(tasks.where("false"), fetch).isEmpty()


def test_landed_files_and_their_marks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('{"x":\n 1}')
    (tmp_path / "in" / "deep" / "b.json").write_text("not json")
    raw = collection.landed(spark, f"{tmp_path}/in")
    assert {(r["payload"], r["is_json"]) for r in raw.collect()} == {('{"x":\n 1}', True), ("not json", False)}
    done = spark.createDataFrame([(hashlib.sha256(b"not json").hexdigest(),)], "ingress_hash string")
    assert [r["is_json"] for r in collection.unprocessed(raw, done).collect()] == [True]
    of_run = collection.unprocessed(raw.withColumn("run", F.lit("r1")), done, "r2")
    assert of_run.isEmpty() and "run" in of_run.columns
    table = events.run_to_table(collection.landed(spark, f"{tmp_path}/in", stream=True), "append")
    assert table.count() == 2


def test_audit_log_and_empty_batches(spark, tmp_path):
    sinks.audit(spark, f"{tmp_path}/audit", ("publish", "N", None, "108"), ("withdraw", "N", "108", None))
    sinks.audit(spark, f"{tmp_path}/audit", ("publish", "N", None, "109"))
    assert spark.read.parquet(f"{tmp_path}/audit").where("at is not null").count() == 3
    rows = spark.createDataFrame([("h1", 1), ("h1", 2)], "ingress_hash string, v int")
    assert sinks.write_once(rows, f"{tmp_path}/raw") == (1, 1)
    assert sinks.write_once(rows, f"{tmp_path}/raw") == (0, 2)
    assert sinks.write_once(rows.where("false"), f"{tmp_path}/raw") == (0, 0)


def test_jobs_bear_their_correlation(spark):
    from plinth.session import tagged

    with tagged(spark, "run-7"):
        assert "run-7" in spark.getTags()
    assert "run-7" not in spark.getTags()


def test_exact_laspeyres_leaves_out_and_renormalises(spark):
    levels = spark.createDataFrame([(1, "a", Decimal("110")), (1, "b", None), (2, "a", Decimal("110")), (2, "b", Decimal("90")), (3, "a", None)], "w int, route string, level decimal(20,8)")
    weights = spark.createDataFrame([("a", Decimal("0.6")), ("b", Decimal("0.4"))], "route string, share decimal(12,10)")
    got = {r["w"]: (r["level"], r["coverage"], r["n_included"]) for r in exact.laspeyres_exact(levels, weights, ["w"], "route").collect()}
    assert got == {1: (Decimal("110"), Decimal("0.6"), 1), 2: (Decimal("102"), Decimal("1"), 2), 3: (None, Decimal("0"), 0)}


@pytest.mark.parametrize("status, at, closed, mode, reason", [
    (200, 1000, True, "parse", "robots_parsed"), (200, 87_400, True, "fetch", "robots_stale"), (404, 1000, True, "allow_all", "robots_unavailable:http_404"), (503, 1000, True, "disallow_all", "robots_unreachable:http_503"),
    (503, 8200, True, "fetch", "robots_stale"), (429, 1000, False, "allow_all", "robots_unreachable:http_429"), (None, 1000, True, "disallow_all", "robots_unreachable"), (200, 999, True, "fetch", "robots_stale"),
])
def test_robots_answers_age_and_fail_closed(spark, status, at, closed, mode, reason):
    asks = spark.createDataFrame([("https://h", at, 1)], "origin string, at long, more int")
    fetches = spark.createDataFrame([("https://h", 1000, status), ("https://other", 0, 200)], "origin string, fetched_at long, status int")
    out = robots.answered(asks, fetches, fail_closed=closed)
    assert out.columns == ["origin", "at", "more", "mode", "reason"] and [(r["mode"], r["reason"]) for r in out.collect()] == [(mode, reason)]


def test_merkle_by_with_signs_for_large_groups_only(spark):
    """Without a given prefix, groups of up to 2^levels rows are folded at once and larger ones by as many signs as they need."""
    leaves = {g: sorted(hashlib.sha256(f"{g}{i}".encode()).hexdigest() for i in range(n)) for g, n in {None: 300, "a": 1, "b": 8, "c": 9, "d": 700, "none": 0}.items()}
    rows = [(g, x) for g, xs in leaves.items() for x in [*xs, None]]
    out = provenance.merkle_by(spark.createDataFrame(rows, "g string, leaf string"), ["g"], "leaf", 3).collect()
    big = provenance.merkle_by(spark.createDataFrame(rows, "g string, leaf string"), ["g"], "leaf", 5).collect()
    want = {g: (len(xs), merkle(xs)) for g, xs in leaves.items() if len(xs) <= 64}
    assert {r["g"]: (r["n_leaves"], r["root"]) for r in out if r["g"] in want} == want
    assert {r["g"]: (r["n_leaves"], r["root"]) for r in big} == {g: (len(xs), merkle(xs)) for g, xs in leaves.items()}


def test_centres_are_the_same_however_large_a_stratum_is(spark):
    from plinth.operators import robust

    rows = spark.createDataFrame([(f"s{i % 7}", float((i * 37) % 101 - (20 if i % 7 == 3 else 0))) for i in range(400)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("gone", None)], "s string, v double")
    for log in (None, False):
        a, b = ({r["s"]: r for r in robust.centres(rows, ["s"], "v", log, one_task=size).collect()} for size in (1 << 20, 0))
        assert a.keys() == b.keys() and len(a) == 9
        for s, r in a.items():
            assert (r["n"], r["uses_log"]) == (b[s]["n"], b[s]["uses_log"])
            assert [r[c] for c in ("centre", "mad", "mean_deviation")] == pytest.approx([b[s][c] for c in ("centre", "mad", "mean_deviation")], rel=1e-12, abs=1e-12)


def test_screening_reports_what_flags_give_without_ranks(spark):
    rows = spark.createDataFrame([("cap", float(i % 3) if i < 12 else 1000.0 + i) for i in range(19)] + [("one", 5.0 + i % 4) for i in range(20)] + [("one", 900.0), ("few", 1.0), ("gone", None), (None, 3.0)], "s string, v double").withColumn("id", F.monotonically_increasing_id())
    scores = robust.scored(rows, ["s"], "v", log=False)
    got, want = robust.screening(scores, ["s"]), robust.report(robust.flagged(scores, ["s"], "id"), ["s"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert {r["s"]: r["n_outliers"] for r in got.collect()}["cap"] == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan
    flags = robust.flagged(scores, ["s"], "id").where("is_outlier").select("id")
    assert sorted(r[0] for r in robust.outliers(scores, ["s"], "id").select("id").collect()) == sorted(r[0] for r in flags.collect())
    # rows are not shuffled for a few strata
    assert "SortMergeJoin" not in scores._jdf.queryExecution().executedPlan().toString()


def test_digests_of_quotes_are_made_behind_the_only_shuffle_of_lines(spark, tiny):
    import re

    from plinth.plans import registry

    for name in ("dup_link", "survivor_select"):
        df = registry.queries()[name](spark, tiny)
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        line = plan.index("exchange hashpartitioning(l_orderkey")
        assert "sha2(" in plan[:line] and "sha2(" not in plan[line:]
        assert not re.search(r"exchange hashpartitioning\((?!l_orderkey)", plan[:line])


def test_survivors_by_fields_are_those_by_their_digest(spark):
    rows = spark.createDataFrame([(i % 5, i % 3, i % 2, i % 7, f"c{i % 11:02d}", float(i)) for i in range(60)], "a long, b long, trust long, seen long, content string, price double")
    rows = rows.withColumns({"complete": F.lit(1), "fp": dedup.digest([dedup.token(F.col("a")), dedup.token(F.col("b"))]), "key": F.concat_ws("-", "content", "price")})
    # content alone leaves ties open, which the price ends here
    rows = rows.withColumn("content", F.col("key"))
    out = [dedup.winners_linked(dedup.survivors(rows, by, "trust", "complete", "seen", "content", "price"), by, "key").select("key", "place", "members", "dedup_reason", "conflict", "duplicate_of") for by in ("fp", ["a", "b"])]
    assert sorted(map(str, out[0].collect())) == sorted(map(str, out[1].collect()))


def test_merkle_by_shuffles_leaves_once(spark):
    """Leaves are in one exchange, which both the count of parts and the fold read; what follows it are sizes and subtrees."""
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    for levels in (16, 4):
        df = provenance.merkle_by(rows, ["g"], "leaf", levels)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
        assert sum("_start" in x for x in shuffles) == 1
        # and of the subtrees, of the groups' counts, of the parts' sizes
        assert len([x for x in shuffles if "_start" not in x]) <= 3


def test_merkle_by_over_batches_and_kinds_of_leaves(spark):
    """Runs and groups that go over several batches, leaves as texts and as bytes, and keys that are NaN, zero of either sign or missing."""
    nan = float("nan")
    sizes = {nan: 37, 0.0: 21, None: 65, 2.5: 1, 7.0: 0, 8.0: 300}
    leaves = {g: sorted(hashlib.sha256(f"{g}{i}".encode()).hexdigest() for i in range(n)) for g, n in sizes.items()}
    rows = [(g if g != 0 or i % 2 else -0.0, i % 1, x) for g, xs in leaves.items() for i, x in enumerate([*xs, *xs[:3], None])]
    table = spark.createDataFrame(rows, "g double, h int, leaf string")
    want = sorted((str(g), len(xs), merkle(xs)) for g, xs in leaves.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for levels, prefix in ((16, None), (2, None), (16, 2)):
            for made in (table, table.withColumn("leaf", F.unhex("leaf"))):
                out = provenance.merkle_by(made, ["g", "h"], "leaf", levels, prefix).collect()
                assert sorted((str(r["g"]).replace("-0.0", "0.0"), r["n_leaves"], r["root"]) for r in out) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
