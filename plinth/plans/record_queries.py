"""Queries of whole records: breakdowns, normalisation, digests and seals, counters, tasks, and the feed as sources publish it."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import functions as F

from plinth.functions import canonical, robots
from plinth.operators import audit, dedup, ledger, normalise, provenance, reports
from plinth.plans.reading_queries import _GONE, _READ, _TOKEN, _read
from plinth.plans.serving_queries import _FARE, _FARE_SQL, _bodies
from plinth.plans.serving_queries import QUERIES as SERVING
from plinth.plans.standin import FARES_SQL, fares, feed_sql, table, uniform_sql
from plinth.sources import collection, payload, synthetic

_PARTS = ("base_fare", "surcharges", "taxes", "fees")
#: Which rows (order mod 8) lack a component: by name, and with which status.
_LACKS = {"base_fare": {1: "missing", 2: "negative_rejected", 5: "missing", 6: "unparseable"}, "surcharges": {3: "missing", 5: "missing"}, "taxes": {5: "missing"}, "fees": {5: "missing", 6: "unparseable"}}


def breakdown_audit(spark, d):
    f, k = fares(spark, d), F.pmod("l_orderkey", F.lit(8))
    money = {"base_fare": F.col("total") - 100, "surcharges": F.lit(60), "taxes": F.when(k == 4, 0).otherwise(40), "fees": F.when(k == 7, 500).otherwise(0)}

    def amount(value, lacks):
        status = reduce(lambda c, x: F.when(x[0], x[1]).otherwise(c), lacks, F.lit("ok"))
        return F.struct(F.when(status == "ok", value).cast("decimal(12,2)").alias("value"), status.alias("status"))

    cols = {c: amount(v, [(k == n, s) for n, s in _LACKS[c].items()]) for c, v in money.items()}
    whole = amount(F.col("total"), [(F.col("l_linenumber") == 1, "missing"), (F.col("l_linenumber") == 2, "unparseable")])
    rows = f.select(F.concat_ws("-", *_FARE).alias("fare"), *[c.alias(n) for n, c in cols.items()], whole.alias("total"))
    out = audit.breakdown(rows, _PARTS, "total")
    return out.select("fare", *[f"{c}_state" for c in _PARTS], "total_state", F.col("base_fare_value").cast("double").alias("base_fare"), F.col("total_value").cast("double").alias("total"), F.col("residual").cast("double").alias("residual"), F.concat_ws(",", "flags").alias("flags"), "breakdown_trusted", "index_eligible")


def _breakdown_sql() -> str:
    money = {"base_fare": "total - 100", "surcharges": "60", "taxes": "case when k = 4 then 0 else 40 end", "fees": "case when k = 7 then 500 else 0 end"}
    status = {c: "case k " + " ".join(f"when {n} then '{s}'" for n, s in _LACKS[c].items()) + " else 'ok' end" for c in _PARTS}
    state = "case when {0}_s = 'missing' then 'missing' when {0}_s <> 'ok' then 'unparseable' when {0}_v = 0 then 'explicit_zero' else 'present' end as {0}_st"
    count = lambda *kinds: " + ".join(f"cast({c}_st in {kinds if len(kinds) > 1 else repr(kinds).replace(',', '')} as int)" for c in _PARTS)
    said = {
        "all_in_price_only": "not whole and nu = 4 and tt is not null", "component_derived": "dv", "component_missing": "nm > 0", "component_unparseable": "np > 0", "components_complete": "whole and close",
        "explicit_zero_present": "nz > 0", "negative_value": "neg", "total_derived": "dt", "total_mismatch": "whole and not close", "total_missing": "tt is null",
    }
    return f"""with {FARES_SQL}, a as (select *, {_FARE_SQL} as fare, l_orderkey % 8 as k from fares),
i as (select fare, total as t, case l_linenumber when 1 then 'missing' when 2 then 'unparseable' else 'ok' end as t_s, {', '.join(f"cast({v} as decimal(12,2)) as {c}_v, {status[c]} as {c}_s" for c, v in money.items())} from a),
j as (select *, case when t_s = 'ok' then t end as tv, {', '.join(state.format(c) for c in _PARTS)} from i),
l as (select *, {count('missing', 'unparseable')} as nu, {count('missing')} as nm, {count('unparseable')} as np, {count('explicit_zero')} as nz, {' + '.join(f"case when {c}_s = 'ok' then {c}_v else 0 end" for c in _PARTS)} as known, {' or '.join(f"{c}_s = 'negative_rejected'" for c in _PARTS)} as neg from j),
m as (select *, coalesce(nu = 1 and tv >= known, false) as dv from l), n as (select *, nu = 0 or dv as whole from m),
o as (select *, whole and tv is null as dt, case when whole and tv is null then known else tv end as tt, case when dv then tv when whole then known end as parts from n),
q as (select *, coalesce(abs(tt - parts) <= greatest(0.05, abs(tt) * 0.005), false) as close from o)
select fare, {', '.join(f"case when dv and {c}_s <> 'ok' then 'derived' else {c}_st end as {c}_state" for c in _PARTS)}, case when dt then 'derived' when t_s = 'ok' and t = 0 then 'explicit_zero' when t_s = 'ok' then 'present' else t_s end as total_state,
  cast(case when base_fare_s = 'ok' then base_fare_v when dv then tv - known end as double) as base_fare, cast(tt as double) as total, cast(tt - parts as double) as residual,
  concat_ws(',', {', '.join(f"case when {test} then '{name}' end" for name, test in said.items())}) as flags, whole and close and not neg as breakdown_trusted, coalesce(tt > 0, false) and not neg and not (whole and not close) as index_eligible from q"""


def _messy(spark, d):
    f, k = fares(spark, d), F.pmod("l_orderkey", F.lit(9))
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), k.cast("int") + 1)
    return f.select(
        F.concat_ws("-", *_FARE).alias("fare"), pick("del", " BOM ", "D EL", "DELHI", "", None, "blr", "X1Z", "ccu").alias("origin"), F.lit("goi").alias("destination"),
        pick("6e", "AI", " u k", "6E9X", None, "qp", "ix", "sg", "I").alias("carrier_code"), pick("Economy", "J", None, "biz", "sleeper", "W", "f", "y", "").alias("cabin"),
        pick("₹", "inr", None, "Rs.", "$", "rupee", "€", "usd", "").alias("currency"), F.when(k == 2, F.lit("soon")).otherwise(F.date_format("observed_on", "yyyy-MM-dd")).alias("departure_date"),
        F.concat(F.date_format(F.date_add("observed_on", -F.col("lead_window")), "yyyy-MM-dd"), F.lit("T04:00:00Z")).alias("observation_ts"), F.when(F.col("l_linenumber") != 4, F.col("total") * (F.col("l_linenumber") - 3)).alias("total_value"),
        pick("6E 0615", "AI-202", "uk 07", "QP", "6E12345", None, "SG1", "IX - 9", "12").alias("flight_number"),
    )


def normalise_issues(spark, d):
    out = normalise.normalised(_messy(spark, d))
    return out.select("fare", "origin", "carrier_code", "cabin", "currency", normalise.flight(F.col("flight_number")).alias("flight"), "departure_date", "days_to_departure", F.concat_ws(",", "issues").alias("issues"), "is_clean")


def normalise_split(spark, d):
    """How many rows go on and how many are set apart, and under which issues."""
    good, bad = normalise.split(normalise.normalised(_messy(spark, d)))
    count = lambda part, kind: part.groupBy(F.concat_ws(",", "issues").alias("issues")).agg(F.count("*").alias("n")).withColumn("part", F.lit(kind))
    return count(good, "clean").unionByName(count(bad, "rejected"))


def _messy_sql() -> str:
    pick = lambda *words: "list_extract([" + ", ".join("null" if w is None else f"'{w}'" for w in words) + "], cast(l_orderkey % 9 as int) + 1)"
    named = {"cabin": "cabin:unknown_cabin", "currency": "currency:invalid_currency", "departure_date": "departure_date:unparseable"}
    tests = {"origin": "origin:invalid_station", "carrier_code": "carrier_code:invalid_carrier"} | named
    return f"""with {FARES_SQL}, clean as (select {_FARE_SQL} as fare, {pick('DEL', 'BOM', 'DEL', None, None, None, 'BLR', None, 'CCU')} as origin, {pick('6E', 'AI', 'UK', None, None, 'QP', 'IX', 'SG', None)} as carrier_code,
  {pick('ECONOMY', 'BUSINESS', 'ECONOMY', 'BUSINESS', None, 'PREMIUM_ECONOMY', 'FIRST', 'ECONOMY', 'ECONOMY')} as cabin, {pick('INR', 'INR', 'INR', 'INR', 'USD', None, 'EUR', 'USD', 'INR')} as currency, {pick('6E615', 'AI202', 'UK7', None, '6E12345', None, 'SG1', 'IX9', None)} as flight,
  case when l_orderkey % 9 <> 2 then observed_on end as departure_date, case when l_orderkey % 9 <> 2 then cast(lead_window as int) else 0 end as days_to_departure, case when l_linenumber <> 4 then total * (l_linenumber - 3) end as amount from fares),
marked as (select *, concat_ws(',', {', '.join(f"case when {c} is null then '{text}' end" for c, text in tests.items())}, case when coalesce(amount <= 0, true) then 'total_fare:unusable_total' end) as issues, {' and '.join(f'{c} is not null' for c in tests)} and amount is not null as is_clean from clean)"""


def canonical_nested(spark, d):
    """Digests of nested payloads: lists, structures, flags, days, decimals and nulls in one canonical text."""
    f = fares(spark, d)
    payload = {
        "item": F.col("item"), "total": F.col("total"), "observed_on": F.col("observed_on"), "note": F.concat(F.lit('a "'), F.col("route"), F.lit("\\")), "is_n": F.col("l_returnflag") == "N",
        "at": F.col("observed_on").cast("timestamp"), "nothing": F.lit(None).cast("string"), "inner": F.struct(F.col("l_linenumber").alias("n"), F.array("l_returnflag", "l_linestatus").alias("marks")),
    }
    return provenance.with_digest(f, payload, "digest").select(F.concat_ws("-", *_FARE).alias("fare"), "digest")


def weight_digest(spark, d):
    """Digests of the method and of each year's whole weight set: what a published value stood on."""
    w = fares(spark, d).groupBy("year", "route").agg(F.sum("quantity").cast("decimal(20,2)").alias("passengers"))
    sets = w.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("route", "passengers"))).alias("weights"))
    method = {"code": F.lit("JEVONS-LASPEYRES"), "base_level": F.lit("100.00").cast("decimal(6,2)"), "min_pairs": F.lit(5), "trim": F.lit("0.0200").cast("decimal(6,4)")}
    sets = provenance.with_digest(sets, {"year": F.col("year"), "weights": F.col("weights")}, "weight_set")
    return provenance.with_digest(sets, method, "methodology").select("year", "methodology", "weight_set")


def sealed_series(spark, d):
    """The seals of monthly values of each window, every one bound to its inputs, its method and the seal before it."""
    m = fares(spark, d).withColumn("index_date", F.trunc("observed_on", "month")).groupBy("lead_window", "index_date").agg(F.sum("total").alias("value"), F.count("*").alias("pairs"), F.collect_set(F.sha2("l_returnflag", 256)).alias("hashes"))
    m = m.withColumn("seq", F.year("index_date") * 12 + F.month("index_date"))
    fields = {
        "methodology_code": F.lit("M1"), "methodology_digest": F.lit(""), "scope": F.lit("NATIONAL"), "lead_window_days": F.col("lead_window"), "index_date": F.col("index_date"), "index_value": F.col("value"),
        "base_period": F.lit("1995"), "weight_set_digest": F.lit(""), "computed_at": F.col("index_date").cast("timestamp") + F.expr("interval 330 minutes"), "diagnostics": F.struct("pairs"),
    }
    return provenance.sealed(m, ["lead_window"], "seq", fields, F.col("hashes")).select("lead_window", "seq", "inputs_root", "input_count", "previous_hash", "provenance_hash")


_PAIR = "sha256(unhex({} || {}))"
_SEALED = f"""with recursive {FARES_SQL}, m as (select lead_window, cast(date_trunc('month', observed_on) as date) as day, sum(total) as v, count(*) as n, list_sort(list(distinct sha256(l_returnflag))) as l from fares group by all),
r as (select *, year(day) * 12 + month(day) as seq, case len(l) when 1 then l[1] when 2 then {_PAIR.format('l[1]', 'l[2]')} else {_PAIR.format(_PAIR.format('l[1]', 'l[2]'), _PAIR.format('l[3]', 'l[3]'))} end as root from m),
b as (select *, row_number() over (partition by lead_window order by seq) as k, '{{"base_period":"1995","computed_at":"' || day || 'T05:30:00+00:00","diagnostics":{{"pairs":' || n || '}},"index_date":"' || day || '","index_value":"' || {_TOKEN.format('v')} || '","input_count":' || len(l) || ',"inputs_root":"' || root || '","lead_window_days":' || lead_window || ',"methodology_code":"M1","methodology_digest":"","previous_hash":"' as head from r),
c as (select lead_window, k, '' as previous_hash, sha256(head || '","scope":"NATIONAL","weight_set_digest":""}}') as provenance_hash from b where k = 1
  union all select b.lead_window, b.k, c.provenance_hash, sha256(b.head || c.provenance_hash || '","scope":"NATIONAL","weight_set_digest":""}}') from c join b on b.lead_window = c.lead_window and b.k = c.k + 1)
select b.lead_window, b.seq, b.root as inputs_root, cast(len(b.l) as int) as input_count, c.previous_hash, c.provenance_hash from b join c on b.lead_window = c.lead_window and b.k = c.k"""


def lineage_nodes(spark, d):
    """Content-addressed nodes of routes and of groups of them, verified: one payload was changed, one source is gone."""
    node = {"kind": F.col("kind"), "operation": F.col("operation"), "payload": F.col("payload"), "params": F.lit("")}
    r = fares(spark, d).groupBy("route").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    r = provenance.with_digest(r, {"route": F.col("route"), "n": F.col("n"), "total": F.col("total")}, "payload")
    r = r.withColumns({"kind": F.lit("SOURCE"), "operation": F.lit("ingest"), "parents": F.array().cast("array<string>")})
    r = provenance.with_digest(r, node | {"parents": F.array_sort("parents")}, "digest").withColumn("team", F.right("route", F.lit(1)))
    g = r.groupBy("team").agg(F.collect_set("digest").alias("parents")).withColumns({"kind": F.lit("INDEX"), "operation": F.lit("aggregate"), "payload": F.sha2("team", 256)})
    g = provenance.with_digest(g, node | {"parents": F.array_sort("parents")}, "digest")
    cols = [F.col(c) for c in ("kind", "operation", "payload", "parents", "digest")]
    changed = r.where("route <> 'Brand#1'").withColumn("payload", F.when(F.col("route") == "Brand#2", F.lit("changed")).otherwise(F.col("payload")))
    nodes = changed.select(F.col("route").alias("node"), *cols).unionByName(g.select(F.col("team").alias("node"), *cols))
    return provenance.lineage_checked(nodes, "digest", "parents", node).select("node", "kind", "digest", "intact", "n_dangling")


_NODES = f"""with {FARES_SQL}, r as (select route, right(route, 1) as team, sha256('{{"n":' || count(*) || ',"route":"' || route || '","total":"' || {_TOKEN.format('sum(total)')} || '"}}') as payload from fares group by route),
s as (select *, sha256('{{"kind":"SOURCE","operation":"ingest","params":"","parents":[],"payload":"' || payload || '"}}') as digest from r),
g as (select team, sha256('{{"kind":"INDEX","operation":"aggregate","params":"","parents":["' || string_agg(digest, '","' order by digest) || '"],"payload":"' || sha256(team) || '"}}') as digest, count(case when route = 'Brand#1' then 1 end) as n_dangling from s group by team)
select route as node, 'SOURCE' as kind, digest, route <> 'Brand#2' as intact, 0 as n_dangling from s where route <> 'Brand#1' union all select team, 'INDEX', digest, true, n_dangling from g"""


def run_counters(spark, d):
    r = _read(spark, d)
    marks = {
        "currency_failures": F.col("l_tax") == 0.01, "structural_rejects": F.col("l_linenumber") == 7, "partial_breakdown": F.col("quality_grade") == "B", "total_mismatch": F.col("quality_grade") == "C",
        "sold_out": F.col("inventory_status") == "SOLD_OUT", "price_unavailable": F.col("total").isNull() & (F.col("inventory_status") != "SOLD_OUT"), "duplicates": F.col("is_duplicate"), "outliers": F.col("is_outlier"),
    }
    return reports.run_counters(r, ["source"], marks)


def task_validation(spark, d):
    r = _read(spark, d)
    return r.groupBy(F.coalesce(reports.task_refused(F.col("cabin"), ("ECONOMY",), F.col("lead_window"), (1, 30)), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def collection_metrics(spark, d):
    return reports.collected(_read(spark, d), ["source"], ["route", "lead_window", "observed_on"], "l_tax", 3).withColumn("mean_seconds", F.round("mean_seconds", 6))


def composed_keys(spark, d):
    """The composed keys of a quote: its item, its stratum and its search; codes are cut to their columns' width."""
    r = _read(spark, d)
    return r.select("fare", F.concat_ws("|", "carrier", "item", "cabin").alias("item_key"), F.concat_ws("|", "route", "lead_window", F.left("cabin", F.lit(4))).alias("stratum_key"), F.concat_ws("|", "source", "route", F.date_format("departure", "yyyy-MM-dd"), "cabin").alias("search_key"))


def calendar_fields(spark, d):
    """Departures that fall back on the lead, their drift in days, month bounds, days ahead and the age of weights."""
    r = _read(spark, d)
    given = F.when(F.col("l_linenumber") % 2 == 0, F.date_add("departure", F.col("l_linenumber")).cast("timestamp"))
    out = r.withColumn("departs", canonical.departure(given, F.col("observed_on"), F.col("lead_window"))).withColumn("b", canonical.month_bounds(F.date_format("observed_on", "yyyy-MM")))
    return out.select("fare", F.unix_seconds("departs").alias("departs"), canonical.lead_drift(F.col("departs"), F.col("observed_on"), F.col("lead_window")).alias("drift"), F.col("b.start").alias("month_start"), F.col("b.end").alias("month_end"), canonical.days_ahead(F.lit("1996-01-01").cast("date"), F.col("observed_on")).alias("days_ahead"), F.datediff("observed_on", F.lit("1995-12-31").cast("date")).alias("weight_age"))


def role_sets(spark, d):
    n = table(spark, d, "nation")
    roles = F.filter(F.array(F.when(F.col("n_nationkey") % 2 == 0, "analyst"), F.when(F.col("n_nationkey") % 3 == 0, "admin"), F.lit("viewer")), lambda x: x.isNotNull())
    needed = F.array(F.lit("admin"), F.lit("analyst"))
    return n.select("n_nationkey", reports.granted(roles, needed).alias("one"), reports.granted(roles, needed, all_of=True).alias("each"))


def window_set(spark, d):
    return fares(spark, d).select("route", "lead_window").distinct().groupBy("route").agg(F.array_join(F.array_sort(F.collect_set("lead_window")), ",").alias("windows"))


def _tasks(spark, d):
    routes = table(spark, d, "nation").select(F.col("n_name").alias("route"))
    return routes.crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in (1, 3, 7, 14, 20, 45, 60)], "lead_window int"))).withColumn("observed_on", F.lit("2024-03-05").cast("date"))


def synthetic_raw(spark, d):
    """The feed as sources publish it: sold out, partial, waived, shocked and localized rows."""
    return synthetic.raw_feed(_tasks(spark, d), partial=0.1, shocked=0.05)


def synthetic_legacy(spark, d):
    f = synthetic.fares_feed(_tasks(spark, d), profile="legacy")
    return f.select("route", "lead_window", "flight", F.col("total").cast("double").alias("total"))


def _answers():
    def fetch(task):
        n = task["seq"]
        if n % 401 == 400:
            raise collection.Refused("challenge", halted=True)
        if n % 17 == 0:
            raise collection.Refused("robots")
        if n % 13 == 0:
            raise TimeoutError("timeout")
        return 200, '{"results": [{"total": %d}, {}]}' % n

    return fetch


def collection_loop(spark, d):
    """Each source's tasks run to their end or to its halt: outcomes, and what the payloads held."""
    e = table(spark, d, "events").select(F.concat(F.lit("s"), F.pmod("user_id", F.lit(7))).alias("source"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(50)).alias("lead_window"))
    done = collection.collect(e, _answers(), refused=reports.task_refused(F.lit("ECONOMY"), ("ECONOMY",), F.col("lead_window"), (1, 45)))
    marks = done.groupBy("source", "outcome").agg(F.count("*").alias("n"))
    found = payload.extract(done.where("outcome = 'ok'").select("source", "outcome", "payload"), payload.Mapping("$.results", {"total": "$.total"}, types={"total": "bigint"}))
    return marks.join(found.groupBy("source", "outcome").agg(F.count("*").alias("n_results"), F.sum("total").alias("total")), ["source", "outcome"], "left")


_LOOP = """with e as (select 's' || (user_id % 7) as source, event_id as seq, event_id % 50 not between 1 and 45 as out from events),
h as (select source, min(seq) as stop from e where seq % 401 = 400 and not out group by source),
o as (select e.*, case when seq > stop then 'abandoned' when out then 'refused' when seq % 401 = 400 then 'halted' when seq % 17 = 0 then 'blocked' when seq % 13 = 0 then 'failed' else 'ok' end as outcome from e left join h on h.source = e.source)
select source, outcome, count(*) as n, case when outcome = 'ok' then 2 * count(*) end as n_results, cast(case when outcome = 'ok' then sum(seq) end as bigint) as total from o group by source, outcome"""


def robots_answers(spark, d):
    """Requests of each origin against the robots.txt that was fetched last: every tenth event is a fetch."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("https://h"), F.pmod("user_id", F.lit(20))).alias("origin"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.pmod("event_id", F.lit(10)).alias("k"))
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 503)), F.lit(None).cast("int")), F.pmod(F.floor(F.col("event_id") / 10), F.lit(5)).cast("int") + 1)
    fetches = e.where("k = 0").select("origin", F.col("at").alias("fetched_at"), status.alias("status"))
    return robots.answered(e.where("k <> 0").drop("k"), fetches, ttl=20_000).select("event_id", "mode", "reason")


_ROBOTS = """with e as (select event_id, 'https://h' || (user_id % 20) as origin, cast(floor(epoch(ts)) as bigint) as sec, event_id % 10 as k, list_extract([200, 404, 429, 503, null], cast((event_id // 10) % 5 as int) + 1) as status from events),
f as (select origin, sec, status from e where k = 0 qualify row_number() over (partition by origin, sec order by status desc nulls last) = 1),
j as (select e.event_id, e.sec, f.sec as got, f.status, f.status is null or f.status = 429 or f.status >= 500 as lost from e asof left join f on e.origin = f.origin and e.sec >= f.sec where e.k <> 0),
m as (select *, got is null or sec - got >= case when lost then 1666 else 20000 end as stale from j)
select event_id, case when stale then 'fetch' when status = 200 then 'parse' when lost then 'disallow_all' else 'allow_all' end as mode, case when stale then 'robots_stale' when status = 200 then 'robots_parsed' when status is null then 'robots_unreachable' when lost then 'robots_unreachable:http_' || status else 'robots_unavailable:http_' || status end as reason from m"""


def legacy_digests(spark, d):
    """The older identity of a quote (hour of observation, quarter hour of departure without a flight number) and its content."""
    t, r = partial(dedup.token, blank=dedup.BLANK), _read(spark, d)
    at = F.concat(F.lpad(F.pmod("l_orderkey", F.lit(24)), 2, "0"), F.lit(":"), F.lpad(F.pmod("l_orderkey", F.lit(60)), 2, "0"))
    flight = F.when(F.col("l_linenumber") % 2 == 0, F.concat("carrier", "l_linenumber"))
    hour = canonical.window_floor(F.col("observed_on").cast("timestamp") + F.expr("interval 1 minute") * F.pmod("l_orderkey", F.lit(600)))
    parts = [t(F.left("route", F.lit(3))), t(F.right("route", F.lit(1))), t(F.col("departure")), t(F.col("carrier")), t(F.coalesce(flight, canonical.minute_bucket(at))), t(F.col("cabin")), t(F.lit("INR")), t(hour, "timestamp"), t(F.col("lead_window"))]
    none = F.lit(None).cast("decimal(12,2)")
    r = r.withColumn("identity", dedup.digest(parts))
    return r.select("fare", "identity", dedup.digest([t(F.col("identity")), t(F.col("total"), "decimal"), *[t(none, "decimal")] * 4]).alias("content"))


_LEGACY = f"""with {_READ}, k as (select *, (l_orderkey % 60) // 15 * 15 as quarter, cast(observed_on as timestamp) + interval 1 hour * ((l_orderkey % 600) // 60) as hour from read),
i as (select fare, total, sha256(upper(left(route, 3)) || chr(31) || right(route, 1) || chr(31) || departure || chr(31) || upper(carrier) || chr(31) || case when l_linenumber % 2 = 0 then upper(carrier) || l_linenumber else lpad(cast(l_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(quarter as varchar), 2, '0') end
  || chr(31) || cabin || chr(31) || 'INR' || chr(31) || strftime(hour, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(31) || lead_window) as identity from k)
select fare, identity, sha256(upper(identity) || chr(31) || coalesce({_TOKEN.format('total')}, {_GONE}) || repeat(chr(31) || {_GONE}, 4)) as content from i"""


def ledger_append(spark, d):
    """The chains of chain_hash, written to a ledger in two parts: the second goes on from the heads of the first."""
    import uuid

    from plinth.lineage import shared_folder

    path, bodies = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", _bodies(spark, d)
    ledger.append(bodies.where("year < 1996"), path, ["route"], "year", "body")
    ledger.append(bodies.where("year >= 1996"), path, ["route"], "year", "body")
    return ledger.records(spark, path, bodies.select("route").schema, "year", "body").select("route", "year", "previous_hash", "chain_hash")


_TASKS = "tasks as (select n_name as route, w as lead_window from nation cross join (values (1), (3), (7), (14), (20), (45), (60)) w(w))"
_RAW = f"""with {_TASKS}, {feed_sql('standard')},
x as (select *, case when {uniform_sql('shock')} < 0.05e0 then list_extract([{', '.join(f'{x}::decimal(4,2)' for x in synthetic.SHOCKS)}], cast(floor({uniform_sql('size')} * 5) as int) + 1) end as shock, cast(case when {uniform_sql('waived')} < 0.2e0 then 0 else 150 + 25 * floor({uniform_sql('other')} * 30) end as decimal(12,2)) as other, not gone and {uniform_sql('partial')} < 0.1e0 as part, {uniform_sql('local')} < 0.15e0 as loc from priced),
y as (select *, round(fare * coalesce(shock, 1), 2) as bf from x), z as (select *, round((bf + other) * 0.05, 2) as g from y)
select route, lead_window, day as observed_on, carrier, flight, {', '.join(f"case when not gone{'' if name == 'total_fare' else ' and not part'} then case when loc then '₹ ' || format('{{:,.2f}}', {c}) else cast(cast({c} as decimal(12,2)) as varchar) end end as {name}" for name, c in (('base_fare', 'bf'), ('other_charges', 'other'), ('gst', 'g'), ('total_fare', 'bf + other + g')))},
  case when gone then 'SOLD_OUT' else 'AVAILABLE' end as inventory_status, cast(shock as double) as shock from z"""

QUERIES = {
    "breakdown_audit": (breakdown_audit, _breakdown_sql()),
    "normalise_issues": (normalise_issues, f"{_messy_sql()} select fare, origin, carrier_code, cabin, currency, flight, departure_date, case when departure_date is null then 0 else days_to_departure end as days_to_departure, issues, is_clean from marked"),
    "normalise_split": (normalise_split, f"{_messy_sql()} select issues, count(*) as n, case when is_clean then 'clean' else 'rejected' end as part from marked group by all"),
    "canonical_nested": (canonical_nested, f"""with {FARES_SQL} select {_FARE_SQL} as fare, sha256('{{"at":"' || observed_on || 'T00:00:00+00:00","inner":{{"marks":["' || l_returnflag || '","' || l_linestatus || '"],"n":' || l_linenumber || '}},"is_n":' || (l_returnflag = 'N') || ',"item":' || item || ',"note":"a \\"' || route || '\\\\","nothing":null,"observed_on":"' || observed_on || '","total":"' || {_TOKEN.format('total')} || '"}}') as digest from fares"""),
    "weight_digest": (weight_digest, f"""with {FARES_SQL}, w as (select year, route, cast(sum(quantity) as decimal(20,2)) as passengers from fares group by all)
select year, sha256('{{"base_level":"100","code":"JEVONS-LASPEYRES","min_pairs":5,"trim":"0.02"}}') as methodology, sha256('{{"weights":[' || string_agg('{{"passengers":"' || {_TOKEN.format('passengers')} || '","route":"' || route || '"}}', ',' order by route) || '],"year":' || year || '}}') as weight_set from w group by year"""),
    "sealed_series": (sealed_series, _SEALED),
    "lineage_nodes": (lineage_nodes, _NODES),
    "robots_answers": (robots_answers, _ROBOTS),
    "legacy_digests": (legacy_digests, _LEGACY),
    "ledger_append": (ledger_append, SERVING["chain_hash"][1]),
    "collection_loop": (collection_loop, _LOOP),
    "run_counters": (run_counters, f"with {_READ} select source, count(*) as extracted, count(case when l_tax = 0.01 then 1 end) as currency_failures, 0 as canonicalisation_failures, count(case when l_linenumber = 7 then 1 end) as structural_rejects, count(case when quality_grade = 'B' then 1 end) as partial_breakdown, count(case when quality_grade = 'C' then 1 end) as total_mismatch, count(case when inventory_status = 'SOLD_OUT' then 1 end) as sold_out, count(case when total is null and inventory_status <> 'SOLD_OUT' then 1 end) as price_unavailable, count(case when is_duplicate then 1 end) as duplicates, 0 as cross_source_conflicts, count(case when is_outlier then 1 end) as outliers, count(case when l_tax <> 0.01 and l_linenumber <> 7 then 1 end) as written from read group by source"),
    "task_validation": (task_validation, f"with {_READ} select case when cabin <> 'ECONOMY' then 'unsupported cabin' when lead_window > 30 then 'beyond horizon' else 'accepted' end as reason, count(*) as n from read group by all"),
    "collection_metrics": (collection_metrics, f"with {_READ}, t as (select source, route, lead_window, observed_on, count(*) as n, max(l_tax) as s from read group by all) select source, count(*) as tasks, cast(sum(n) as bigint) as quotes, cast(sum(least(n, 3)) as bigint) as kept, count(case when n > 3 then 1 end) as truncated, round(avg(s), 6) as mean_seconds, max(s) as most_seconds from t group by source"),
    "composed_keys": (composed_keys, f"with {_READ} select fare, concat_ws('|', carrier, item, cabin) as item_key, concat_ws('|', route, lead_window, left(cabin, 4)) as stratum_key, concat_ws('|', source, route, departure, cabin) as search_key from read"),
    "calendar_fields": (calendar_fields, f"with {_READ}, p as (select *, case when l_linenumber % 2 = 0 then cast(departure + cast(l_linenumber as int) as timestamp) else cast(departure as timestamp) - interval '330 minutes' end as departs from read) select fare, cast(epoch(departs) as bigint) as departs, date_diff('day', observed_on, cast(departs + interval '330 minutes' as date)) - lead_window as drift, cast(date_trunc('month', observed_on) as date) as month_start, cast(date_trunc('month', observed_on) + interval '1 month' as date) as month_end, greatest(date_diff('day', observed_on, date '1996-01-01'), 0) as days_ahead, date_diff('day', date '1995-12-31', observed_on) as weight_age from p"),
    "role_sets": (role_sets, "select n_nationkey, n_nationkey % 2 = 0 or n_nationkey % 3 = 0 as one, n_nationkey % 6 = 0 as each from nation"),
    "window_set": (window_set, f"with {FARES_SQL} select route, array_to_string(list_sort(list(distinct lead_window)), ',') as windows from fares group by route"),
    "synthetic_raw": (synthetic_raw, _RAW),
    "synthetic_legacy": (synthetic_legacy, f"with {_TASKS}, {feed_sql('legacy')} select route, lead_window, flight, cast(cast(case when not gone then fare + round(fare * 0.05, 2) end as decimal(12,2)) as double) as total from priced"),
}
