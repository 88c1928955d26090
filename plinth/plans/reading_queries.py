"""Queries of named filters, reports and versions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plinth.operators import dedup, filters, reports, serving
from plinth.plans.serving_queries import _FARE, _FARE_SQL
from plinth.plans.standin import FARES_SQL, fares, table
from plinth.sources.payload import run_status
from plinth.streaming.policy import gate


def _read(spark, d):
    f = fares(spark, d)
    sold = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    return f.select(
        F.concat_ws("-", *_FARE).alias("fare"), "route", "item", "lead_window", "observed_on", "l_orderkey", "l_linenumber", "l_tax", "l_discount",
        F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(5))).alias("source"), F.concat(F.lit("c"), F.pmod("l_orderkey", F.lit(7))).alias("carrier"),
        F.when(F.pmod("item", F.lit(2)) == 0, "ECONOMY").otherwise("BUSINESS").alias("cabin"),
        F.element_at(F.array(*map(F.lit, "ABCD")), F.pmod("l_suppkey", F.lit(4)).cast("int") + 1).alias("quality_grade"),
        F.when(sold, "SOLD_OUT").otherwise("AVAILABLE").alias("inventory_status"), F.date_add("observed_on", F.col("lead_window")).alias("departure"),
        F.when(~sold, F.col("total")).alias("total"), (F.col("l_tax") > 0.07).alias("is_outlier"), (F.col("l_linenumber") == 6).alias("is_duplicate"),
        F.when(F.pmod("l_orderkey", F.lit(11)) == 0, "timeout").otherwise("").alias("error"),
    )


_READ = f"""{FARES_SQL}, read as (select {_FARE_SQL} as fare, route, item, lead_window, observed_on, l_orderkey, l_linenumber, l_tax, l_discount, 'S' || (l_suppkey % 5) as source, 'c' || (l_orderkey % 7) as carrier,
  case when item % 2 = 0 then 'ECONOMY' else 'BUSINESS' end as cabin, substr('ABCD', cast(l_suppkey % 4 as int) + 1, 1) as quality_grade,
  case when l_returnflag = 'N' and l_linestatus = 'O' then 'SOLD_OUT' else 'AVAILABLE' end as inventory_status, observed_on + cast(lead_window as int) as departure,
  case when not (l_returnflag = 'N' and l_linestatus = 'O') then total end as total, l_tax > 0.07 as is_outlier, l_linenumber = 6 as is_duplicate,
  case when l_orderkey % 11 = 0 then 'timeout' else '' end as error from fares)"""

#: Requests that use every named filter of fares at least once.
_ASKED = (
    {"route": "brand#7", "lead_window_in": [7, 30], "min_fare": 20000, "max_fare": 60000, "priced_only": True},
    {"route_in": ["Brand#1", "Brand#2"], "source": "s3", "carrier": "C4", "lead_window": 15, "is_outlier": False, "is_duplicate": False, "priced_only": False},
    {"cabin": "BUSINESS", "quality": "B", "inventory_status": "SOLD_OUT", "observed_from": "1996-02-01", "observed_to": "1996-05-31"},
    {"quality_in": ["A", "C"], "departure_from": "1997-01-01", "departure_to": "1997-01-31", "index_eligible": True},
)


def fares_filter_set(spark, d):
    rows = _read(spark, d)
    parts = [filters.asked(rows, wanted, filters.FARES, filters.FARES_DERIVED).select(F.lit(i).alias("request"), "fare") for i, wanted in enumerate(_ASKED)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _series(spark, d):
    routes = fares(spark, d).groupBy("route", "lead_window", "observed_on").agg(F.max("total").cast("double").alias("level"))
    national = routes.groupBy("lead_window", "observed_on").agg(F.max("level").alias("level")).withColumn("route", F.lit(None).cast("string"))
    return routes.unionByName(national).withColumnRenamed("observed_on", "index_date").withColumns({"methodology": F.lit("JEVONS"), "is_published": F.dayofmonth("index_date") != 13})


def series_filter_set(spark, d):
    """The national series of two windows, and one route's unpublished points."""
    rows = _series(spark, d)
    whole = filters.asked(rows, {"methodology": "JEVONS", "national": True, "lead_window_in": [1, 45], "date_from": "1996-01-01", "date_to": "1996-12-31"}, filters.SERIES)
    part = filters.asked(rows, {"route": "BRAND#3", "national": False, "lead_window": 7, "published": False}, filters.SERIES)
    return whole.unionByName(part).select("route", "lead_window", "index_date", "level")


def raw_filter_set(spark, d):
    rows = _read(spark, d).withColumns({"captured_at": F.col("observed_on"), "is_processed": F.col("l_linenumber") < 5})
    bad = filters.asked(rows, {"source": "s1", "has_error": True, "captured_from": "1996-01-01", "captured_to": "1997-12-31"}, filters.RAW)
    good = filters.asked(rows, {"route": "brand#9", "lead_window": 1, "is_processed": True, "has_error": False}, filters.RAW)
    return bad.select(F.lit("bad").alias("kind"), "fare").unionByName(good.select(F.lit("good").alias("kind"), "fare"))


def run_filter_set(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return filters.asked(rows, {"status": "f", "created_from": "1996-01-01", "created_to": "1996-06-30"}, filters.RUNS).select("o_orderkey")


def audit_filter_set(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.lit("User").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("created_at"))
    return filters.asked(rows, {"action": "CLICK", "entity_type": "user", "entity_id": "7", "created_from": "2000-01-01"}, filters.AUDIT).select("event_id")


def route_filter(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("origin"), F.col("n_name").alias("destination"), (F.col("n_nationkey") % 3 != 0).alias("is_active"), (F.col("n_nationkey") % 2 == 0).alias("in_basket"))
    return filters.asked(rows, {"is_active": True, "in_basket": True, "origin": "ASIA"}, filters.ROUTES).select("origin", "destination")


def fares_summary_full(spark, d):
    marks = {"n_sold_out": F.col("inventory_status") == "SOLD_OUT", "n_outliers": F.col("is_outlier"), "n_partial": F.col("quality_grade") == "B"}
    return serving.summary(_read(spark, d), "total", marks)


def derived_columns(spark, d):
    """What readers are shown beside the stored columns: whether a row has a price, a full breakdown, and its scope."""
    rows = _read(spark, d).select("fare", F.col("total").isNotNull().alias("is_priced"), (F.col("quality_grade") == "A").alias("has_full_breakdown"), F.concat_ws(":", "route", "lead_window").alias("scope"))
    return rows


def fingerprint_full(spark, d):
    """The digests over all ten fields of an offer, and over its nine of content."""
    t = dedup.token
    r = _read(spark, d)
    basis = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" y"), F.col("l_linenumber"), F.lit(" ")))
    at = F.concat(F.date_format("departure", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    parts = [t(F.col("route")), t(F.col("carrier")), t(F.col("l_orderkey")), at, t(F.col("cabin")), t(F.lit("INR")), t(F.col("lead_window")), t(F.col("observed_on")), t(basis), t(F.lit(None).cast("string"))]
    r = r.withColumn("fingerprint", dedup.digest(parts))
    money = [F.col("total"), F.col("total"), *[F.lit(None).cast("decimal(12,2)")] * 3, F.lit("0.50").cast("decimal(12,2)"), F.lit("0").cast("decimal(12,2)")]
    return r.select("fare", "fingerprint", dedup.digest([F.col("fingerprint"), *[t(m, "decimal") for m in money], t(F.col("inventory_status"))]).alias("content"))


def duplicate_groups(spark, d):
    rows = _read(spark, d).withColumn("fingerprint", F.concat_ws("-", "route", "item", "lead_window", F.year("observed_on")))
    rows = rows.withColumn("content", F.concat_ws("-", "source", "total"))
    return reports.duplicate_groups(rows, "fingerprint", "content", "source", "total", dedup.CONFLICT_SPREAD)


def rejection_report(spark, d):
    reason = F.when(F.col("total").isNull() & (F.col("l_linenumber") == 3), "no price").when(F.col("l_tax") == 0.08, "tax").when(F.col("l_discount") == 0, "no discount")
    return reports.rejections(_read(spark, d).withColumn("reason", reason), "reason", "fare")


def run_results(spark, d):
    """Runs (orders) with their counters, from their tasks (lines), and the status that follows."""
    rows = fares(spark, d)
    ok, failed = (F.col("l_returnflag") == "A"), (F.col("l_returnflag") == "R")
    runs = rows.groupBy("l_orderkey").agg(F.count_if(ok).alias("n_ok"), F.count_if(failed).alias("n_failed"), F.count_if(~ok & ~failed).alias("n_blocked"))
    return runs.withColumn("status", run_status(F.col("n_ok"), F.col("n_failed"), F.col("n_blocked")))


def methodology_as_of(spark, d):
    versions = spark.createDataFrame([("1.0", "1995-01-01"), ("1.1", "1996-07-01"), ("1.2", "1996-07-01"), ("2.0", "1999-01-01")], "version string, since string").select("version", F.to_date("since").alias("effective_from"))
    days = fares(spark, d).select(F.trunc("observed_on", "month").alias("day")).distinct()
    return reports.in_force(versions, days)


def route_current_weight(spark, d):
    from plinth.plans.standin import weight_versions

    return weight_versions(spark, d).where("valid_to is null").groupBy("route").agg(F.max_by("passengers", "valid_from").alias("passengers"))


def strict_shares(spark, d):
    from plinth.plans.standin import weights

    return reports.strict_shares(weights(spark, d), "route", "passengers").select("route", "share", "error")


def stratum_digest(spark, d):
    """Digests of what each window's yearly values stood on: routes with their counts and sums."""
    y = fares(spark, d).groupBy("lead_window", "year", "route").agg(F.count("*").alias("n"), F.sum("total").alias("sum"))
    return reports.set_digest(y, ["lead_window", "year"], "route", {"route": F.col("route"), "n": F.col("n"), "sum": F.col("sum")})


def verification_scopes(spark, d):
    windows = spark.createDataFrame([(w,) for w in (1, 7, 15, 30, 45)], "lead_window int")
    return reports.scopes(fares(spark, d).select("route").distinct(), windows)


def task_results_cut(spark, d):
    return reports.truncated(_read(spark, d).select("source", "lead_window", "fare", "observed_on"), ["source", "lead_window"], [F.col("observed_on"), F.col("fare")], 20).select("source", "lead_window", "fare", "place")


def plan_selection(spark, d):
    """Sources asked for by code, those of one kind left out."""
    asked = spark.createDataFrame([("S1",), ("S2",), ("S9",)], "source string")
    sources = _read(spark, d).groupBy("source").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("source") == "S2", "MOCK").otherwise("LIVE"))
    return sources.where("kind <> 'MOCK'").join(asked, "source", "left_semi").select("source", "n")


def source_routes(spark, d):
    """Counts of rows by source, and the routes of each in one text."""
    return _read(spark, d).groupBy("source").agg(F.count("*").alias("n_raw"), F.count("total").alias("n_priced"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))


def page_with_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reports.counted_page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 500, "o_orderkey").select("o_orderkey", "count", "pages", "page")


def breaker_sweep(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"), F.max_by("event_type", "event_id").alias("last"))
    states = e.select("user_id", (F.col("us") / 1e6).alias("opened"), F.when(F.col("last") == "error", "OPEN").when(F.col("last") == "purchase", "TRIPPED_PERMANENT").otherwise("CLOSED").alias("state"))
    now = states.agg(F.max("opened").alias("now"))
    return reports.swept(states.crossJoin(F.broadcast(now)), F.col("now"), 3600.0).select("user_id", "state", "swept", "is_halted")


def policy_gate(spark, d):
    """The first gate that refuses each request, or that it may go."""
    r = _read(spark, d)
    state = F.when(F.col("l_orderkey") % 13 == 0, "TRIPPED_PERMANENT").when(F.col("l_orderkey") % 7 == 0, "OPEN").otherwise("CLOSED")
    kind = F.when(F.col("l_orderkey") % 17 == 0, "DISABLED").otherwise("ACTIVE")
    decision = gate(F.col("l_linenumber") != 5, kind, state, F.col("l_tax") != 0.03, F.col("l_discount") != 0.05)
    return r.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


def restated_days(spark, d):
    """Every day of every route with the price that was known a week later: a line is a print, made when it ships after its order."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    prints = fares(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("route", "day", F.col("observed_on").alias("known_on")).agg(F.max("total").cast("double").alias("price"))
    return reports.restated(prints.select("route", "day").distinct(), prints, ["route"], "day", "known_on", "price", 7)


_ELIGIBLE = "total > 0 and not is_duplicate and quality_grade in ('A', 'B') and not is_outlier"
_SERIES = f"{FARES_SQL}, r as (select route, lead_window, observed_on as index_date, cast(max(total) as double) as level from fares group by all), s as (select * from r union all select null, lead_window, index_date, max(level) from r group by all)"
_TOKEN = r"regexp_replace(regexp_replace(cast({} as varchar), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
_GONE = "chr(0) || 'MISSING'"

QUERIES = {
    "fares_filter_set": (fares_filter_set, f"with {_READ} select 0 as request, fare from read where lower(route) = 'brand#7' and lead_window in (7, 30) and total between 20000 and 60000"
        " union all select 1, fare from read where route in ('Brand#1', 'Brand#2') and source = 'S3' and carrier = 'c4' and lead_window = 15 and not is_outlier and not is_duplicate"
        " union all select 2, fare from read where cabin = 'BUSINESS' and quality_grade = 'B' and inventory_status = 'SOLD_OUT' and observed_on between date '1996-02-01' and date '1996-05-31'"
        f" union all select 3, fare from read where quality_grade in ('A', 'C') and departure between date '1997-01-01' and date '1997-01-31' and {_ELIGIBLE}"),
    "series_filter_set": (series_filter_set, f"with {_SERIES} select route, lead_window, index_date, level from s where (route is null and lead_window in (1, 45) and index_date between date '1996-01-01' and date '1996-12-31') or (lower(route) = 'brand#3' and lead_window = 7 and day(index_date) = 13)"),
    "raw_filter_set": (raw_filter_set, f"with {_READ} select 'bad' as kind, fare from read where source = 'S1' and error <> '' and observed_on between date '1996-01-01' and date '1997-12-31' union all select 'good', fare from read where lower(route) = 'brand#9' and lead_window = 1 and l_linenumber < 5 and error = ''"),
    "run_filter_set": (run_filter_set, "select o_orderkey from orders where lower(o_orderstatus) = 'f' and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1996-06-30'"),
    "audit_filter_set": (audit_filter_set, "select event_id from events where lower(event_type) = 'click' and user_id = 7 and ts >= timestamp '2000-01-01'"),
    "route_filter": (route_filter, "select r_name as origin, n_name as destination from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 <> 0 and n_nationkey % 2 = 0 and r_name = 'ASIA'"),
    "fares_summary_full": (fares_summary_full, f"with {_READ} select count(*) as n, count(total) as n_priced, count(*) - count(total) as n_unpriced, count(case when inventory_status = 'SOLD_OUT' then 1 end) as n_sold_out, count(case when is_outlier then 1 end) as n_outliers, count(case when quality_grade = 'B' then 1 end) as n_partial, cast(min(total) as double) as lowest, cast(max(total) as double) as highest, round_even(quantile_cont(cast(total as double), 0.5), 2) as median from read"),
    "derived_columns": (derived_columns, f"with {_READ} select fare, total is not null as is_priced, quality_grade = 'A' as has_full_breakdown, route || ':' || lead_window as scope from read"),
    "fingerprint_full": (fingerprint_full, f"""with {_READ}, f as (select *, sha256(upper(route) || chr(31) || upper(carrier) || chr(31) || l_orderkey || chr(31) || departure || 'T00:00:00+00:00' || chr(31) || cabin || chr(31) || 'INR' || chr(31) || lead_window || chr(31) || observed_on || chr(31)
  || case when l_linenumber % 2 = 0 then 'Y' || l_linenumber else {_GONE} end || chr(31) || {_GONE}) as fingerprint, coalesce({_TOKEN.format('total')}, {_GONE}) as money from read)
select fare, fingerprint, sha256(fingerprint || chr(31) || money || chr(31) || money || repeat(chr(31) || {_GONE}, 3) || chr(31) || '0.5' || chr(31) || '0' || chr(31) || inventory_status) as content from f"""),
    "duplicate_groups": (duplicate_groups, f"""with {_READ}, g as (select route || '-' || item || '-' || lead_window || '-' || year(observed_on) as fingerprint, count(*) as members, count(distinct concat_ws('-', source, total)) as contents, array_to_string(list_sort(list(distinct source)), ',') as sources, min(total) as lowest, max(total) as highest from read group by 1)
select *, contents > 1 and lowest > 0 and (highest - lowest) > lowest * 0.02 as conflict from g where members > 1"""),
    "rejection_report": (rejection_report, f"with {_READ}, j as (select fare, case when total is null and l_linenumber = 3 then 'no price' when l_tax = 0.08 then 'tax' when l_discount = 0 then 'no discount' end as reason from read), k as (select *, row_number() over (order by fare) as place from j where reason is not null) select reason, count(*) as n, count(case when place <= 200 then 1 end) as n_shown, min(case when place <= 200 then fare end) as first_shown from k group by reason"),
    "run_results": (run_results, f"with {FARES_SQL}, c as (select l_orderkey, count(case when l_returnflag = 'A' then 1 end) as n_ok, count(case when l_returnflag = 'R' then 1 end) as n_failed, count(case when l_returnflag not in ('A', 'R') then 1 end) as n_blocked from fares group by l_orderkey) select *, case when n_ok = 0 and n_blocked > 0 then 'BLOCKED' when n_ok = 0 then 'FAILED' when n_failed > 0 or n_blocked > 0 then 'PARTIAL' else 'SUCCEEDED' end as status from c"),
    "methodology_as_of": (methodology_as_of, f"with {FARES_SQL}, days as (select distinct cast(date_trunc('month', observed_on) as date) as day from fares) select day, case when day >= date '1999-01-01' then '2.0' when day >= date '1996-07-01' then '1.2' when day >= date '1995-01-01' then '1.0' end as version, case when day >= date '1999-01-01' then date '1999-01-01' when day >= date '1996-07-01' then date '1996-07-01' when day >= date '1995-01-01' then date '1995-01-01' end as effective_from from days"),
    "route_current_weight": (route_current_weight, f"with {FARES_SQL}, y as (select route, year, sum(quantity) as passengers from fares group by all) select route, passengers from y where year = (select max(year) from y)"),
    "strict_shares": (strict_shares, f"with {FARES_SQL}, w as (select route, sum(quantity) as passengers from fares where year = 1995 group by route) select route, round_even(passengers / sum(passengers) over (), 8) as share, cast(null as varchar) as error from w"),
    "stratum_digest": (stratum_digest, f"""with {FARES_SQL}, y as (select lead_window, year, route, count(*) as n, sum(total) as sum from fares group by all)
select lead_window, year, count(*) as n, sha256('[' || string_agg('{{"n":"' || n || '","route":"' || route || '","sum":"' || sum || '"}}', ',' order by route) || ']') as digest from y group by lead_window, year"""),
    "verification_scopes": (verification_scopes, f"with {FARES_SQL}, w as (select * from (values (1), (7), (15), (30), (45)) t(lead_window)) select 'NATIONAL' as scope, lead_window from w union all select route, w.lead_window from (select distinct route from fares) cross join w"),
    "task_results_cut": (task_results_cut, f"with {_READ} select source, lead_window, fare, row_number() over (partition by source, lead_window order by observed_on, fare) as place from read qualify place <= 20"),
    "plan_selection": (plan_selection, f"with {_READ} select source, count(*) as n from read where source in ('S1', 'S9') group by source"),
    "source_routes": (source_routes, f"with {_READ} select source, count(*) as n_raw, count(total) as n_priced, array_to_string(list_sort(list(distinct route)), ',') as routes from read group by source"),
    "page_with_counts": (page_with_counts, "select o_orderkey, count(*) over () as count, cast(ceil(count(*) over () / 500.0) as bigint) as pages, 2 as page from orders order by o_totalprice desc, o_orderkey limit 500 offset 500"),
    "breaker_sweep": (breaker_sweep, "with e as (select user_id, max(epoch_us(ts)) / 1e6 as opened, arg_max(event_type, event_id) as last from events group by user_id), s as (select *, case when last = 'error' then 'OPEN' when last = 'purchase' then 'TRIPPED_PERMANENT' else 'CLOSED' end as state from e) select user_id, state, case when state = 'OPEN' and (select max(opened) from s) >= opened + 3600 then 'HALF_OPEN' else state end as swept, state = 'TRIPPED_PERMANENT' as is_halted from s"),
    "policy_gate": (policy_gate, f"with {_READ} select case when l_orderkey % 13 = 0 then 'deny_halted' when l_orderkey % 17 = 0 then 'deny_disabled' when l_linenumber = 5 then 'deny_disabled' when l_orderkey % 7 = 0 then 'deny_circuit_open' when l_tax = 0.03 then 'deny_robots' when l_discount = 0.05 then 'deny_rate' else 'allow' end as decision, count(*) as n from read group by 1"),
    "restated_days": (restated_days, f"with {FARES_SQL}, p as (select route, cast(o_orderdate as date) as day, observed_on as known_on, cast(max(total) as double) as price from fares join orders on o_orderkey = l_orderkey group by all), b as (select * from p where known_on <= day + 7 qualify row_number() over (partition by route, day order by known_on desc) = 1) select k.route, k.day, b.price, b.known_on from (select distinct route, day from p) k left join b on b.route = k.route and b.day = k.day"),
}
