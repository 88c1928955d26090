"""Queries of parsing, canonical forms, audits and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import canonical, challenge
from plinth.functions.money import parse_money as money
from plinth.functions.rounding import half_even
from plinth.operators import audit
from plinth.plans.standin import FARES_SQL, fares, table

#: Money texts and what they mean: raw, value, status. The expectations are the oracle.
MONEY_CASES = (
    ("₹ 4,521.00", "4521.00", "ok"), ("INR 4521", "4521.00", "ok"), ("Rs. 4,521", "4521.00", "ok"), ("4,521.00", "4521.00", "ok"),
    ("₹4.521,00", "4521.00", "ok"), ("12 345.50", "12345.50", "ok"), ("1,23,456.78", "123456.78", "ok"), ("1.2k", "1200.00", "ok"),
    ("3.4 lakh", "340000.00", "ok"), ("0", "0.00", "ok"), ("0.00", "0.00", "ok"), ("", None, "missing"), ("--", None, "missing"),
    ("N/A", None, "missing"), ("Sold out", None, "missing"), ("price on request", None, "missing"), (None, None, "missing"),
    ("-500", None, "negative_rejected"), ("(1,200)", None, "negative_rejected"), ("$120", None, "wrong_currency"), ("₹-500", "500.00", "ok"),
    ("4,521/-", None, "unparseable"), ("4.5678", "45678.00", "ok"), ("1,234.56", "1234.56", "ok"), ("1.234,56", "1234.56", "ok"),
    ("4,500", "4500.00", "ok"), ("4.5", "4.50", "ok"), ("2 crore", "20000000.00", "ok"), ("४५२१", "4521.00", "ok"), ("abc", None, "missing"),
    ("4521.355", "4521355.00", "ok"), ("99 EUR", None, "wrong_currency"),
)
CARRIER_CASES = (("6E - INDIGO", "6E"), ("ai/ix", "AI"), (" uk ", "UK"), ("Q", None), ("SG8-x", "SG8"), ("", None))
FLIGHT_CASES = (("6E 0615", "6E", "615"), ("AI202", "AI", "202"), ("0000", "AI", "0"), ("no number", "AI", "NO NUMBER"), (None, "AI", ""), ("UK-997A", "UK", "997"))
CABIN_CASES = (("Y", "ECONOMY"), ("premium economy", "PREMIUM_ECONOMY"), ("BIZ", "BUSINESS"), ("first class", "FIRST"), ("PREMIUM_ECONOMY", "ECONOMY"), (None, "ECONOMY"), ("suite", "ECONOMY"))


def _values(rows) -> str:
    lit = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


def parse_money(spark, d):
    rows = spark.createDataFrame([(r,) for r, *_ in MONEY_CASES], "raw string")
    m = rows.withColumn("m", money(F.col("raw"), expected="INR"))
    return m.select("raw", F.col("m.value").cast("string").alias("value"), "m.status")


def parse_money_rendered(spark, d):
    """Every order total, written in the lakh style with a rupee sign and read back."""
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2)).alias("raw"))
    m = orders.withColumn("m", money(F.col("raw"), expected="INR"))
    return m.select("o_orderkey", F.col("m.value").cast("string").alias("value"), "m.status")


def carrier_canon(spark, d):
    return spark.createDataFrame([(r,) for r, _ in CARRIER_CASES], "raw string").select("raw", canonical.carrier(F.col("raw")).alias("carrier"))


def flight_canon(spark, d):
    rows = spark.createDataFrame([(r, c) for r, c, _ in FLIGHT_CASES], "raw string, carrier string")
    return rows.select("raw", "carrier", canonical.flight_number(F.col("raw"), F.col("carrier")).alias("flight"))


def cabin_map(spark, d):
    return spark.createDataFrame([(r,) for r, _ in CABIN_CASES], "raw string").select("raw", canonical.cabin(F.col("raw")).alias("cabin"))


def local_days(spark, d):
    return table(spark, d, "events").select("event_id", canonical.local_day(F.col("ts").cast("timestamp")).alias("day"), canonical.minute_bucket(F.date_format("ts", "HH:mm")).alias("bucket"))


def observation_window_bucket(spark, d):
    floor = canonical.window_floor(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.unix_timestamp(floor).alias("hour"), "event_type").agg(F.count("*").alias("n"))


def departure_bucket(spark, d):
    return table(spark, d, "events").groupBy(canonical.minute_bucket(F.date_format("ts", "HH:mm")).alias("bucket")).agg(F.count("*").alias("n"))


def _components(spark, d):
    """Six components of each line: price, discount and tax shares; some are missing by return flag and line number."""
    part = lambda k: (F.floor(x * k) / 100).cast("decimal(12,2)")  # noqa: E731  k percent, in whole cents
    x = F.col("total").cast("double")
    f = fares(spark, d)
    return f.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "item", "observed_on").alias("fare"), "route", "l_returnflag", "l_linenumber",
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.lit(None)).otherwise(F.col("total")).cast("decimal(12,2)").alias("total"),
        F.when(F.col("l_returnflag") != "R", part(50)).alias("base_fare"), part(25).alias("udf"),
        F.when(F.col("l_linenumber") != 3, part(12.5)).alias("psf"), F.when(F.col("l_discount") > 0, part(12.5)).otherwise(F.lit(0)).cast("decimal(12,2)").alias("asf"),
        F.lit(0).cast("decimal(12,2)").alias("gst"), F.when(F.col("l_linenumber") != 4, F.lit(0)).cast("decimal(12,2)").alias("other_charges"),
    )


_COMP = f"""{FARES_SQL}, comp as (select concat_ws('-', l_orderkey, l_linenumber, l_suppkey, item, observed_on) as fare, route, l_returnflag, l_linenumber,
  case when l_linestatus = 'O' and l_returnflag = 'N' then null else total end as total,
  case when l_returnflag <> 'R' then cast(floor(cast(total as double) * 50) / 100.0 as decimal(12,2)) end as base_fare, cast(floor(cast(total as double) * 25) / 100.0 as decimal(12,2)) as udf,
  case when l_linenumber <> 3 then cast(floor(cast(total as double) * 12.5) / 100.0 as decimal(12,2)) end as psf,
  case when l_discount > 0 then cast(floor(cast(total as double) * 12.5) / 100.0 as decimal(12,2)) else 0 end as asf, cast(0 as decimal(12,2)) as gst,
  case when l_linenumber <> 4 then cast(0 as decimal(12,2)) end as other_charges from fares),
counted as (select *, cast(base_fare is null as int) + cast(psf is null as int) + cast(other_charges is null as int) as gaps,
  coalesce(base_fare, 0) + udf + coalesce(psf, 0) + asf + gst + coalesce(other_charges, 0) as known from comp),
audited as (select *, total is not null and gaps = 1 and total - known >= 0 as derives from counted),
graded as (select *, case when derives then 0 else gaps end as n_missing, case when derives then total else known end as summed,
  case when total is null then 'D' when not derives and gaps > 0 then 'B'
       when abs(total - case when derives then total else known end) <= greatest(0.05, abs(total) * 0.005) then 'A' else 'C' end as quality_grade from audited)"""


def component_audit(spark, d):
    return audit.component_audit(_components(spark, d)).groupBy("route", "quality_grade", "n_missing").agg(F.count("*").alias("n"), F.sum(F.col("derived_amount")).cast("double").alias("derived"))


def audit_flags(spark, d):
    return audit.component_audit(_components(spark, d)).select("fare", F.concat_ws(",", "flags").alias("flags"))


def explicit_zero_flags(spark, d):
    return _components(spark, d).select("fare", F.concat_ws(",", audit.explicit_zeros()).alias("zeros"))


def legacy_audit(spark, d):
    rows = _components(spark, d).withColumn("total", F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("total")).cast("decimal(12,2)"))
    out = audit.four_component_audit(rows, ("base_fare", "udf", "psf", "asf"), "total")
    return out.groupBy("base_fare_state", "psf_state", "total_derived", "breakdown_trusted").agg(F.count("*").alias("n"), F.sum("audited_total").cast("double").alias("total"))


def _checked(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    cust, supp = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"), "left").join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    reason = audit.validate(F.col("s_nationkey"), F.col("c_nationkey"), [F.col("l_discount") - 0.01], F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return rows.select("l_orderkey", reason.alias("reason"))


def validate_reasons(spark, d):
    return _checked(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def stage_counters(spark, d):
    """Counters of a whole cleaning run, in one aggregate."""
    rows = audit.component_audit(_components(spark, d))
    flag = lambda f: F.count_if(F.array_contains("flags", f))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("total").isNull()).alias("unpriced"), flag("EXPLICIT_ZERO").alias("explicit_zero"), flag("COMPONENT_DERIVED").alias("derived"), flag("PARTIAL_BREAKDOWN").alias("partial"), flag("TOTAL_MISMATCH").alias("mismatch"), *[F.count_if(F.col("quality_grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"])


def props_json_extract(spark, d):
    v = F.parse_json(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def challenge_detect(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 50 == 7, F.concat(F.lit("<title>Just a moment...</title>"), "html")).when(F.col("page_id") % 50 == 8, F.concat("html", F.lit("<b>Access denied</b>"))).otherwise(F.col("html")).alias("html"))
    return pages.select("page_id", challenge.detect(F.when(F.col("page_id") % 50 == 9, 403).otherwise(200), None, F.col("html")).alias("c")).where("c is not null").select("page_id", "c.vendor", "c.confidence")


def url_origin(spark, d):
    return table(spark, d, "pages").groupBy(canonical.url_origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"))


def half_even_and_half_up(spark, d):
    return fares(spark, d).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "item", "observed_on").alias("fare"), half_even(F.col("total"), 0).cast("long").alias("even"), F.round("total", 0).cast("long").alias("up"))


QUERIES = {
    "parse_money": (parse_money, f"select * from (values {_values(MONEY_CASES)}) t(raw, value, status)"),
    "parse_money_rendered": (parse_money_rendered, "select o_orderkey, cast(cast(o_totalprice as decimal(12,2)) as varchar) as value, 'ok' as status from orders"),
    "carrier_canon": (carrier_canon, f"select * from (values {_values(CARRIER_CASES)}) t(raw, carrier)"),
    "flight_canon": (flight_canon, f"select * from (values {_values(FLIGHT_CASES)}) t(raw, carrier, flight)"),
    "cabin_map": (cabin_map, f"select * from (values {_values(CABIN_CASES)}) t(raw, cabin)"),
    "local_days": (local_days, "select event_id, cast(ts + interval '5 hours 30 minutes' as date) as day, lpad(cast(hour(ts) as varchar), 2, '0') || ':' || lpad(cast(minute(ts) - minute(ts) % 15 as varchar), 2, '0') as bucket from events"),
    "observation_window_bucket": (observation_window_bucket, "select cast(epoch(date_trunc('hour', ts)) as bigint) as hour, event_type, count(*) as n from events group by all"),
    "departure_bucket": (departure_bucket, "select lpad(cast(hour(ts) as varchar), 2, '0') || ':' || lpad(cast(minute(ts) - minute(ts) % 15 as varchar), 2, '0') as bucket, count(*) as n from events group by all"),
    "component_audit": (component_audit, f"with {_COMP} select route, quality_grade, n_missing, count(*) as n, cast(sum(case when derives then total - known end) as double) as derived from graded group by route, quality_grade, n_missing"),
    "audit_flags": (audit_flags, f"with {_COMP} select fare, concat_ws(',', case when total is not null then 'EXPLICIT_ZERO' end, case when derives then 'COMPONENT_DERIVED' end, case when total is not null and n_missing > 0 then 'PARTIAL_BREAKDOWN' end, case when quality_grade = 'C' then 'TOTAL_MISMATCH' end) as flags from graded"),
    "explicit_zero_flags": (explicit_zero_flags, f"with {_COMP} select fare, concat_ws(',', case when asf = 0 then 'asf' end, 'gst', case when other_charges = 0 then 'other_charges' end) as zeros from comp"),
    "legacy_audit": (legacy_audit, f"with {_COMP}, r as (select *, case when l_linenumber = 1 then null else total end as t, coalesce(base_fare, 0) + udf + coalesce(psf, 0) + asf as k, cast(base_fare is null as int) + cast(psf is null as int) as g from comp), s as (select *, t is null and g = 0 and k > 0 as td, case when t is null and g = 0 and k > 0 then k else t end as ft from r), u as (select *, ft is not null and g = 1 and ft - k >= 0 as dv from s) select case when base_fare is null then case when dv then 'DERIVED' else 'MISSING' end when base_fare = 0 then 'EXPLICIT_ZERO' else 'OBSERVED' end as base_fare_state, case when psf is null then case when dv then 'DERIVED' else 'MISSING' end when psf = 0 then 'EXPLICIT_ZERO' else 'OBSERVED' end as psf_state, td as total_derived, coalesce((g = 0 or dv) and abs(ft - case when dv then ft else k end) <= greatest(0.05, abs(ft) * 0.005), false) as breakdown_trusted, count(*) as n, cast(sum(ft) as double) as total from u group by 1, 2, 3, 4"),
    "validate_reasons": (validate_reasons, "select coalesce(case when s.s_nationkey is null or c.c_nationkey is null then 'observation has no route' when s.s_nationkey = c.c_nationkey then 'circular route' when l.l_discount - 0.01 < 0 then 'negative amount' when l.l_shipdate < o.o_orderdate - interval '3 hours' then 'departure precedes observation' end, 'accepted') as reason, count(*) as n from lineitem l join orders o on l.l_orderkey = o.o_orderkey left join customer c on c.c_custkey = o.o_custkey left join supplier s on s.s_suppkey = l.l_suppkey group by 1"),
    "stage_counters": (stage_counters, f"with {_COMP} select count(*) as n, count(case when total is null then 1 end) as unpriced, count(case when total is not null then 1 end) as explicit_zero, count(case when derives then 1 end) as derived, count(case when total is not null and n_missing > 0 then 1 end) as partial, count(case when quality_grade = 'C' then 1 end) as mismatch, count(case when quality_grade = 'A' then 1 end) as grade_a, count(case when quality_grade = 'B' then 1 end) as grade_b, count(case when quality_grade = 'C' then 1 end) as grade_c, count(case when quality_grade = 'D' then 1 end) as grade_d from graded"),
    "props_json_extract": (props_json_extract, "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"),
    "challenge_detect": (challenge_detect, "select page_id, case when page_id % 50 = 7 then 'cloudflare' when page_id % 50 = 8 then 'generic_block' else 'http_block' end as vendor, case when page_id % 50 = 7 then 0.97 when page_id % 50 = 8 then 0.75 else 0.7 end as confidence from pages where page_id % 50 in (7, 8, 9)"),
    "url_origin": (url_origin, "select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) as origin, count(*) as n from pages group by all"),
    "half_even_and_half_up": (half_even_and_half_up, f"with {FARES_SQL} select concat_ws('-', l_orderkey, l_linenumber, l_suppkey, item, observed_on) as fare, cast(round_even(cast(total as double), 0) as bigint) as even, cast(round(cast(total as double), 0) as bigint) as up from fares"),
}
