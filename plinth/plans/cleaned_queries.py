"""Queries of the cleaning chain, run as a stream over payloads rendered from orders, and of the texts that it reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plinth.functions import canonical
from plinth.functions.money import parse_money
from plinth.lineage import shared_folder
from plinth.operators import dedup
from plinth.plans.standin import WINDOWS, table
from plinth.sources.payload import Mapping, dig
from plinth.streaming import cleaning

#: Where an item's fields are in the payloads.
FIELDS = ("carrier_iata", "flight_number", "cabin", "fare_basis", "booking_class", "departure_local", "arrival_local", "inventory_status", "seats_remaining", "is_refundable", "currency", *cleaning.AMOUNTS)
MAPPING = Mapping("$.fares", {c: f"$.{c}" for c in FIELDS})
#: Files of the payloads' log, which are one batch: a quarter's payloads belong in one.
FILES = 48
#: Carriers as written, by line number, and what they mean.
CARRIERS = (("6E - INDIGO", "6E"), ("ai/ix", "AI"), (" uk ", "UK"), ("Q", None), ("SG8-x", "SG8"), ("6E", "6E"), ("AI", "AI"))


def _nth(words, at):
    return F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int"))


def payloads(spark, d):
    """Raw rows: one for each order and, of every fourth order, a second source's; each payload lists the order's lines.

    Every kind of fault is in it, by the keys' remainders: unknown sources, payloads cut off, unknown and circular routes, unreadable
    totals and carriers and times, departures before the observation, drifted lead times, missing and corrupt components.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ordered")).withColumn("copy", F.explode(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k, again = F.col("o_orderkey"), F.col("copy") == 1
    seen = F.date_trunc("quarter", "ordered").cast("date")
    raw = orders.select(
        k.alias("order"), "copy", F.concat_ws("-", k, "copy").alias("raw_id"),
        F.when(~again & (k % 29 == 0), "X9").otherwise(F.concat(F.lit("S"), F.pmod(k + F.col("copy"), F.lit(3)))).alias("source"),
        F.when(k % 17 == 0, "nowhere").otherwise(F.concat(F.lit("N"), F.col("o_custkey") % 5, F.lit("-N"), F.floor(F.col("o_custkey") / 5) % 5)).alias("route"),
        _nth(WINDOWS, k % 5 + 1).alias("lead_window"), seen.alias("seen"), (seen.cast("timestamp") + F.expr("interval 6 hours") + F.expr("interval 1 hour") * F.col("copy")).alias("captured_at"),
    )
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("int").alias("n"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", "l_quantity", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    # one shuffle by order serves the join, the lists and the files
    rows = raw.repartition(FILES, "order").join(line.repartition(FILES, "order"), "order")
    k, n, c = F.col("order"), F.col("n"), F.pmod("order", F.lit(6))
    total = (F.col("price") * F.when((F.col("l_tax") == 0.08) & (n == 1), 40).otherwise(1) * F.when((F.col("copy") == 1) & (k % 8 == 0), 2).otherwise(1)).cast("decimal(12,2)")
    rows = rows.withColumn("total", total)
    plain, grouped = F.col("total").cast("string"), F.format_number("total", 2)
    text = F.when(n % 4 == 0, plain).when(n % 4 == 1, F.concat(F.lit("₹ "), grouped)).when(n % 4 == 2, F.concat(F.lit("INR "), plain)).otherwise(F.concat(F.lit("Rs. "), grouped))
    day = F.when(k % 23 == 0, F.date_sub("seen", 3)).when(k % 19 == 0, F.date_add("seen", F.col("lead_window") + 5)).otherwise(F.date_add("seen", F.col("lead_window")))
    base = (F.col("total") - 100).cast("decimal(12,2)").cast("string")
    item = {
        "carrier_iata": _nth([w for w, _ in CARRIERS], n), "flight_number": F.concat(_nth([m or w for w, m in CARRIERS], n), F.lit(" 0"), k % 1000), "cabin": F.when(n % 2 == 0, "biz").otherwise("Y"), "fare_basis": F.concat(F.lit("b"), k, F.lit("l"), n, F.lit("p"), "l_partkey", F.lit("s"), "l_suppkey"),
        "departure_local": F.when(k % 13 == 0, "soon").otherwise(F.concat(day.cast("string"), F.lit("T10:35:00"))), "inventory_status": F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 2 == 0), "SOLD_OUT").otherwise("available"),
        "seats_remaining": F.col("l_quantity").cast("int").cast("string"), "total_fare": F.when(F.col("l_partkey") % 37 == 0, "4,521/-").when(F.col("l_partkey") % 41 == 0, "N/A").otherwise(text),
        "base_fare": F.when(c.isin(0, 3), base).when(c.isin(4, 5), "-500"), "udf": F.when(~c.isin(2, 5), "60.00"), "psf": F.when(c == 3, "500").otherwise("40"), **{x: F.lit("0") for x in ("asf", "gst", "other_charges")},
    }
    made = rows.groupBy(*raw.columns).agg(F.collect_list(F.struct(*[x.alias(name) for name, x in item.items()])).alias("fares"))
    whole = F.to_json(F.struct("fares"))
    made = made.withColumn("payload", F.when((F.col("copy") == 0) & (F.col("order") % 31 == 0), F.left(whole, F.length(whole) - 2)).otherwise(whole))
    return made.select("raw_id", "source", "route", "lead_window", "captured_at", "payload")


def chain(spark, d, folder):
    trust = spark.createDataFrame([("S0", 1), ("S1", 2), ("S2", 3)], "source string, trust_rank int")
    ends = spark.range(5).select(F.concat(F.lit("N"), "id").alias("origin"))
    routes = ends.crossJoin(ends.withColumnRenamed("origin", "destination")).select(F.concat_ws("-", "origin", "destination").alias("route"), "origin", "destination")
    return cleaning.Chain(MAPPING, trust, routes, folder)


def _cleaned(spark, d):
    """The chain, run over a stream of the payloads' log; all of its files are one batch, and so a quarter's payloads are."""
    folder = f"{shared_folder(spark)}/cleaning-{uuid.uuid4().hex}"
    raw = payloads(spark, d)
    raw.write.parquet(f"{folder}/raw")
    made = chain(spark, d, folder)
    made.run(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/raw"))
    return made


def cleaning_chain(spark, d):
    out = _cleaned(spark, d).fares(spark)
    return out.select(
        "raw_id", "fare_basis", "source", "route", "lead_window", "carrier", "flight_number", "cabin", F.unix_timestamp("departure_utc").alias("departs"), F.col("observation_date").cast("string").alias("observation_date"), *[F.col(c).cast("double").alias(c) for c in ("total_fare", "base_fare", "udf", "taxes_fees")],
        "inventory_status", "seats_remaining", "lead_drift", "quality_grade", F.array_join(F.array_sort("flags"), ",").alias("flags"), "is_duplicate", "dedup_reason", "conflict", "is_outlier", F.when(~F.col("is_duplicate") & (F.col("total_fare") > 0), F.col("score")).alias("score"),
    )


def cleaning_counters(spark, d):
    return _cleaned(spark, d).counters(spark)


def cleaning_rejections(spark, d):
    return _cleaned(spark, d).rejections(spark).groupBy("stage", "reason").agg(F.count("*").alias("n"), F.count_distinct("raw_id").alias("n_raw"))


def money_notations(spark, d):
    """Every order's total in one of twelve notations, and what is read of it."""
    n, k = F.col("price"), F.pmod("o_orderkey", F.lit(12))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    grouped, plain = F.format_number("price", 2), n.cast("string")
    cut = lambda q: F.concat((F.floor(q / 100)).cast("string"), F.lit("."), F.lpad(F.pmod(q, F.lit(100)).cast("string"), 2, "0"))
    texts = [
        F.concat(F.lit("₹ "), grouped), F.concat(F.lit("INR "), plain), plain, F.concat(F.lit("₹"), F.translate(grouped, ",.", ".,")), F.concat(F.lit("Rs. "), grouped), F.concat(cut(F.floor(n / 1000)), F.lit(" lakh")),
        F.concat(cut(F.floor(n / 10)), F.lit("k")), F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("$"), plain), F.lit("--"), F.concat(grouped, F.lit("/-")), F.translate(plain, "0123456789", "०१२३४५६७८९"),
    ]
    m = orders.select("o_orderkey", parse_money(F.element_at(F.array(*texts), k.cast("int") + 1), expected="INR").alias("m"))
    return m.select("o_orderkey", F.col("m.value").cast("string").alias("value"), "m.status")


def clock_texts(spark, d):
    """Times of day in six writings, two of them out of range now and then."""
    h, m = F.pmod("o_orderkey", F.lit(27)).cast("string"), F.lpad(F.pmod("o_custkey", F.lit(65)).cast("string"), 2, "0")
    two = F.lpad(h, 2, "0")
    texts = [F.concat(h, F.lit(":"), m), F.concat(two, m), F.concat(h, F.lit("."), m), F.concat(two, F.lit(":"), m, F.lit(" am")), F.concat(F.lit(" "), h, m, F.lit("PM ")), F.concat(h, F.lit("-"), m)]
    return table(spark, d, "orders").select("o_orderkey", canonical.clock_time(F.element_at(F.array(*texts), F.pmod("o_orderkey", F.lit(6)).cast("int") + 1)).alias("time"))


def digest_tokens(spark, d):
    """Digests of times with microseconds, of texts among all kinds of white space, and of blank ones, by the newer rules and the older."""
    e = table(spark, d, "events")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(3)))
    text = F.when(F.col("event_id") % 5 == 0, F.lit(" \t\r\n")).otherwise(F.concat(F.lit("\t \u00a0"), "event_type", F.lit("\x0b \u2003\n")))
    amount = F.floor(F.col("value") * 10).cast("decimal(20,2)")
    parts = lambda blank: [dedup.token(at, "timestamp"), dedup.token(text, blank=blank), dedup.token(amount, "decimal"), dedup.token(F.lit(None).cast("string"), blank=blank)]
    return e.select("event_id", dedup.digest(parts(None)).alias("newer"), dedup.digest(parts(dedup.BLANK)).alias("older"))


#: Paths into the nested payloads of dug_paths, and what they lead to.
PATHS = {"amount": "data.list.price.amount", "first": "data.list.0.id", "beyond": "data.list.9.id", "through": "data.n.x", "missing": "data.nothing", "digits": "data.7", "second": "data.pairs.1.0", "null_first": "data.list.note"}


def dug_paths(spark, d):
    """Values by path out of payloads of objects, lists of objects and lists of lists, made of the orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"))
    k = F.col("o_orderkey").cast("string")
    priced = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('{"price":{"amount":"'), "price", F.lit('"}},')))
    text = F.concat(F.lit('{"data":{"n":'), k, F.lit(',"7":"'), "o_orderstatus", F.lit('","pairs":[[1],['), k, F.lit(',2]],"list":[{"id":'), k, F.lit("},"), priced, F.lit('4,{"note":null},{"note":"x"},{"price":{"amount":"last"}}]}}'))
    rows = o.select("o_orderkey", F.try_parse_json(text).alias("v"))
    return rows.select("o_orderkey", *[F.try_variant_get(dig(F.col("v"), path.split(".")), "$", "string").alias(name) for name, path in PATHS.items()])


def _case(words, at):
    return f"case {at} " + " ".join(f"when {i + 1} then {'null' if w is None else repr(w)}" for i, w in enumerate(words)) + " end"


_RAW = """raws as (select o_orderkey as k, copy, o_custkey % 5 as a, o_custkey // 5 % 5 as b, list_extract([1, 7, 15, 30, 45], cast(o_orderkey % 5 as int) + 1) as lead_window, cast(date_trunc('quarter', o_orderdate) as date) as seen,
  case when copy = 0 and o_orderkey % 29 = 0 then 'X9' else 'S' || (o_orderkey + copy) % 3 end as source, copy = 0 and o_orderkey % 31 = 0 as torn from orders join (values (0), (1)) c(copy) on copy = 0 or o_orderkey % 4 = 0)"""
_STAGES = f"""{_RAW},
items as (select r.*, l_linenumber as n, 'b' || k || 'l' || l_linenumber || 'p' || l_partkey || 's' || l_suppkey as fare_basis, {_case([m for _, m in CARRIERS], 'cast(l_linenumber as int)')} as carrier, l_quantity, l_partkey % 37 = 0 as unreadable, l_returnflag = 'N' and l_linestatus = 'O' and l_suppkey % 2 = 0 as sold,
  case when l_partkey % 37 <> 0 and l_partkey % 41 <> 0 then cast(l_extendedprice as decimal(12,2)) * case when l_tax = 0.08 and l_linenumber = 1 then 40 else 1 end * case when copy = 1 and k % 8 = 0 then 2 else 1 end end as amount
  from raws r join lineitem l on l.l_orderkey = r.k where source <> 'X9' and not torn),
judged as (select *, sold or amount is null as unpriced, case when sold or amount is null then null else amount end as total_fare,
  case when k % 23 = 0 and k % 13 <> 0 then -3 - lead_window when k % 19 = 0 and k % 13 <> 0 then 5 else 0 end as drift,
  case when k % 13 = 0 then epoch(cast(seen as timestamp)) + lead_window * 86400 - 19800 else epoch(cast(seen as timestamp)) + 18300 + 86400 * case when k % 23 = 0 then -3 when k % 19 = 0 then lead_window + 5 else lead_window end end as departs from items),
staged as (select *, case when unreadable then 'currency' when carrier is null or (k % 13 = 0 and not unpriced) then 'canonicalisation' when k % 17 = 0 or a = b or drift < -1 then 'structural' end as stage,
  case when unreadable then 'total_fare unparseable' when carrier is null then 'invalid carrier designator' when k % 13 = 0 and not unpriced then 'undecodable departure time' when k % 17 = 0 then 'observation has no route' when a = b then 'circular route' when drift < -1 then 'departure precedes observation' end as reason,
  case when unpriced then 'D' when k % 6 in (0, 1, 4) then 'A' when k % 6 = 2 then 'B' when k % 6 = 5 then 'C' when 460 <= greatest(0.05, amount * 0.005) then 'A' else 'C' end as grade from judged),
accepted as (select *, 'N' || a || '-N' || b as route, case when n % 2 = 0 then 'BUSINESS' else 'ECONOMY' end as cabin, case when sold then 'SOLD_OUT' when unpriced then 'PRICE_UNAVAILABLE' else 'AVAILABLE' end as inventory_status,
  count(*) over (partition by fare_basis) as members, row_number() over (partition by fare_basis order by source) as place from staged where stage is null),
uniques as (select *, members = 2 and k % 8 = 0 and not unpriced as conflict, case when place > 1 then 'lost_tie_break' when members = 1 then 'unique' when k % 8 = 0 and not unpriced then 'source_trust' else 'exact_duplicate' end as dedup_reason from accepted),
work as (select *, ln(cast(total_fare as double)) as w from uniques where place = 1 and total_fare > 0),
mids as (select route, cabin, lead_window, seen, count(*) as size, quantile_cont(w, 0.5) as centre from work group by all),
offs as (select w.*, m.size, m.centre, abs(w.w - m.centre) as d from work w join mids m using (route, cabin, lead_window, seen)),
scales as (select route, cabin, lead_window, seen, quantile_cont(d, 0.5) as mad, avg(d) as dev from offs group by all),
scored as (select o.*, round_even(case when size < 5 then 0 when mad > 0 then (w - centre) * 0.6745 / mad when dev > 0 then (w - centre) / (1.253314 * dev) else 0 end, 6) as score from offs o join scales s using (route, cabin, lead_window, seen)),
screened as (select *, abs(score) > 3.5 and row_number() over (partition by route, cabin, lead_window, seen, abs(score) > 3.5 order by abs(score) desc) <= greatest(floor(size * 0.25), 1) as is_outlier from scored),
marked as (select u.*, s.score, coalesce(s.is_outlier, false) as is_outlier from uniques u left join screened s on s.copy = u.copy and s.fare_basis = u.fare_basis)"""
_CHAIN = f"""with {_STAGES} select k || '-' || copy as raw_id, fare_basis, source, route, lead_window, carrier, cast(k % 1000 as varchar) as flight_number, cabin, cast(departs as bigint) as departs, cast(seen as varchar) as observation_date,
  cast(total_fare as double) as total_fare, cast(case when not unpriced and k % 6 not in (2, 5) then amount - 100 end as double) as base_fare, case when not unpriced and k % 6 not in (2, 5) then 60.0::double end as udf, case when unpriced or k % 6 in (2, 5) then null when k % 6 = 3 then 560.0::double else 100.0::double end as taxes_fees,
  inventory_status, cast(l_quantity as int) as seats_remaining, case when drift <> 0 then drift end as lead_drift, case when is_outlier and grade = 'A' then 'C' else grade end as quality_grade,
  array_to_string(list_sort(list_filter([case when inventory_status = 'SOLD_OUT' then 'SOLD_OUT' when inventory_status = 'PRICE_UNAVAILABLE' then 'PRICE_UNAVAILABLE' end, case when k % 13 = 0 then 'MODELLED' end, case when drift <> 0 then 'STALE_OBSERVATION' end, case when not unpriced then 'EXPLICIT_ZERO' end,
    case when not unpriced and k % 6 in (1, 4) then 'COMPONENT_DERIVED' end, case when not unpriced and k % 6 = 2 then 'PARTIAL_BREAKDOWN' when not unpriced and k % 6 = 5 then 'COMPONENT_UNPARSEABLE' when not unpriced and k % 6 = 3 and grade = 'C' then 'TOTAL_MISMATCH' end,
    case when conflict then 'CROSS_SOURCE_CONFLICT' end, case when place > 1 then 'DUPLICATE_SUPPRESSED' end, case when is_outlier and score > 0 then 'OUTLIER_HIGH' when is_outlier then 'OUTLIER_LOW' end], lambda x: x is not null)), ',') as flags,
  place > 1 as is_duplicate, dedup_reason, conflict, is_outlier, score from marked"""
_COUNTERS = f"""with {_STAGES} select count(*) as extracted, cast(sum(cast(unreadable as int) + cast(k % 6 in (4, 5) as int)) as bigint) as currency_failures, count(case when stage = 'canonicalisation' then 1 end) as canonicalisation_failures, count(case when stage = 'structural' then 1 end) as structural_rejects,
  count(case when stage is null and not unpriced and k % 6 in (2, 5) then 1 end) as partial_breakdown, count(case when stage is null and not unpriced and k % 6 = 3 and grade = 'C' then 1 end) as total_mismatch, count(case when sold and coalesce(stage, '') not in ('currency', 'canonicalisation') then 1 end) as sold_out,
  count(case when unpriced and not sold and coalesce(stage, '') not in ('currency', 'canonicalisation') then 1 end) as price_unavailable, (select count(*) from marked where place > 1) as duplicates, (select count(*) from marked where place = 1 and conflict) as cross_source_conflicts, (select count(*) from marked where is_outlier) as outliers, (select count(*) from marked) as written from staged"""
_REJECTED = f"""with {_STAGES}, told as (select k || '-' || copy as raw_id, stage, reason from staged where stage is not null union all select k || '-' || copy, 'extraction', case when source = 'X9' then 'no collector registered for source X9' else 'payload is not JSON' end from raws where (source = 'X9' or torn) and k in (select l_orderkey from lineitem))
select stage, reason, count(*) as n, count(distinct raw_id) as n_raw from told group by stage, reason"""

_NOTATIONS = """with o as (select o_orderkey, cast(o_totalprice as decimal(12,2)) as price, o_orderkey % 12 as k from orders)
select o_orderkey, cast(case when k in (0, 1, 2, 3, 4, 11) then price when k = 5 then cast(floor(price / 1000) * 1000 as decimal(12,2)) when k = 6 then cast(floor(price / 10) * 10 as decimal(12,2)) end as varchar) as value,
  case k when 7 then 'negative_rejected' when 8 then 'wrong_currency' when 9 then 'missing' when 10 then 'unparseable' else 'ok' end as status from o"""
_CLOCKS = """with o as (select o_orderkey, o_orderkey % 27 as h, o_custkey % 65 as m, o_orderkey % 6 as form from orders),
t as (select *, case when form = 3 and h = 12 then 0 when form = 4 and h < 12 then h + 12 else h end as hour from o)
select o_orderkey, case when form <> 5 and m < 60 and hour < 24 then lpad(cast(hour as varchar), 2, '0') || ':' || lpad(cast(m as varchar), 2, '0') end as time from t"""
_TOKENS = """with e as (select event_id, ts + to_microseconds(event_id % 3) as instant, case when event_id % 5 <> 0 then upper(event_type) else '' end as text, cast(floor(value * 10) as bigint) as amount from events),
t as (select *, strftime(instant, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(instant) % 1000000 <> 0 then '.' || lpad(cast(epoch_us(instant) % 1000000 as varchar), 6, '0') else '' end || '+00:00' as moment, chr(0) || 'MISSING' as gone from e)
select event_id, sha256(moment || chr(31) || text || chr(31) || amount || chr(31) || gone) as newer, sha256(moment || chr(31) || case when text = '' then chr(0) || 'NULL' else text end || chr(31) || amount || chr(31) || gone) as older from t"""

_DUG = """select o_orderkey, case when o_orderkey % 3 = 0 then 'last' else cast(cast(o_totalprice as decimal(12,2)) as varchar) end as amount, cast(o_orderkey as varchar) as first, cast(null as varchar) as beyond, cast(null as varchar) as through, cast(null as varchar) as missing,
  o_orderstatus as digits, cast(o_orderkey as varchar) as second, cast(null as varchar) as null_first from orders"""

QUERIES = {
    "dug_paths": (dug_paths, _DUG),
    "money_notations": (money_notations, _NOTATIONS),
    "clock_texts": (clock_texts, _CLOCKS),
    "digest_tokens": (digest_tokens, _TOKENS),
    "cleaning_chain": (cleaning_chain, _CHAIN),
    "cleaning_counters": (cleaning_counters, _COUNTERS),
    "cleaning_rejections": (cleaning_rejections, _REJECTED),
}
