"""Queries of provenance, serving and planning, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions.rounding import half_even
from plinth.operators import provenance, serving
from plinth.plans.index_queries import _national, _prices
from plinth.plans.standin import FARES_SQL, fares, table

_FARE = ("l_orderkey", "l_linenumber", "l_suppkey", "item", "observed_on")
_FARE_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_suppkey, item, observed_on)"


def _fares(spark, d):
    rows = fares(spark, d).withColumn("fare", F.concat_ws("-", *_FARE))
    return rows.withColumn("is_sold_out", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).withColumn("priced", F.when(~F.col("is_sold_out"), F.col("total")))


_ROWS = f"{FARES_SQL}, rows as (select *, {_FARE_SQL} as fare, l_returnflag = 'N' and l_linestatus = 'O' as is_sold_out, case when not (l_returnflag = 'N' and l_linestatus = 'O') then total end as priced from fares)"


def merkle_root(spark, d):
    """Roots over the fingerprints of each route's lines of each month."""
    leaf = F.unhex(F.sha2(F.concat_ws("\x1f", "l_orderkey", "l_linenumber", "l_suppkey", "item"), 256))
    return provenance.merkle_by(fares(spark, d).select("route", F.date_format("observed_on", "yyyy-MM").alias("month"), leaf.alias("leaf")), ["route", "month"], "leaf")


def _bodies(spark, d):
    yearly = fares(spark, d).groupBy("route", "year").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    body = provenance.canonical_json({"route": F.col("route"), "year": F.col("year"), "n": F.col("n"), "total": F.col("total")})
    return yearly.select("route", "year", body.alias("body"))


def canonical_json(spark, d):
    return _bodies(spark, d)


def chain_hash(spark, d):
    return provenance.chained(_bodies(spark, d), ["route"], "year", "body").select("route", "year", "previous_hash", "chain_hash")


def chain_verify(spark, d):
    """The chains with one body changed in routes that end in 7, and one back-link in those that end in 3."""
    c = provenance.chained(_bodies(spark, d), ["route"], "year", "body")
    c = c.withColumn("body", F.when(F.col("route").endswith("7") & (F.col("year") == 1998), F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    moved = F.col("route").endswith("3") & (F.col("year") == 1999)
    c = c.withColumn("previous_hash", F.when(moved, F.lit("0")).otherwise(F.col("previous_hash"))).withColumn("chain_hash", F.when(moved, F.sha2(F.concat(F.lit("0"), "body"), 256)).otherwise(F.col("chain_hash")))
    return provenance.verified(c, ["route"], "year", "body")


def previous_hash_asof(spark, d):
    c = provenance.chained(_bodies(spark, d), ["route"], "year", "body")
    return provenance.previous_as_of(c, ["route"], "year", "chain_hash").select("route", "year", F.col("previous_chain_hash").alias("previous"))


def _edges(spark, d):
    """Customers below nations below regions, as edges of one lineage."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return c.unionAll(n)


def lineage_ancestors(spark, d):
    return provenance.ancestors(_edges(spark, d))


def dangling_edges(spark, d):
    nodes = table(spark, d, "nation").where("n_nationkey % 5 <> 2").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).unionAll(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")))
    return provenance.dangling(_edges(spark, d), nodes)


def fares_filter(spark, d):
    wanted = {"route__iexact": "brand#7", "lead_window__in": [7, 30], "total__gte": 20000, "total__lte": 60000, "is_sold_out": False}
    return serving.filtered(_fares(spark, d), wanted).select("fare", F.col("total").cast("double").alias("total"))


def fares_summary(spark, d):
    return serving.summary(_fares(spark, d), "priced")


def index_eligible(spark, d):
    rows = _fares(spark, d).withColumns({"is_duplicate": F.col("l_linenumber") == 6, "is_outlier": F.col("l_tax") > 0.07, "quality_grade": F.element_at(F.array(*map(F.lit, "ABCD")), F.pmod("l_suppkey", F.lit(4)).cast("int") + 1)})
    return rows.where(serving.eligible("priced")).groupBy("route").agg(F.count("*").alias("n"))


def _levels(spark, d):
    """The national series as points: window, year, level (to six places) and whether it is published."""
    n = _national(spark, d)
    return n.select("lead_window", "year", half_even(F.col("level"), 6).alias("level"), (F.col("year") != 1998).alias("is_published"))


def latest_per_window(spark, d):
    y = fares(spark, d).groupBy("lead_window", "year").agg(F.count("*").alias("n"))
    return serving.latest(y, ["lead_window"], ["year"])


def series_range(spark, d):
    y = fares(spark, d).groupBy("route", "lead_window", "observed_on").agg(F.count("*").alias("n"))
    return y.where((F.col("route") == "Brand#3") & (F.col("lead_window") == 7) & F.col("observed_on").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("observed_on", "n")


def visible_series(spark, d):
    y = fares(spark, d).groupBy("route", "year").agg(F.count("*").alias("n")).withColumn("is_published", F.col("year") != 1998)
    return serving.visible(y, "analyst").select("route", "year", "n")


def lead_time_curve(spark, d):
    return serving.lead_time_curve(_fares(spark, d), "lead_window", "priced")


def lead_time_curve_with_index(spark, d):
    curve = serving.lead_time_curve(_fares(spark, d), "lead_window", "priced").select("lead_window", "n")
    newest = serving.latest(fares(spark, d).where("lead_window <> 45").groupBy("lead_window", "year").agg(F.max("total").cast("double").alias("highest")), ["lead_window"], ["year"])
    return curve.join(newest, "lead_window", "left")


def sold_out_share(spark, d):
    return _fares(spark, d).groupBy("lead_window").agg(half_even(F.avg(F.col("is_sold_out").cast("int")), 4).alias("share"))


def keyset_page(spark, d):
    rows = _fares(spark, d).select("fare", F.date_diff("observed_on", F.lit("1970-01-01").cast("date")).alias("day"))
    return serving.keyset_page(rows, "day", "fare", (rows.agg(F.max("day")).scalar(), ""), 50)


def numbered_page(spark, d):
    return serving.numbered_page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 100)


def topk_abs_score(spark, d):
    return serving.top_by(_fares(spark, d).select("route", "fare", "total"), ["route"], F.col("total"), "fare", 3).select("route", "fare", "place")


def unknown_codes(spark, d):
    asked = spark.createDataFrame([("Brand#1",), ("Brand#99",), ("Brand#5",), ("XX",)], "route string")
    return serving.unknown_codes(asked, fares(spark, d), "route")


def set_union_hashes(spark, d):
    f = fares(spark, d)
    some = lambda w: f.where(F.col("lead_window") == w).select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("hash"))
    return some(1).union(some(7)).distinct()


def set_intersect_keys(spark, d):
    p = _prices(spark, d)
    return p.where("year = 1995").select("route", "item").intersect(p.where("year = 1999").select("route", "item"))


def distinct_inputs(spark, d):
    """How many distinct inputs each route's values stand on, and all routes together."""
    f = fares(spark, d).select("route", "l_orderkey")
    return f.rollup("route").agg(F.count_distinct("l_orderkey").alias("n"))


def plan_cross_join(spark, d):
    sources = table(spark, d, "region").select(F.col("r_name").alias("source"))
    routes = table(spark, d, "nation").select(F.col("n_name").alias("route"))
    windows = spark.createDataFrame([(w,) for w in (1, 7, 15, 30, 45)], "lead_window int")
    return serving.collection_plan(sources, routes, windows)


def semi_basket(spark, d):
    basket = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size")).where("size > 25").select(F.col("p_brand").alias("route"))
    return fares(spark, d).join(basket, "route", "left_semi").groupBy("route").agg(F.count("*").alias("n"))


def null_safe_series_key(spark, d):
    s = fares(spark, d).groupBy("route", "year").agg(F.count("*").alias("n")).withColumn("route", F.when(F.col("route") != "Brand#9", F.col("route")))
    old = s.where("year < 2000").withColumn("version", F.lit(1))
    new = s.where("year > 1997").withColumns({"version": F.lit(2), "n": F.col("n") + 1})
    newest = F.row_number().over(Window.partitionBy(F.coalesce("route", F.lit("NATIONAL")), "year").orderBy(F.desc("version")))
    return old.unionByName(new).withColumn("place", newest).where("place = 1").select("route", "year", "n", "version")


def json_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("total"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return serving.as_json(rows)


_BODIES = f"{FARES_SQL}, yearly as (select route, year, count(*) as n, sum(total) as total from fares group by route, year), bodies as (select route, cast(year as bigint) as year, '{{\"n\":\"' || n || '\",\"route\":\"' || route || '\",\"total\":\"' || total || '\",\"year\":\"' || year || '\"}}' as body from yearly)"
_CHAIN = f"""numbered as (select *, row_number() over (partition by route order by year) as k from bodies),
chain(route, year, k, body, previous_hash, chain_hash) as (select route, year, k, body, '', sha256(body) from numbered where k = 1
  union all select n.route, n.year, n.k, n.body, c.chain_hash, sha256(c.chain_hash || n.body) from chain c join numbered n on n.route = c.route and n.k = c.k + 1)"""
_EDGES = "edges as (select 'c' || c_custkey as child, 'n' || c_nationkey as parent from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"

QUERIES = {
    "merkle_root": (merkle_root, f"""with recursive {FARES_SQL}, leaves as (select distinct route, strftime(observed_on, '%Y-%m') as month, sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_suppkey, item)) as leaf from fares),
tree(route, month, n_leaves, nodes) as (select route, month, count(*), list(leaf order by leaf) from leaves group by route, month
  union all select route, month, n_leaves, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(unhex(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], nodes[2 * i + 1])))) from tree where len(nodes) > 1)
select route, month, n_leaves, nodes[1] as root from tree where len(nodes) = 1"""),
    "canonical_json": (canonical_json, f"with {_BODIES} select * from bodies"),
    "chain_hash": (chain_hash, f"with recursive {_BODIES}, {_CHAIN} select route, year, previous_hash, chain_hash from chain"),
    "chain_verify": (chain_verify, f"with {FARES_SQL}, y as (select distinct route, cast(year as bigint) as year from fares) select route, count(*) as n, not (route like '%7' or route like '%3') as valid, case when route like '%7' then 1998 when route like '%3' then 1999 end as first_broken, case when route like '%7' then 'digest mismatch' when route like '%3' then 'broken back-link' end as reason from y group by route"),
    "previous_hash_asof": (previous_hash_asof, f"with recursive {_BODIES}, {_CHAIN} select route, year, nullif(previous_hash, '') as previous from chain"),
    "lineage_ancestors": (lineage_ancestors, f"with {_EDGES} select child as node, parent as ancestor, 1 as distance from edges union all select a.child, b.parent, 2 from edges a join edges b on a.parent = b.child"),
    "dangling_edges": (dangling_edges, f"with {_EDGES} select child, parent from edges where parent not in (select 'n' || n_nationkey from nation where n_nationkey % 5 <> 2 union all select 'r' || r_regionkey from region)"),
    "fares_filter": (fares_filter, f"with {_ROWS} select fare, cast(total as double) as total from rows where lower(route) = 'brand#7' and lead_window in (7, 30) and total between 20000 and 60000 and not is_sold_out"),
    "fares_summary": (fares_summary, f"with {_ROWS} select count(*) as n, count(priced) as n_priced, count(*) - count(priced) as n_unpriced, cast(min(priced) as double) as lowest, cast(max(priced) as double) as highest, round_even(quantile_cont(cast(priced as double), 0.5), 2) as median from rows"),
    "index_eligible": (index_eligible, f"with {_ROWS} select route, count(*) as n from rows where priced > 0 and l_linenumber <> 6 and l_tax <= 0.07 and l_suppkey % 4 in (0, 1) group by route"),
    "latest_per_window": (latest_per_window, f"with {FARES_SQL}, y as (select lead_window, year, count(*) as n from fares group by all) select lead_window, year, n from y qualify row_number() over (partition by lead_window order by year desc) = 1"),
    "series_range": (series_range, f"with {FARES_SQL} select observed_on, count(*) as n from fares where route = 'Brand#3' and lead_window = 7 and observed_on between date '1996-01-01' and date '1996-12-31' group by all"),
    "visible_series": (visible_series, f"with {FARES_SQL} select route, year, count(*) as n from fares where year <> 1998 group by all"),
    "lead_time_curve": (lead_time_curve, f"with {_ROWS} select lead_window, count(priced) as n, round_even(quantile_cont(cast(priced as double), 0.25), 4) as p25, round_even(quantile_cont(cast(priced as double), 0.5), 4) as p50, round_even(quantile_cont(cast(priced as double), 0.75), 4) as p75, round_even(exp(avg(ln(cast(priced as double)))), 4) as geomean, round_even(avg(cast(is_sold_out as int)), 4) as sold_out_share from rows group by lead_window"),
    "lead_time_curve_with_index": (lead_time_curve_with_index, f"with {_ROWS}, c as (select lead_window, count(priced) as n from rows group by all), y as (select lead_window, year, cast(max(total) as double) as highest from rows where lead_window <> 45 group by all), z as (select * from y qualify row_number() over (partition by lead_window order by year desc) = 1) select c.lead_window, c.n, y.year, y.highest from c left join z y on y.lead_window = c.lead_window"),
    "sold_out_share": (sold_out_share, f"with {_ROWS} select lead_window, round_even(avg(cast(is_sold_out as int)), 4) as share from rows group by lead_window"),
    "keyset_page": (keyset_page, f"with {_ROWS}, k as (select fare, cast(observed_on - date '1970-01-01' as bigint) as day from rows) select fare, day from k where day < (select max(day) from k) order by day desc, fare desc limit 50"),
    "numbered_page": (numbered_page, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 200"),
    "topk_abs_score": (topk_abs_score, f"with {_ROWS} select route, fare, row_number() over (partition by route order by total desc, fare) as place from rows qualify place <= 3"),
    "unknown_codes": (unknown_codes, "select * from (values ('Brand#99'), ('XX')) t(route)"),
    "set_union_hashes": (set_union_hashes, f"with {FARES_SQL} select distinct sha256(cast(l_orderkey as varchar)) as hash from fares where lead_window in (1, 7)"),
    "set_intersect_keys": (set_intersect_keys, f"with {FARES_SQL} select route, item from fares where year = 1995 intersect select route, item from fares where year = 1999"),
    "distinct_inputs": (distinct_inputs, f"with {FARES_SQL} select route, count(distinct l_orderkey) as n from fares group by rollup (route)"),
    "plan_cross_join": (plan_cross_join, "select r_name as source, n_name as route, w.lead_window from region cross join nation cross join (values (1), (7), (15), (30), (45)) w(lead_window)"),
    "semi_basket": (semi_basket, f"with {FARES_SQL} select route, count(*) as n from fares where route in (select p_brand from part group by p_brand having avg(p_size) > 25) group by route"),
    "null_safe_series_key": (null_safe_series_key, f"with {FARES_SQL}, s as (select case when route <> 'Brand#9' then route end as route, year, count(*) as n from fares group by all), u as (select *, 1 as version from s where year < 2000 union all select route, year, n + 1, 2 from s where year > 1997) select route, year, n, version from u qualify row_number() over (partition by coalesce(route, 'NATIONAL'), year order by version desc) = 1"),
    "json_rows": (json_rows, "select '{\"o_orderkey\":' || o_orderkey || ',\"total\":\"' || cast(o_totalprice as decimal(12,2)) || '\",\"status\":' || case when o_orderstatus <> 'P' then '\"' || o_orderstatus || '\"' else 'null' end || '}' as json from orders"),
}
