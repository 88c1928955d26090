"""Queries of robust screening and of deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.rounding import half_even
from plinth.operators import dedup, robust
from plinth.plans.standin import FARES_SQL, fares, table

CELL = ["route", "lead_window"]


def _scores(spark, d, log=True):
    rows = fares(spark, d).select(*CELL, "l_orderkey", "l_linenumber", "l_suppkey", "total", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "item").alias("fare"))
    return robust.scored(rows, CELL, "total", log)


def exact_median(spark, d):
    return robust.quantiles(fares(spark, d), CELL, "total", {"median": 0.5}).select(*CELL, half_even(F.col("median"), 4).alias("median"))


def median_by_rank(spark, d):
    return robust.median_by_rank(fares(spark, d).select(*CELL, "total"), CELL, "total").select(*CELL, half_even(F.col("median").cast("double"), 3).alias("median"))


def mad(spark, d):
    return robust.centres(fares(spark, d), CELL, "total", log=False).select(*CELL, half_even(F.col("mad"), 4).alias("mad"))


def mean_abs_dev(spark, d):
    """As the sum of deviations, which is in whole half-cents and so has no ties to round."""
    return robust.centres(fares(spark, d), CELL, "total", log=False).select(*CELL, "n", half_even(F.col("mean_deviation") * F.col("n"), 3).alias("deviations"))


def modified_z_log(spark, d):
    return _scores(spark, d).select("fare", "score")


def modified_z_linear(spark, d):
    return _scores(spark, d, log=False).select("fare", "score")


def outlier_capped(spark, d):
    return robust.outliers(_scores(spark, d), CELL, "fare", threshold=2.0).select("fare", "score")


def outlier_report(spark, d):
    return robust.screening(_scores(spark, d), CELL, threshold=2.0).select(*CELL, "n", "method", "uses_log", half_even(F.col("centre"), 6).alias("centre"), half_even(F.col("scale"), 6).alias("scale"), "n_outliers")


def contamination_rate(spark, d):
    return robust.screening(_scores(spark, d), CELL, threshold=2.0).select(*CELL, "contamination")


_SCORES = """rows as (select route, lead_window, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, item) as fare, cast(total as double) as x from fares),
work as (select *, {w} as w from rows),
mids as (select route, lead_window, count(*) as n, quantile_cont(w, 0.5) as centre from work group by all),
offs as (select w.*, m.n, m.centre, abs(w.w - m.centre) as d from work w join mids m on m.route = w.route and m.lead_window = w.lead_window),
scales as (select route, lead_window, quantile_cont(d, 0.5) as mad, avg(d) as mean_deviation from offs group by all),
scores as (select o.*, s.mad, s.mean_deviation, round_even(case when o.n < 5 then 0 when s.mad > 0 then (o.w - o.centre) * 0.6745 / s.mad when s.mean_deviation > 0 then (o.w - o.centre) / (1.253314 * s.mean_deviation) else 0 end, 6) as score
  from offs o join scales s on s.route = o.route and s.lead_window = o.lead_window)"""
_LOG = f"{FARES_SQL}, {_SCORES.format(w='ln(x)')}"
_LINEAR = f"{FARES_SQL}, {_SCORES.format(w='x')}"
_FLAGS = f"""{_LOG}, flags as (select *, abs(score) > 2.0 and row_number() over (partition by route, lead_window, abs(score) > 2.0 order by abs(score) desc, fare) <= greatest(floor(n * 0.25), 1) as is_outlier from scores)"""


# --- deduplication: lines that share an order and a line number are members of one group ----------------------------


#: What a quote's fingerprint is the digest of.
IDENTITY = ["l_orderkey", "l_linenumber"]


def _ranked(spark, d, parted=False):
    orders = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("trust"))
    rows = fares(spark, d)
    return (rows.repartition("l_orderkey") if parted else rows).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _digested(rows):
    rows = rows.withColumn("fingerprint", dedup.digest([dedup.token(F.col(c)) for c in IDENTITY]))
    rows = rows.withColumn("content", dedup.digest([F.col("fingerprint"), dedup.token(F.col("total"), "decimal"), dedup.token(F.col("l_suppkey")), dedup.token(F.col("item")), dedup.token(F.col("l_returnflag"))]))
    return rows.withColumn("completeness", F.when(F.col("l_returnflag") == "N", 2).otherwise(4)).withColumn("fare", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "item", "observed_on"))


def _quotes(spark, d):
    return _digested(_ranked(spark, d))


def _marked(spark, d):
    """Digests and keys are made where the rows of a fingerprint have met, as they are longer than all that they are made of.

    One shuffle by order serves the join with orders and the windows.
    """
    return dedup.survivors(_digested(_ranked(spark, d, parted=True)), IDENTITY, "trust", "completeness", "observed_on", "content", "total")


def fingerprint_sha256(spark, d):
    return _quotes(spark, d).select("fare", "fingerprint")


def content_sha256(spark, d):
    return _quotes(spark, d).select("fare", "content")


def survivor_select(spark, d):
    return _marked(spark, d).where("place = 1").select("fingerprint", "fare", "members")


def dedup_reason(spark, d):
    return _marked(spark, d).groupBy("dedup_reason").agg(F.count("*").alias("n"))


def cross_source_conflict(spark, d):
    return _marked(spark, d).where("conflict").select("fare", "spread")


def dedup_stats(spark, d):
    return dedup.stats(_marked(spark, d))


def dup_link(spark, d):
    return dedup.winners_linked(_marked(spark, d), IDENTITY, "fare").where("is_duplicate").select("fare", "duplicate_of")


def content_duplicates(spark, d):
    """Documents of one content, by digest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.trim(F.col("text")), 256).alias("content"))
    return docs.groupBy("content").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_QUOTES = f"""{FARES_SQL},
quotes as (select f.*, cast(substr(o.o_orderpriority, 1, 1) as int) as trust, case when l_returnflag = 'N' then 2 else 4 end as completeness,
  sha256(concat(l_orderkey, chr(31), l_linenumber)) as fingerprint, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, item, observed_on) as fare from fares f join orders o on o.o_orderkey = f.l_orderkey),
contents as (select *, sha256(concat(fingerprint, chr(31), regexp_replace(regexp_replace(cast(total as varchar), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), chr(31), l_suppkey, chr(31), item, chr(31), l_returnflag)) as content from quotes),
marked as (select *, count(*) over w as members, row_number() over o as place, lead(trust) over o as nt, lead(completeness) over o as nc, lead(observed_on) over o as nd,
  min(content) over w = max(content) over w as same, cast(min(total) over w as double) as low, cast(max(total) over w as double) as high
  from contents window w as (partition by fingerprint), o as (partition by fingerprint order by trust, completeness desc, observed_on desc, content)),
reasons as (select *, case when members = 1 then 'unique' when place > 1 then 'lost_tie_break' when same then 'exact_duplicate' when trust <> nt then 'source_trust' when completeness <> nc then 'completeness' when observed_on <> nd then 'freshness' else 'content_hash' end as dedup_reason,
  not same and low > 0 and (high - low) / low > 0.02 as conflict, case when low > 0 then round_even((high - low) / low, 4) else 0 end as spread from marked)"""

QUERIES = {
    "exact_median": (exact_median, f"with {FARES_SQL} select route, lead_window, round_even(quantile_cont(cast(total as double), 0.5), 4) as median from fares group by all"),
    "median_by_rank": (median_by_rank, f"with {FARES_SQL} select route, lead_window, round_even(quantile_cont(cast(total as double), 0.5), 3) as median from fares group by all"),
    "mad": (mad, f"with {_LINEAR} select route, lead_window, round_even(mad, 4) as mad from scales"),
    "mean_abs_dev": (mean_abs_dev, f"with {_LINEAR} select s.route, s.lead_window, m.n, round_even(s.mean_deviation * m.n, 3) as deviations from scales s join mids m on m.route = s.route and m.lead_window = s.lead_window"),
    "modified_z_log": (modified_z_log, f"with {_LOG} select fare, score from scores"),
    "modified_z_linear": (modified_z_linear, f"with {_LINEAR} select fare, score from scores"),
    "outlier_capped": (outlier_capped, f"with {_FLAGS} select fare, score from flags where is_outlier"),
    "outlier_report": (outlier_report, f"with {_FLAGS} select route, lead_window, max(n) as n, max(case when n < 5 then 'INSUFFICIENT_DATA' when mad > 0 then 'MODIFIED_Z_MAD' when mean_deviation > 0 then 'MODIFIED_Z_MEANAD' else 'DEGENERATE_ZERO_SCALE' end) as method, true as uses_log, round_even(max(centre), 6) as centre, round_even(max(case when n < 5 then null when mad > 0 then mad when mean_deviation > 0 then mean_deviation end), 6) as scale, cast(sum(cast(is_outlier as int)) as bigint) as n_outliers from flags group by route, lead_window"),
    "contamination_rate": (contamination_rate, f"with {_FLAGS} select route, lead_window, round_even(avg(cast(is_outlier as int)), 4) as contamination from flags group by route, lead_window"),
    "fingerprint_sha256": (fingerprint_sha256, f"with {_QUOTES} select fare, fingerprint from quotes"),
    "content_sha256": (content_sha256, f"with {_QUOTES} select fare, content from contents"),
    "survivor_select": (survivor_select, f"with {_QUOTES} select fingerprint, fare, members from reasons where place = 1"),
    "dedup_reason": (dedup_reason, f"with {_QUOTES} select dedup_reason, count(*) as n from reasons group by dedup_reason"),
    "cross_source_conflict": (cross_source_conflict, f"with {_QUOTES} select fare, spread from reasons where conflict"),
    "dedup_stats": (dedup_stats, f"with {_QUOTES} select count(*) as n_input, count(case when place = 1 then 1 end) as n_survivors, count(case when place > 1 then 1 end) as n_duplicates, count(case when place = 1 and members > 1 then 1 end) as n_groups, count(case when place = 1 and conflict then 1 end) as n_conflicts, count(case when dedup_reason = 'exact_duplicate' then 1 end) as n_exact from reasons"),
    "dup_link": (dup_link, f"with {_QUOTES} select fare, max(case when place = 1 then fare end) over (partition by fingerprint) as duplicate_of from reasons qualify place > 1"),
    "content_duplicates": (content_duplicates, "select sha256(trim(text)) as content, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1"),
}
