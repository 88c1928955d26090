"""Queries of maintained reports and of what roles may read in SQL, with the SQL that they are held against."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from plinth.functions.money import parse_money
from plinth.functions.rounding import half_even
from plinth.functions.text_forms import bounded_batches, nfkc
from plinth.lineage import shared_folder
from plinth.operators import governed, serving, weightsets
from plinth.operators.gold import Gold
from plinth.plans.index_queries import _contrib, _national
from plinth.plans.serving_queries import _ROWS, _fares
from plinth.plans.serving_queries import QUERIES as SERVING
from plinth.plans.standin import FARES_SQL, fares, table


def _gold(spark, d):
    """Partials of all fares as they come about: two appends, one of them handed over twice, and a year that was wrong and is restated."""
    rows = _fares(spark, d).select("observed_on", "lead_window", "priced", "is_sold_out", "l_orderkey", "year")
    gold = Gold(f"{shared_folder(spark)}/gold-{uuid.uuid4().hex}", rows.schema, "observed_on", ("lead_window",), "priced", ("is_sold_out",))
    wrong = F.when(F.col("year") == 1996, F.col("priced") * 2).otherwise(F.col("priced"))
    odd = F.col("l_orderkey") % 2 == 1
    gold.append(rows.where(odd).withColumn("priced", wrong), "odd")
    gold.append(rows.where(~odd | odd.isNull()), "even")
    gold.append(rows.where(odd), "odd")
    gold.restate(rows.where("year = 1996"))
    return gold


def gold_lead_time_curve(spark, d):
    gold = _gold(spark, d)
    return gold.curve(gold.partials(spark), "lead_window", "is_sold_out")


def gold_summary(spark, d):
    gold = _gold(spark, d)
    return gold.summary(gold.partials(spark)).drop("n_is_sold_out")


def governed_series(spark, d):
    """What an analyst reads of the series through SQL alone, with a condition that fails on any row that is not published."""
    rows = fares(spark, d).groupBy("route", "year").agg(F.count("*").alias("n"))
    governed.publish(rows.withColumn("is_published", F.col("year") != 1998), "fare_series", open=["route"])
    return spark.sql("select route, year, n from fare_series('analyst') where if(year = 1998, raise_error('not for analysts'), true)")


#: Digits of other forms, in their order: wide, bold, double-struck, sans, monospace, raised, lowered.
DIGITS = ("０１２３４５６７８９", "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗", "𝟘𝟙𝟚𝟛𝟜𝟝𝟞𝟟𝟠𝟡", "𝟢𝟣𝟤𝟥𝟦𝟧𝟨𝟩𝟪𝟫", "𝟶𝟷𝟸𝟹𝟺𝟻𝟼𝟽𝟾𝟿", "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉")


def folded_amounts(spark, d):
    """Every order's total in one of eight kinds of digits, with wide marks and signs, and what is read of it."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("plain"))
    kind = F.pmod("o_orderkey", F.lit(len(DIGITS) + 1)).cast("int")
    texts = [F.translate("plain", "0123456789", x) for x in DIGITS]
    text = F.when(kind == 0, F.concat(F.lit("＄　"), "plain")).otherwise(F.get(F.array(*texts), kind - 1))
    wide = F.when(kind % 2 == 1, F.translate(text, ".", "．")).otherwise(text)
    m = orders.select("o_orderkey", parse_money(nfkc(wide)).alias("m"))
    return m.select("o_orderkey", F.col("m.value").cast("string").alias("value"), "m.status", "m.currency")


#: Letters as some tools write them, apart or joined, and the letters that they stand for.
LETTERS = (("é", "e\u0301"), ("ó", "o\u0301"), ("ñ", "n\u0303"), ("ç", "c\u0327"), ("ü", "u\u0308"), ("fi", "\ufb01"), ("fl", "\ufb02"), ("A", "\uff21"))


def folded_documents(spark, d):
    """Every document with letters taken apart and ligatures and wide letters put in, and what it is after folding."""
    text = F.col("text")
    for letter, other in LETTERS:
        text = F.replace(text, F.lit(letter), F.lit(other))
    folded = nfkc(text)
    return table(bounded_batches(spark), d, "documents").select("doc_id", F.length(folded).cast("long").alias("n_chars"), F.sha2(folded, 256).alias("sha256"))


def _yearly(spark, d):
    return fares(spark, d).groupBy("route", "year").agg(F.sum("quantity").alias("passengers"))


def weight_set_facts(spark, d):
    """Each year's set as published at its end, by the day of the newest fare; 1997's lists the routes that end in 3 twice."""
    w = _yearly(spark, d)
    w = w.unionAll(w.where((F.col("year") == 1997) & F.col("route").endswith("3"))).withColumn("published_on", F.make_date("year", F.lit(12), F.lit(31)))
    newest = fares(spark, d).agg(F.max("observed_on")).scalar()
    out = weightsets.facts(w, ["year"], "route", "passengers", "published_on", newest)
    return out.select("year", "n_units", F.col("total").cast("double").alias("total"), half_even(F.col("largest_share").cast("double"), 8).alias("largest_share"), "staleness_days", "error")


def seeded_weights(spark, d):
    """Two years' sets, seeded one after the other; the first year's had been seeded with other numbers before, and is seeded twice."""
    w, path = _yearly(spark, d), f"{shared_folder(spark)}/weights-{uuid.uuid4().hex}"
    of = lambda y: w.where(F.col("year") == y).select("route", "passengers")
    weightsets.seed(of(1995).withColumn("passengers", F.col("passengers") + 1000), path, "route", "passengers", date(1996, 1, 1), "1995")
    for year in (1995, 1996, 1995):
        weightsets.seed(of(year), path, "route", "passengers", date(year + 1, 1, 1), str(year))
    return spark.read.parquet(path).select("route", "reference_period", F.year("valid_from").alias("since"), F.col("passengers").cast("double").alias("passengers"), half_even(F.col("share").cast("double"), 8).alias("share"))


def index_summaries(spark, d):
    out = weightsets.summary(_national(spark, d), ["lead_window", "year"], 0.8, methodology_version="M1")
    return out.withColumns({"level": half_even(F.col("level").cast("double"), 6), "weight_coverage": half_even(F.col("weight_coverage").cast("double"), 6)}).drop("suppression_reason")


def lead_time_curve_with_level(spark, d):
    """The curve of each window beside the newest level of its national index."""
    newest = serving.latest(_national(spark, d).select("lead_window", "year", half_even(F.col("level"), 6).alias("level")), ["lead_window"], ["year"])
    return serving.lead_time_curve(_fares(spark, d), "lead_window", "priced").select("lead_window", "n", "p50").join(newest, "lead_window", "left")


QUERIES = {
    "gold_lead_time_curve": (gold_lead_time_curve, SERVING["lead_time_curve"][1]),
    "gold_summary": (gold_summary, SERVING["fares_summary"][1]),
    "folded_amounts": (folded_amounts, "select o_orderkey, cast(cast(o_totalprice as decimal(12,2)) as varchar) as value, 'ok' as status, case when o_orderkey % 8 = 0 then 'USD' end as currency from orders"),
    "folded_documents": (folded_documents, "select doc_id, length(nfc_normalize(text)) as n_chars, sha256(nfc_normalize(text)) as sha256 from documents"),
    "weight_set_facts": (weight_set_facts, f"""with {FARES_SQL}, w as (select route, year, sum(quantity) as q from fares group by all), u as (select * from w union all select * from w where year = 1997 and route like '%3'),
t as (select year, count(*) as n_units, count(*) > count(distinct route) as twice, sum(q) as total from u group by year), m as (select year, max(q) as most from w group by year)
select t.year, t.n_units, cast(t.total as double) as total, case when not twice then round_even(most / total, 8) end as largest_share, date_diff('day', make_date(t.year, 12, 31), (select max(observed_on) from fares)) as staleness_days, case when twice then 'duplicate unit' end as error from t join m on m.year = t.year"""),
    "seeded_weights": (seeded_weights, f"with {FARES_SQL}, w as (select route, year, sum(quantity) as q from fares where year in (1995, 1996) group by all) select route, cast(year as varchar) as reference_period, year + 1 as since, cast(q as double) as passengers, round_even(q / sum(q) over (partition by year), 8) as share from w"),
    "index_summaries": (index_summaries, f"with {_contrib()} select lead_window, year, round_even(level, 6) as level, round_even(coverage, 6) as weight_coverage, n_included as strata_included, n_included + n_excluded as strata_total, coalesce(n_pairs, 0) as pairs_used, coalesce(level > 0, false) and coverage >= 0.8 as publishable, 'M1' as methodology_version from national"),
    "lead_time_curve_with_level": (lead_time_curve_with_level, f"with {_contrib()}{_ROWS.removeprefix(FARES_SQL)}, c as (select lead_window, count(priced) as n, round_even(quantile_cont(cast(priced as double), 0.5), 4) as p50 from rows group by lead_window), z as (select lead_window, year, round_even(level, 6) as level from national qualify row_number() over (partition by lead_window order by year desc) = 1) select c.lead_window, c.n, c.p50, z.year, z.level from c left join z on z.lead_window = c.lead_window"),
    "governed_series": (governed_series, SERVING["visible_series"][1]),
}
