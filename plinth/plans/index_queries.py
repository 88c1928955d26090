"""Queries of the price index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.rounding import half_even
from plinth.operators import exact, index
from plinth.plans.standin import BASE_YEAR, FARES_SQL, fares, weight_versions, weights

CELL = ["route", "lead_window"]
ITEM = [*CELL, "item"]
TRIM, MIN_PAIRS = 0.02, 5


def _prices(spark, d):
    return index.item_prices(fares(spark, d), [*ITEM, "year"])


def _base(spark, d):
    return index.item_prices(fares(spark, d, BASE_YEAR), ITEM)


def _pairs(spark, d):
    """Every later year against the base year; the base is a part of the same aggregate of prices."""
    prices = _prices(spark, d)
    return index.matched_pairs(prices.where(F.col("year") > BASE_YEAR), prices.where(F.col("year") == BASE_YEAR), ITEM)


def _elementary(spark, d, fraction=TRIM, least=MIN_PAIRS):
    return index.jevons(_pairs(spark, d), [*CELL, "year"], "item", fraction, least)


def _shares(spark, d):
    return index.shares(weights(spark, d), [])


def _contributions(spark, d):
    return index.laspeyres(_elementary(spark, d), _shares(spark, d), ["lead_window", "year"], "route")


def _national(spark, d):
    return index.headline(_contributions(spark, d), ["lead_window", "year"])


def _rounded(df, *cols, places=6):
    """Half-even to fewer places than computed: sums of doubles differ in the last ones between engines."""
    return df.withColumns({c: half_even(F.col(c), places) for c in cols})


def geomean_item_price(spark, d):
    return _prices(spark, d)


def base_period_price(spark, d):
    return _base(spark, d)


def matched_pairs(spark, d):
    return _pairs(spark, d)


def jevons_untrimmed(spark, d):
    return _rounded(_elementary(spark, d, 0.0, 1), "level", "mean_log").select(*CELL, "year", "level", "mean_log", "n_pairs")


def jevons_trimmed(spark, d):
    return _rounded(_elementary(spark, d), "level", "mean_log").select(*CELL, "year", "level", "n_pairs", "n_trimmed")


def min_pairs_suppression(spark, d):
    return _elementary(spark, d, TRIM, 20).select(*CELL, "year", "n_pairs", "is_computable")


def laspeyres_national(spark, d):
    return _rounded(_national(spark, d), "level", "coverage")


def laspeyres_contributions(spark, d):
    return _rounded(_contributions(spark, d), "level", "share", "effective_weight", "contribution").select("lead_window", "year", "route", "level", "share", "effective_weight", "contribution", "exclusion")


def laspeyres_direct(spark, d):
    prices = _prices(spark, d)
    quantities = fares(spark, d, BASE_YEAR).groupBy(*ITEM).agg(F.sum("quantity").alias("quantity"))
    out = index.laspeyres_direct(prices.where(F.col("year") == BASE_YEAR), prices.where(F.col("year") > BASE_YEAR), quantities, ITEM, ["lead_window", "year"])
    return _rounded(out, "level")


def weight_renormalise(spark, d):
    return _rounded(_shares(spark, d), "share", places=8)


def weight_effective_on(spark, d):
    days = spark.createDataFrame([("1995-06-30",), ("1998-01-01",), ("2001-12-31",)], "day string").select(F.to_date("day").alias("day"))
    return index.weights_in_force(weight_versions(spark, d), days).select("day", "route", "passengers")


def weight_overlap_check(spark, d):
    """Versions of a table in which the third year of each route has been moved to begin half a year early."""
    moved = weight_versions(spark, d).withColumn("valid_from", F.when(F.year("valid_from") == 1997, F.add_months("valid_from", -6)).otherwise(F.col("valid_from")))
    return index.overlapping_weights(moved, ["route"]).select("route", "valid_from", "valid_to")


def weight_overlap_nested(spark, d):
    """Versions of a table in which each route's first version goes on for five years, over those inside of it."""
    first = F.year("valid_from") == BASE_YEAR
    longer = weight_versions(spark, d).withColumn("valid_to", F.when(first, F.add_months("valid_from", 60)).otherwise(F.col("valid_to")))
    return index.overlapping_weights(longer, ["route"]).select("route", "valid_from", "valid_to")


def chain_link_series(spark, d):
    yearly = fares(spark, d).groupBy("route", "year").agg(index.geomean(F.col("total")).alias("mean"))
    before = F.lag("mean").over(index.Window.partitionBy("route").orderBy("year"))
    links = yearly.withColumn("relative", F.coalesce(F.col("mean") / before, F.lit(1.0)))
    return _rounded(index.chained(links, ["route"], "year"), "level").select("route", "year", "level")


def _daily(spark, d):
    return fares(spark, d).groupBy("route", "observed_on").agg(half_even(index.geomean(F.col("total")), 2).alias("price"))


def growth_rates(spark, d):
    return index.growth(_daily(spark, d), ["route"], "observed_on", "price", {"day_on_day": 1, "year_on_year": 365}).select("route", "observed_on", "day_on_day", "year_on_year")


def publishability(spark, d):
    ok, reason = index.publishable(F.col("level"), F.col("coverage"), 0.8)
    few = _elementary(spark, d, TRIM, 20)
    national = index.headline(index.laspeyres(few, _shares(spark, d), ["lead_window", "year"], "route"), ["lead_window", "year"])
    return national.select("lead_window", "year", ok.alias("is_published"), F.when(F.col("level").isNull(), "no level").when(~ok, "coverage").alias("why"), "n_included", "n_excluded")


def elementary_and_national(spark, d):
    routes = _rounded(_elementary(spark, d), "level").where("is_computable").select("route", "lead_window", "year", "level")
    national = _rounded(_national(spark, d), "level").select(F.lit(None).cast("string").alias("route"), "lead_window", "year", "level")
    return routes.unionByName(national)


def jevons_exact(spark, d):
    """The 34-digit tier; to six places, as its SQL is in doubles."""
    out = exact.jevons_exact(_pairs(spark, d), [*CELL, "year"])
    return out.select(*CELL, "year", half_even(F.col("level"), 6).cast("double").alias("level"), "n_pairs")


def _exact(spark, d):
    return exact.jevons_exact(index.trimmed(_pairs(spark, d), [*CELL, "year"], "item", TRIM, MIN_PAIRS), [*CELL, "year"], min_pairs=MIN_PAIRS)


def jevons_exact_trimmed(spark, d):
    return _exact(spark, d).select(*CELL, "year", half_even(F.col("level"), 6).cast("double").alias("level"), "n_pairs")


def laspeyres_exact(spark, d):
    """The national index from the exact tier all the way; to six places, as its SQL is in doubles."""
    out = exact.laspeyres_exact(_exact(spark, d), _shares(spark, d), ["lead_window", "year"], "route")
    return out.select("lead_window", "year", half_even(F.col("level"), 6).cast("double").alias("level"), half_even(F.col("coverage"), 6).cast("double").alias("coverage"), "n_included")


_PRICES = f"""{FARES_SQL},
prices as (select route, lead_window, item, year, round_even(exp(avg(ln(cast(total as double)))), 2) as price, count(*) as n_observations from fares where total > 0 group by all)"""
_PAIRS = f"""{_PRICES},
pairs as (select c.route, c.lead_window, c.item, c.year, c.price as current_price, b.price as base_price from prices c join prices b
  on c.route = b.route and c.lead_window = b.lead_window and c.item = b.item and b.year = {BASE_YEAR} and b.price > 0 where c.year > {BASE_YEAR})"""


def _elem(fraction, least):
    return f"""{_PAIRS},
logs as (select *, ln(current_price / base_price) as lr from pairs where current_price > 0),
ranked as (select *, count(*) over (partition by route, lead_window, year) as n, row_number() over (partition by route, lead_window, year order by lr, item) as place from logs),
cuts as (select *, case when n < {least} or n - 2 * floor(n * {fraction}) < 1 then 0 else floor(n * {fraction}) end as cut from ranked),
elementary as (select route, lead_window, year, case when count(*) >= {least} then round_even(100 * exp(avg(lr)), 8) end as level, round_even(avg(lr), 12) as mean_log,
  count(*) as n_pairs, cast(2 * max(cut) as bigint) as n_trimmed, count(*) >= {least} as is_computable from cuts where place > cut and place <= n - cut group by route, lead_window, year)"""


_WEIGHTS = f"""weights as (select route, sum(quantity) as passengers from fares where year = {BASE_YEAR} group by route),
shares as (select route, passengers, round_even(case when sum(passengers) over () > 0 then passengers / sum(passengers) over () else 1.0 / count(*) over () end, 10) as share from weights)"""


def _contrib(least=MIN_PAIRS):
    return f"""{_elem(TRIM, least)},
{_WEIGHTS},
grid as (select g.lead_window, g.year, s.route, s.share from (select distinct lead_window, year from elementary) g cross join shares s),
joined as (select g.*, e.level, e.n_pairs, e.is_computable, coalesce(e.is_computable, false) as included from grid g left join elementary e on e.lead_window = g.lead_window and e.year = g.year and e.route = g.route),
contributions as (select *, case when included then round_even(share / sum(case when included then share end) over (partition by lead_window, year), 10) end as effective_weight from joined),
national as (select lead_window, year, round_even(sum(effective_weight * level), 8) as level, round_even(coalesce(sum(case when included then share end), 0), 10) as coverage,
  count(case when included then 1 end) as n_included, count(case when not included then 1 end) as n_excluded, cast(sum(n_pairs) as bigint) as n_pairs from contributions group by lead_window, year)"""


_VERSIONS = f"""{FARES_SQL},
yearly as (select route, year, sum(quantity) as passengers from fares group by route, year),
versions as (select route, passengers, make_date(year, 1, 1) as valid_from, case when year < (select max(year) from yearly) then make_date(year + 1, 1, 1) end as valid_to from yearly)"""

QUERIES = {
    "geomean_item_price": (geomean_item_price, f"with {_PRICES} select * from prices"),
    "base_period_price": (base_period_price, f"with {_PRICES} select route, lead_window, item, price, n_observations from prices where year = {BASE_YEAR}"),
    "matched_pairs": (matched_pairs, f"with {_PRICES}, both_ as (select *, max(case when year = {BASE_YEAR} and price > 0 then price end) over (partition by route, lead_window, item) as base_price from prices) select route, lead_window, item, year, price as current_price, base_price from both_ where year > {BASE_YEAR} and base_price is not null"),
    "jevons_untrimmed": (jevons_untrimmed, f"with {_elem(0.0, 1)} select route, lead_window, year, round_even(level, 6) as level, round_even(mean_log, 6) as mean_log, n_pairs from elementary"),
    "jevons_exact": (jevons_exact, f"with {_elem(0.0, 1)} select route, lead_window, year, round_even(level, 6) as level, n_pairs from elementary"),
    "jevons_exact_trimmed": (jevons_exact_trimmed, f"with {_elem(TRIM, MIN_PAIRS)} select route, lead_window, year, round_even(level, 6) as level, n_pairs from elementary"),
    "laspeyres_exact": (laspeyres_exact, f"with {_contrib()} select lead_window, year, round_even(level, 6) as level, round_even(coverage, 6) as coverage, n_included from national"),
    "jevons_trimmed": (jevons_trimmed, f"with {_elem(TRIM, MIN_PAIRS)} select route, lead_window, year, round_even(level, 6) as level, n_pairs, n_trimmed from elementary"),
    "min_pairs_suppression": (min_pairs_suppression, f"with {_elem(TRIM, 20)} select route, lead_window, year, n_pairs, is_computable from elementary"),
    "laspeyres_national": (laspeyres_national, f"with {_contrib()} select lead_window, year, round_even(level, 6) as level, round_even(coverage, 6) as coverage, n_included, n_excluded, n_pairs from national"),
    "laspeyres_contributions": (laspeyres_contributions, f"with {_contrib()} select lead_window, year, route, round_even(level, 6) as level, round_even(share, 6) as share, round_even(effective_weight, 6) as effective_weight, round_even(round_even(effective_weight * level, 8), 6) as contribution, case when is_computable is null then 'no elementary index' when not included then 'too few pairs' end as exclusion from contributions"),
    "laspeyres_direct": (laspeyres_direct, f"with {_PAIRS}, q as (select route, lead_window, item, sum(quantity) as quantity from fares where year = {BASE_YEAR} group by all) select p.lead_window, p.year, round_even(round_even(case when sum(base_price * quantity) > 0 then 100 * sum(current_price * quantity) / sum(base_price * quantity) end, 8), 6) as level, count(*) as n_items from pairs p join q on q.route = p.route and q.lead_window = p.lead_window and q.item = p.item group by p.lead_window, p.year"),
    "weight_renormalise": (weight_renormalise, f"with {FARES_SQL}, {_WEIGHTS} select route, passengers, round_even(share, 8) as share from shares"),
    "weight_effective_on": (weight_effective_on, f"with {_VERSIONS} select d.day, v.route, v.passengers from (values (date '1995-06-30'), (date '1998-01-01'), (date '2001-12-31')) d(day) join versions v on v.valid_from <= d.day and (v.valid_to is null or v.valid_to > d.day)"),
    "weight_overlap_check": (weight_overlap_check, f"with {_VERSIONS}, moved as (select route, case when year(valid_from) = 1997 then date '1996-07-01' else valid_from end as valid_from, valid_to from versions), o as (select *, row_number() over (partition by route order by valid_from, valid_to nulls last) as rn from moved) select route, valid_from, valid_to from o where exists (select 1 from o e where e.route = o.route and e.rn < o.rn and (e.valid_to is null or e.valid_to > o.valid_from))"),
    "weight_overlap_nested": (weight_overlap_nested, f"with {_VERSIONS}, moved as (select route, valid_from, case when year(valid_from) = {BASE_YEAR} then cast(valid_from + interval '5 years' as date) else valid_to end as valid_to from versions), o as (select *, row_number() over (partition by route order by valid_from, valid_to nulls last) as rn from moved) select route, valid_from, valid_to from o where exists (select 1 from o e where e.route = o.route and e.rn < o.rn and (e.valid_to is null or e.valid_to > o.valid_from))"),
    "chain_link_series": (chain_link_series, f"with {FARES_SQL}, y as (select route, year, exp(avg(ln(cast(total as double)))) as mean from fares where total > 0 group by route, year), l as (select route, year, coalesce(mean / lag(mean) over (partition by route order by year), 1.0) as relative from y) select route, year, round_even(round_even(100 * exp(sum(ln(relative)) over (partition by route order by year)), 8), 6) as level from l"),
    "growth_rates": (growth_rates, f"with {FARES_SQL}, p as (select route, observed_on, round_even(exp(avg(ln(cast(total as double)))), 2) as price from fares where total > 0 group by route, observed_on), b as (select *, max(price) over (partition by route order by observed_on range between interval 1 day preceding and interval 1 day preceding) as d1, max(price) over (partition by route order by observed_on range between interval 365 days preceding and interval 365 days preceding) as d365 from p) select route, observed_on, round_even(case when d1 > 0 then (price / d1 - 1) * 100 end, 6) as day_on_day, round_even(case when d365 > 0 then (price / d365 - 1) * 100 end, 6) as year_on_year from b"),
    "publishability": (publishability, f"with {_contrib(20)} select lead_window, year, level is not null and level > 0 and coverage >= 0.8 as is_published, case when level is null then 'no level' when level <= 0 or coverage < 0.8 then 'coverage' end as why, n_included, n_excluded from national"),
    "elementary_and_national": (elementary_and_national, f"with {_contrib()} select route, lead_window, year, round_even(level, 6) as level from elementary where is_computable union all select null, lead_window, year, round_even(level, 6) from national"),
}
