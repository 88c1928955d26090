"""The supplied tables in the roles of the price statistics: which column stands for which concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = (1, 7, 15, 30, 45)
BASE_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fares(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """route, item, lead_window, total, observed_on, year, quantity and the keys of each line, of one year where it is given."""
    line = table(spark, sf_dir, "lineitem")
    line, part = line if year is None else line.where(years(year)), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_brand").alias("route"), F.col("l_partkey").alias("item"),
        F.element_at(F.array(*map(F.lit, WINDOWS)), F.pmod("l_linenumber", F.lit(5)) + 1).alias("lead_window"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total"), F.to_date("l_shipdate").alias("observed_on"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


FARES_SQL = """fares as (select p.p_brand as route, l.l_partkey as item, list_extract([1, 7, 15, 30, 45], (l.l_linenumber % 5) + 1) as lead_window,
  cast(l.l_extendedprice as decimal(12,2)) as total, cast(l.l_shipdate as date) as observed_on, year(l.l_shipdate) as year, l.l_quantity as quantity,
  l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus
  from lineitem l join part p on l.l_partkey = p.p_partkey)"""


def years(first: int, last: int | None = None, day: str = "l_shipdate") -> Column:
    """Days of first to last (first alone without it), as a range that reaches the scan."""
    start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (first, (last or first) + 1))
    return (F.col(day) >= start) & (F.col(day) < end)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passengers of the base year by route."""
    return fares(spark, sf_dir, BASE_YEAR).groupBy("route").agg(F.sum("quantity").alias("passengers"))


def weight_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half-open version of each route's weight a year; the last is open."""
    yearly = fares(spark, sf_dir).groupBy("route", "year").agg(F.sum("quantity").alias("passengers"))
    last = yearly.agg(F.max("year").alias("last"))
    valid = yearly.join(F.broadcast(last))
    return valid.select("route", "passengers", F.make_date("year", F.lit(1), F.lit(1)).alias("valid_from"), F.when(F.col("year") < F.col("last"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))).alias("valid_to"))


def feed_sql(profile: str, day: str = "2024-03-05", base: float = 4000.0) -> str:
    """The synthetic feed of tasks (route, lead_window) on one day in SQL, as priced: key, day, carrier, flight, fare, gone."""
    from plinth.sources.synthetic import PROFILES, SOLD_OUT, WEEKDAYS

    carriers, anchors = PROFILES[profile]
    lines = " ".join(f"when d <= {x1} then {y0}e0 + (d - {x0}) * {(y1 - y0) / (x1 - x0)!r}::double" for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]))
    listed = ", ".join(f"('{c}', {f}e0)" for c, f in carriers)
    weekdays = "[" + ", ".join(f"{w}e0" for w in WEEKDAYS) + "]"
    return f"""keyed as (select t.*, date '{day}' as day, c.carrier, c.level, n.n, greatest(least(t.lead_window, {anchors[-1][0]}), {anchors[0][0]}) as d, concat_ws('|', t.route, t.lead_window, '{day}', c.carrier, n.n) as key
  from tasks t cross join (values {listed}) c(carrier, level) cross join (values (1), (2), (3)) n(n)),
priced as (select *, carrier || lpad(cast(n * 100 + 11 as varchar), 4, '0') as flight, {uniform_sql('sold')} < case when lead_window <= 3 then {4 * SOLD_OUT}e0 else {SOLD_OUT}e0 end as gone,
  round({base}e0 * level * round(case {lines} end, 4) * {weekdays}[isodow(day)] * (0.92e0 + 0.16e0 * {uniform_sql('jitter')}), 2)::decimal(12,2) as fare from keyed)"""


def uniform_sql(salt: str) -> str:
    return f"(cast('0x' || substr(sha256(key || '{salt}'), 1, 13) as bigint) / 4503599627370496e0)"
