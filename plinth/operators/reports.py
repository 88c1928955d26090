"""Reports over marked rows: groups of duplicates, rejections, runs, pages with counts, versions in force, digests of what was used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.intervals import contained

from plinth.operators.provenance import canonical_json

REPORTED = 200


def duplicate_groups(rows: DataFrame, fingerprint: str, content: str, source: str, price: str, spread: float) -> DataFrame:
    """Each group of more than one member: members, distinct contents, its sources in order, lowest and highest price, conflict."""
    low, high = F.col("lowest"), F.col("highest")
    out = rows.groupBy(fingerprint).agg(F.count("*").alias("members"), F.count_distinct(content).alias("contents"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.min(price).alias("lowest"), F.max(price).alias("highest"))
    return out.where("members > 1").withColumn("conflict", (F.col("contents") > 1) & (low > 0) & ((high - low) > low * F.lit(spread).cast("decimal(4,2)")))


def rejections(rows: DataFrame, reason: str, key: str, most: int = REPORTED) -> DataFrame:
    """reason, its count, and the first keys of all rejected rows as far as the report shows them (most in all).

    Everything is counted; only the listing ends, as the report does. The listing is a top-k, not a sort of all.
    """
    out = rows.where(F.col(reason).isNotNull()).select(F.col(reason).alias("reason"), F.col(key).alias("_key"))
    shown = out.orderBy("_key").limit(most).groupBy("reason").agg(F.count("*").alias("n_shown"), F.min("_key").alias("first_shown"))
    return out.groupBy("reason").agg(F.count("*").alias("n")).join(shown, "reason", "left").select("reason", "n", F.coalesce("n_shown", F.lit(0)).alias("n_shown"), "first_shown")


#: The counters of a cleaning run, in the order of its stages.
COUNTERS = ("extracted", "currency_failures", "canonicalisation_failures", "structural_rejects", "partial_breakdown", "total_mismatch", "sold_out", "price_unavailable", "duplicates", "cross_source_conflicts", "outliers", "written")


def run_counters(rows: DataFrame, by: list[str], marks: dict[str, Column]) -> DataFrame:
    """The counters of each run in one aggregate; marks says by counter which rows it counts. Unknown names raise ValueError.

    Without a mark of their own, every row is extracted, and those that no failure or reject marks are written.
    """
    if unknown := set(marks) - set(COUNTERS):
        raise ValueError(f"no such counter: {sorted(unknown)}")
    lost = F.lit(False)
    for name in COUNTERS[1:4]:
        lost = lost | F.coalesce(marks.get(name, F.lit(False)), F.lit(False))
    marks = {"extracted": F.lit(True), "written": ~lost} | marks
    return rows.groupBy(*by).agg(*[F.count_if(marks.get(name, F.lit(False))).alias(name) for name in COUNTERS])


def counted_page(rows: DataFrame, order: list[Column], number: int, size: int, key: str) -> DataFrame:
    """A numbered page with the count of all rows, the pages there are, and this page's number."""
    from plinth.operators.serving import numbered_page

    total = rows.agg(F.count("*").alias("count")).withColumns({"pages": F.greatest(F.ceil(F.col("count") / size), F.lit(1)), "page": F.lit(number)})
    return numbered_page(rows.select(key, *[c for c in rows.columns if c != key]), order, number, size).crossJoin(F.broadcast(total))


def in_force(versions: DataFrame, days: DataFrame, day: str = "day", since: str = "effective_from", version: str = "version") -> DataFrame:
    """For each day the newest version with since <= day, ties to the highest version; days before any have nulls.

    A version ends where the next one begins, so each day is in one interval at most. Versions (a row each) are put in order in one task.
    """
    rest = [c for c in versions.columns if c not in days.columns]
    newest = versions.where(F.col(since).isNotNull()).groupBy(F.col(since).alias("_since")).agg(F.max_by(F.struct(*rest), version).alias("_v"))
    spans = newest.withColumn("_until", F.lead("_since").over(Window.orderBy("_since")))
    return contained(days, day, spans, "_since", "_until", "left").select(*days.columns, *[F.col(f"_v.{c}").alias(c) for c in rest])


def strict_shares(weights: DataFrame, unit: str, quantity: str, places: int = 8) -> DataFrame:
    """Shares of one weight set, with why it can't be used: a unit that is listed twice, or a total that is not positive."""
    totals = weights.agg(F.sum(quantity).alias("_total"), (F.count(unit) != F.count_distinct(unit)).alias("_twice"))
    error = F.when(F.col("_twice"), "duplicate unit").when(F.coalesce(F.col("_total") <= 0, F.lit(True)), "zero total")
    both = weights.crossJoin(F.broadcast(totals)).withColumn("error", error)
    return both.withColumn("share", F.when(F.col("error").isNull(), F.bround(F.col(quantity) / F.col("_total"), places))).drop("_total", "_twice")


def set_digest(rows: DataFrame, by: list[str], key: str, fields: dict[str, Column]) -> DataFrame:
    """by, n and the SHA-256 over the canonical texts of a set's rows, in the order of their key and then their text.

    Meant for sets that are listed in a publication (a weight set, the pairs of one stratum): one array holds a set.
    """
    line = F.struct(F.col(key).cast("string").alias("k"), canonical_json(fields).alias("j"))
    made = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("_lines"))
    return made.select(*by, "n", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("_lines", lambda x: x["j"]), ","), F.lit("]")), 256).alias("digest"))


def scopes(routes: DataFrame, windows: DataFrame, route: str = "route") -> DataFrame:
    """What is verified each night: the national series of every window, and every route in every window."""
    national = windows.select(F.lit("NATIONAL").alias("scope"), *windows.columns)
    return national.unionByName(routes.select(F.col(route).alias("scope")).crossJoin(F.broadcast(windows)))


def truncated(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each task, as many as its source may return: the feature of a result limit."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def swept(states: DataFrame, now: Column, cooldown: float, state: str = "state", opened: str = "opened") -> DataFrame:
    """Breakers after a sweep: open ones whose cooldown has passed are half open; those tripped for good stay as they are."""
    due = (F.col(state) == "OPEN") & (now >= F.col(opened) + cooldown)
    return states.withColumns({"swept": F.when(due, "HALF_OPEN").otherwise(F.col(state)), "is_halted": F.col(state) == "TRIPPED_PERMANENT"})


def restated(days: DataFrame, prints: DataFrame, by: list[str], day: str, known: str, value: str, lag: int) -> DataFrame:
    """Each day's value as it was known lag days after it: the newest print of the day that had been made by then."""
    joined = prints.where(F.col(known) <= F.date_add(F.col(day), lag)).groupBy(*by, day).agg(F.max_by(value, known).alias(value), F.max(known).alias(known))
    return days.join(joined, [*by, day], "left")


def task_refused(cabin: Column, cabins: tuple[str, ...], lead: Column, horizon: tuple[int, int]) -> Column:
    """Why a source can't take a task, or null: a cabin that it doesn't sell, or a day beyond its horizon."""
    return F.when(~F.coalesce(cabin.isin(*cabins), F.lit(False)), "unsupported cabin").when(~F.coalesce(lead.between(*horizon), F.lit(False)), "beyond horizon")


def collected(rows: DataFrame, by: list[str], task: list[str], seconds: str, most: int) -> DataFrame:
    """By source: tasks, quotes, those kept under the limit of a task's results, tasks that were cut, and mean and longest latency."""
    tasks = rows.groupBy(*by, *task).agg(F.count("*").alias("_n"), F.max(seconds).alias("_s"))
    return tasks.groupBy(*by).agg(F.count("*").alias("tasks"), F.sum("_n").alias("quotes"), F.sum(F.least("_n", F.lit(most))).alias("kept"), F.count_if(F.col("_n") > most).alias("truncated"), F.avg("_s").alias("mean_seconds"), F.max("_s").alias("most_seconds"))


def granted(roles: Column, needed: Column, all_of: bool = False) -> Column:
    """Whether roles has one (or each) of those needed."""
    return F.size(F.array_except(needed, roles)) == 0 if all_of else F.size(F.array_intersect(roles, needed)) > 0
