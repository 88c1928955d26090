"""Fare components against totals: what is missing is not zero, and one gap can be derived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def named(*pairs: tuple[Column, str]) -> Column:
    """The names, each once, whose tests hold; without a lambda, which would leave the tests to be interpreted."""
    return F.array_except(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]), F.array(F.lit(None).cast("string")))


COMPONENTS = ("base_fare", "udf", "psf", "asf", "gst", "other_charges")
ABS_TOLERANCE, REL_TOLERANCE = 0.05, 0.005


def component_audit(rows: DataFrame, components: tuple[str, ...] = COMPONENTS, total: str = "total", unparseable: str | None = None) -> DataFrame:
    """rows with derived (name and amount of the one component filled in), quality_grade, flags, taxes_fees and residual.

    unparseable: a column of type array<string> naming components whose text could not be read.
    """
    t = F.col(total)
    missing = named(*[(F.col(c).isNull(), c) for c in components])
    known = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0).cast("decimal(12,2)")) for c in components])
    gap = t - known
    derives = t.isNotNull() & (F.size(missing) == 1) & (gap >= 0)
    left = F.when(derives, F.array().cast("array<string>")).otherwise(missing)
    summed = F.when(derives, t).otherwise(known)
    base = F.coalesce(F.when(derives & (F.get(missing, F.lit(0)) == components[0]), gap).otherwise(F.col(components[0])), F.lit(0).cast("decimal(12,2)"))
    corrupt = F.arrays_overlap(left, F.coalesce(F.col(unparseable), F.array().cast("array<string>"))) if unparseable else F.lit(False)
    residual = t - summed
    close = F.abs(residual) <= F.greatest(F.lit(ABS_TOLERANCE).cast("decimal(12,2)"), F.abs(t) * F.lit(REL_TOLERANCE).cast("decimal(6,3)"))
    grade = F.when(t.isNull(), "D").when((F.size(left) > 0) & corrupt, "C").when(F.size(left) > 0, "B").when(close, "A").otherwise("C")
    zero = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 0, F.lit(False)) for c in components])
    partial, doubtful = t.isNotNull() & (F.size(left) > 0), F.coalesce(corrupt, F.lit(False))
    flags = named(
        (t.isNotNull() & zero, "EXPLICIT_ZERO"), (derives, "COMPONENT_DERIVED"), (partial & doubtful, "COMPONENT_UNPARSEABLE"), (partial & ~doubtful, "PARTIAL_BREAKDOWN"),
        (t.isNotNull() & (F.size(left) == 0) & ~close, "TOTAL_MISMATCH"),
    )
    whole = t.isNotNull() & (F.size(left) == 0)
    return rows.withColumns({"derived": F.when(derives, F.get(missing, F.lit(0))), "derived_amount": F.when(derives, gap), "n_missing": F.size(left), "quality_grade": grade, "flags": flags, "taxes_fees": F.when(whole, summed - base), "residual": F.when(whole, residual)})


def explicit_zeros(components: tuple[str, ...] = COMPONENTS) -> Column:
    return F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in components]), lambda x: x.isNotNull())


def four_component_audit(rows: DataFrame, components: tuple[str, ...], total: str) -> DataFrame:
    """The older audit: states for each component, one residual derivation, and a total derived from all components."""
    t = F.col(total)
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in components])
    known = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0).cast("decimal(12,2)")) for c in components])
    total_derived = t.isNull() & (nulls == 0) & (known > 0)
    full = F.when(total_derived, known).otherwise(t)
    gap = full - known
    derives = full.isNotNull() & (nulls == 1) & (gap >= 0)
    states = {f"{c}_state": F.when(F.col(c).isNull(), F.when(derives, "DERIVED").otherwise("MISSING")).when(F.col(c) == 0, "EXPLICIT_ZERO").when(F.col(c) < 0, "NEGATIVE").otherwise("OBSERVED") for c in components}
    complete = (nulls == 0) | derives
    close = F.abs(full - F.when(derives, full).otherwise(known)) <= F.greatest(F.lit(ABS_TOLERANCE).cast("decimal(12,2)"), F.abs(full) * F.lit(REL_TOLERANCE).cast("decimal(6,3)"))
    trusted = F.coalesce(complete & close, F.lit(False))
    return rows.withColumns({**states, "audited_total": full, "total_derived": total_derived, "breakdown_trusted": trusted, "index_eligible": F.coalesce(full > 0, F.lit(False)) & (trusted | (nulls > 0))})


#: What breakdown() can say of a row, in the order in which it lists them.
BREAKDOWN_FLAGS = ("all_in_price_only", "component_derived", "component_missing", "component_unparseable", "components_complete", "explicit_zero_present", "negative_value", "total_derived", "total_mismatch", "total_missing")


def breakdown(rows: DataFrame, components: tuple[str, ...], total: str, derive: bool = True) -> DataFrame:
    """rows with a state for each component and for the total, values as far as they follow, flags, and two verdicts.

    Each amount is a struct as parse_money makes it (value, status). A component is present, explicit_zero, missing or
    unparseable; the only unknown one becomes derived as what the total leaves, if that isn't negative. A total that is
    missing is derived from components that are all known. An unknown amount never counts as zero, and a row without a
    breakdown may still carry its total into the index.
    """
    def state(c: str) -> Column:
        status, value = F.col(c)["status"], F.col(c)["value"]
        return F.when(F.coalesce(status, F.lit("missing")) == "missing", "missing").when((status != "ok") | value.isNull(), "unparseable").when(value == 0, "explicit_zero").otherwise("present")

    none = F.lit(0).cast("decimal(12,2)")
    usable = lambda c: F.when(F.col(c)["status"] == "ok", F.col(c)["value"])
    count = lambda *kinds: reduce(lambda a, b: a + b, [F.col(f"{c}_state").isin(*kinds).cast("int") for c in components])
    out = rows.withColumns({f"{c}_state": state(c) for c in (*components, total)} | {f"{c}_value": usable(c) for c in (*components, total)})
    known, t = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{c}_value"), none) for c in components]), F.col(f"{total}_value")
    first = {"n_unknown": count("missing", "unparseable"), "n_missing": count("missing"), "n_unparseable": count("unparseable"), "n_zero": count("explicit_zero"), "known": known}
    out = out.withColumns(first | {"negative": reduce(lambda a, b: a | b, [F.coalesce(F.col(c)["status"] == "negative_rejected", F.lit(False)) for c in components])})
    out = out.withColumn("derives", F.coalesce((F.col("n_unknown") == 1) & (t >= F.col("known")), F.lit(False)) & F.lit(derive))
    out = out.withColumn("whole", (F.col("n_unknown") == 0) | F.col("derives"))
    filled = {f"{c}_value": F.when(F.col("derives") & F.col(f"{c}_value").isNull(), t - F.col("known")).otherwise(F.col(f"{c}_value")).cast("decimal(12,2)") for c in components}
    states = {f"{c}_state": F.when(F.col("derives") & F.col(f"{c}_value").isNull(), "derived").otherwise(F.col(f"{c}_state")) for c in components}
    derived_total = F.col("whole") & t.isNull()
    out = out.withColumns(filled | states | {"derived_total": derived_total, f"{total}_value": F.when(derived_total, F.col("known")).otherwise(t), f"{total}_state": F.when(derived_total, "derived").otherwise(F.col(f"{total}_state")), "component_sum": F.when(F.col("derives"), t).when(F.col("whole"), F.col("known"))})
    out = out.withColumn("residual", t - F.col("component_sum"))
    allowed = F.greatest(F.lit(ABS_TOLERANCE).cast("decimal(12,2)"), F.abs(t) * F.lit(REL_TOLERANCE).cast("decimal(6,3)"))
    out = out.withColumn("close", F.abs(F.col("residual")) <= allowed)
    said = {
        "all_in_price_only": ~F.col("whole") & (F.col("n_unknown") == len(components)) & t.isNotNull(), "component_derived": F.col("derives"), "component_missing": F.col("n_missing") > 0,
        "component_unparseable": F.col("n_unparseable") > 0, "components_complete": F.col("whole") & F.col("close"), "explicit_zero_present": F.col("n_zero") > 0, "negative_value": F.col("negative"),
        "total_derived": F.col("derived_total"), "total_mismatch": F.col("whole") & ~F.col("close"), "total_missing": t.isNull(),
    }
    flags = F.filter(F.array(*[F.when(said[f], f) for f in BREAKDOWN_FLAGS]), lambda x: x.isNotNull())
    trusted = F.col("whole") & F.col("close") & ~F.col("negative")
    eligible = F.coalesce(t > 0, F.lit(False)) & ~F.col("negative") & ~(F.col("whole") & ~F.col("close"))
    helpers = ("n_unknown", "n_missing", "n_unparseable", "n_zero", "known", "negative", "derives", "whole", "derived_total", "close")
    return out.withColumns({"flags": flags, "breakdown_trusted": F.coalesce(trusted, F.lit(False)), "index_eligible": eligible}).drop(*helpers)


def validate(origin: Column, destination: Column, money: list[Column], departure: Column, observed: Column, grace_hours: int = 3) -> Column:
    """Why a row is rejected, or null: the first reason in the order of the checks."""
    negative = reduce(lambda a, b: a | b, [F.coalesce(m < 0, F.lit(False)) for m in money])
    return (
        F.when(origin.isNull() | destination.isNull(), "observation has no route").when(origin == destination, "circular route")
        .when(negative, "negative amount").when(departure < observed - F.expr(f"interval {grace_hours} hours"), "departure precedes observation")
    )


def completeness(components: tuple[str, ...], grade: Column, flight: Column, total: Column) -> Column:
    """Two points a known component, three for a full breakdown, two each for a flight number and a total."""
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in components])
    return 2 * known + F.when(grade == "A", 3).otherwise(0) + F.when(F.coalesce(flight, F.lit("")) != "", 2).otherwise(0) + F.when(total.isNotNull(), 2).otherwise(0)
