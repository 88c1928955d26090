"""Named filters of the readable tables: what a user may ask for, and the predicate that it stands for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.serving import TESTS, eligible

#: Names of filters with their column and test: fixed values.
FARES = {
    "route": ("route", "iexact"), "route_in": ("route", "in"), "source": ("source", "iexact"), "carrier": ("carrier", "iexact"),
    "lead_window": ("lead_window", "exact"), "lead_window_in": ("lead_window", "in"), "cabin": ("cabin", "exact"),
    "quality": ("quality_grade", "exact"), "quality_in": ("quality_grade", "in"), "inventory_status": ("inventory_status", "exact"),
    "observed_from": ("observed_on", "gte"), "observed_to": ("observed_on", "lte"), "departure_from": ("departure", "gte"), "departure_to": ("departure", "lte"),
    "min_fare": ("total", "gte"), "max_fare": ("total", "lte"), "is_outlier": ("is_outlier", "exact"), "is_duplicate": ("is_duplicate", "exact"),
}
SERIES = {
    "methodology": ("methodology", "exact"), "route": ("route", "iexact"), "national": ("route", "isnull"), "lead_window": ("lead_window", "exact"),
    "lead_window_in": ("lead_window", "in"), "date_from": ("index_date", "gte"), "date_to": ("index_date", "lte"), "published": ("is_published", "exact"),
}
RAW = {
    "source": ("source", "iexact"), "route": ("route", "iexact"), "lead_window": ("lead_window", "exact"), "captured_from": ("captured_at", "gte"),
    "captured_to": ("captured_at", "lte"), "is_processed": ("is_processed", "exact"), "has_error": ("error", "nonempty"),
}
RUNS = {"status": ("status", "iexact"), "created_from": ("created_at", "gte"), "created_to": ("created_at", "lte")}
AUDIT = {"action": ("action", "iexact"), "entity_type": ("entity_type", "iexact"), "entity_id": ("entity_id", "iexact"), "created_from": ("created_at", "gte"), "created_to": ("created_at", "lte")}
ROUTES = {name: (name, "exact") for name in ("is_active", "in_basket", "origin", "destination")}

#: Filters of fares that restrict only where they are asked for with true.
FARES_DERIVED: dict[str, Callable[[], Column]] = {"priced_only": lambda: F.col("total").isNotNull(), "index_eligible": eligible}


def asked(rows: DataFrame, wanted: Mapping[str, Any], named: Mapping[str, tuple[str, str]], derived: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """rows that pass every filter asked for. Unknown names raise ValueError; false for a derived one restricts nothing."""
    tests = []
    for name, value in wanted.items():
        if name in named:
            column, test = named[name]
            tests.append(TESTS[test](F.col(column), value))
        elif name not in (derived or {}):
            raise ValueError(f"no such filter: {name}")
        elif value:
            tests.append(derived[name]())
    return rows.where(reduce(and_, tests)) if tests else rows
