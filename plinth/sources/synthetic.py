"""A deterministic synthetic fare feed: three flights of every carrier, for every route, lead window and day.

fares_feed() builds it from expressions alone: every random choice is a slice of a SHA-256 of the row's key, so any
task makes the same rows anywhere. raw_feed() adds what real sources do to it. The data source "synthetic_fares" gives the rows
of fares_feed() to spark.read, a partition a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Carriers and their price level, and anchors of the lead-time curve as days and factor, by profile; price level by weekday
#: from Monday; factors of a price shock: fixed values of the feed.
PROFILES = {
    "standard": (
        (("6E", 0.96), ("AI", 1.10), ("UK", 1.08), ("SG", 0.93), ("QP", 0.92), ("IX", 0.95)),
        ((1, 2.4), (2, 2.15), (3, 1.95), (5, 1.7), (7, 1.52), (10, 1.34), (15, 1.18), (21, 1.08), (30, 1.0), (38, 0.97), (45, 0.95)),
    ),
    "legacy": (
        (("6E", 0.96), ("AI", 1.10), ("UK", 1.08), ("SG", 0.93), ("QP", 0.92)),
        ((1, 2.4), (2, 2.18), (3, 2.02), (4, 1.9), (5, 1.79), (7, 1.61), (10, 1.44), (14, 1.29), (21, 1.14), (30, 1.03), (45, 0.9)),
    ),
}
WEEKDAYS = (0.97, 0.95, 0.96, 1.0, 1.08, 1.05, 1.1)
SHOCKS = (0.28, 0.34, 3.6, 4.8, 6.2)
SOLD_OUT = 0.03
SCHEMA = "route string, lead_window int, observed_on date, carrier string, flight string, base_fare decimal(12,2), gst decimal(12,2), total decimal(12,2), is_sold_out boolean"


def curve(days: Column, profile: str = "standard") -> Column:
    """The factor for a lead of so many days: straight lines between anchors, held at the ends."""
    anchors = PROFILES[profile][1]
    d = F.greatest(F.least(days, F.lit(anchors[-1][0])), F.lit(anchors[0][0]))
    out = None
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        line = F.lit(y0) + (d - x0) * F.lit((y1 - y0) / (x1 - x0))
        out = F.when(d <= x1, line) if out is None else out.when(d <= x1, line)
    return F.round(out, 4)


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a digest of the key."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(salt)), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _tax() -> Column:
    return F.lit("0.05").cast("decimal(3,2)")


def _priced(tasks: DataFrame, base: float, sold_out: float, profile: str) -> DataFrame:
    """tasks times carriers times flights, with key, fare and gone; eighteen rows a task in the standard profile."""
    carriers = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(f).alias("factor")) for c, f in PROFILES[profile][0]])
    rows = tasks.withColumn("c", F.explode(carriers)).withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    rows = rows.withColumn("key", F.concat_ws("|", "route", "lead_window", "observed_on", "c.code", "n"))
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("observed_on") + 1)
    fare = F.round(base * F.col("c.factor") * curve(F.col("lead_window"), profile) * weekday * (0.92 + 0.16 * uniform(F.col("key"), "jitter")), 2).cast("decimal(12,2)")
    gone = uniform(F.col("key"), "sold") < F.when(F.col("lead_window") <= 3, 4 * sold_out).otherwise(sold_out)
    return rows.withColumns({"carrier": F.col("c.code"), "flight": F.concat("c.code", F.lpad((F.col("n") * 100 + 11).cast("string"), 4, "0")), "fare": fare, "gone": gone})


def fares_feed(tasks: DataFrame, base: float = 4000.0, sold_out: float = SOLD_OUT, profile: str = "standard") -> DataFrame:
    """Three flights of every carrier for each task (route, lead_window, observed_on). Sold-out rows have no price; late ones sell out more."""
    rows = _priced(tasks, base, sold_out, profile)
    gst = F.round(F.col("fare") * _tax(), 2)
    priced = lambda c: F.when(~F.col("gone"), c).cast("decimal(12,2)")
    return rows.select("route", F.col("lead_window").cast("int").alias("lead_window"), "observed_on", "carrier", "flight", priced(F.col("fare")).alias("base_fare"), priced(gst).alias("gst"), priced(F.col("fare") + gst).alias("total"), F.col("gone").alias("is_sold_out"))


def raw_feed(tasks: DataFrame, base: float = 4000.0, sold_out: float = SOLD_OUT, partial: float = 0.06, waived: float = 0.2, shocked: float = 0.01, localized: float = 0.15, profile: str = "standard") -> DataFrame:
    """The feed as sources publish it: amounts are texts, and what a source leaves out is null, never zero.

    A sold-out row has no amounts; a partial one its total alone; a waived charge is an explicit zero; a shock multiplies
    the base fare; a localized row writes its amounts with the currency's sign and grouping.
    """
    key, rows = F.col("key"), _priced(tasks, base, sold_out, profile)
    shock = F.when(uniform(key, "shock") < shocked, F.element_at(F.array(*[F.lit(str(x)).cast("decimal(4,2)") for x in SHOCKS]), F.floor(uniform(key, "size") * len(SHOCKS)).cast("int") + 1))
    other = F.when(uniform(key, "waived") < waived, 0).otherwise(150 + 25 * F.floor(uniform(key, "other") * 30))
    rows = rows.withColumns({"shock": shock, "other": other.cast("decimal(12,2)"), "is_partial": ~F.col("gone") & (uniform(key, "partial") < partial), "is_localized": uniform(key, "local") < localized})
    rows = rows.withColumn("base_fare", F.round(F.col("fare") * F.coalesce("shock", F.lit(1).cast("decimal(4,2)")), 2).cast("decimal(12,2)"))
    rows = rows.withColumn("gst", F.round((F.col("base_fare") + F.col("other")) * _tax(), 2))
    amounts = {"base_fare": F.col("base_fare"), "other_charges": F.col("other"), "gst": F.col("gst"), "total_fare": F.col("base_fare") + F.col("other") + F.col("gst")}

    def text(name: str, c: Column) -> Column:
        written = F.when(F.col("is_localized"), F.concat(F.lit("₹ "), F.format_number(c, 2))).otherwise(c.cast("decimal(12,2)").cast("string"))
        shown = ~F.col("gone") if name == "total_fare" else ~F.col("gone") & ~F.col("is_partial")
        return F.when(shown, written).alias(name)

    status = F.when(F.col("gone"), "SOLD_OUT").otherwise("AVAILABLE").alias("inventory_status")
    return rows.select("route", "lead_window", "observed_on", "carrier", "flight", *[text(n, c) for n, c in amounts.items()], status, F.col("shock").cast("double").alias("shock"))


class _Task(InputPartition):
    def __init__(self, route: str, lead_window: int, day: str):
        super().__init__(0)
        self.route, self.lead_window, self.day = route, lead_window, day


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.routes = options.get("routes", "DEL-BOM").split(",")
        self.windows = [int(w) for w in options.get("windows", "1,7,15,30,45").split(",")]
        self.day = options.get("day", "2024-01-01")
        self.base = float(options.get("base", "4000"))
        self.carriers, self.anchors = PROFILES[options.get("profile", "standard")]

    def partitions(self) -> list[InputPartition]:
        return [_Task(r, w, self.day) for r in self.routes for w in self.windows]

    def _factor(self, days: int) -> float:
        d = max(min(days, self.anchors[-1][0]), self.anchors[0][0])
        line = next(y0 + (d - x0) * ((y1 - y0) / (x1 - x0)) for (x0, y0), (x1, y1) in zip(self.anchors, self.anchors[1:]) if d <= x1)
        return _half_up(line, "0.0001")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The rows of fares_feed for one task."""
        from datetime import date
        from decimal import Decimal

        day = date.fromisoformat(partition.day)
        for code, level in self.carriers:
            for n in (1, 2, 3):
                key = f"{partition.route}|{partition.lead_window}|{partition.day}|{code}|{n}"
                u = lambda salt: int(hashlib.sha256((key + salt).encode()).hexdigest()[:13], 16) / 16**13  # noqa: B023, E731
                gone = u("sold") < (4 * SOLD_OUT if partition.lead_window <= 3 else SOLD_OUT)
                fare = Decimal(repr(_half_up(self.base * level * self._factor(partition.lead_window) * WEEKDAYS[day.weekday()] * (0.92 + 0.16 * u("jitter")), "0.01"))).quantize(Decimal("0.01"))
                gst = (fare * Decimal("0.05")).quantize(Decimal("0.01"), "ROUND_HALF_UP")
                money = (None, None, None) if gone else (fare, gst, fare + gst)
                yield (partition.route, partition.lead_window, day, code, f"{code}{n * 100 + 11:04d}", *money, gone)


def _half_up(x: float, step: str) -> float:
    from decimal import Decimal

    return float(Decimal(repr(x)).quantize(Decimal(step), "ROUND_HALF_UP"))


class SyntheticFares(DataSource):
    """spark.read.format("synthetic_fares").option("routes", "DEL-BOM,DEL-BLR").option("windows", "1,7").load()"""

    @classmethod
    def name(cls) -> str:
        return "synthetic_fares"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


#: Sources by code: kind, tags and the function that registers it.
_SOURCES: dict[str, tuple[str, tuple[str, ...], type[DataSource]]] = {"synthetic": ("mock", ("deterministic",), SyntheticFares)}


def register(spark: SparkSession, code: str = "synthetic") -> str:
    """Make a source known to the session; returns its format name. Unknown codes raise KeyError."""
    spark.dataSource.register(_SOURCES[code][2])
    return _SOURCES[code][2].name()


def entries(kind: str | None = None) -> list[str]:
    return sorted(c for c, (k, *_) in _SOURCES.items() if kind in (None, k))
