"""Fares out of JSON payloads by configuration: where the results are, which path is which field, what sold out means."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """results: path of the list in the payload; fields: column to path in an item; sold_out: (path, rule, value)."""

    results: str
    fields: dict[str, str]
    sold_out: tuple[str, str, object] | None = None
    types: dict[str, str] = field(default_factory=dict)


def _is_sold_out(item: Column, rule: tuple[str, str, object]) -> Column:
    path, test, value = rule
    found = F.try_variant_get(item, path, "string")
    if test == "equals":
        return F.coalesce(found == str(value), F.lit(False))
    if test == "in":
        return F.coalesce(found.isin(*map(str, value)), F.lit(False))
    return F.coalesce(~F.lower(found).isin("", "0", "false", "none", "null", "[]", "{}"), F.lit(False))


def _once(value: Column, then) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dig(node: Column, path: list[str]) -> Column:
    """What a path leads to in a variant, compiled to one expression; null where it leads nowhere.

    In an object a segment is a name. In a list a number is a place, and a name means the first item that is an object with
    that name (whatever its value there). Nothing is inside of a text or a number.
    """

    def step(at: Column, segment: str) -> Column:
        def inside(kinds: Column) -> Column:
            if segment.isdigit():
                of_list = F.get(kinds["items"], F.lit(int(segment)))
            else:
                named = F.filter(F.transform(kinds["items"], lambda x: F.try_variant_get(x, "$", "map<string,variant>")), lambda m: F.coalesce(F.map_contains_key(m, segment), F.lit(False)))
                of_list = F.try_element_at(F.get(named, F.lit(0)), F.lit(segment))
            return F.when(kinds["items"].isNotNull(), of_list).otherwise(F.try_element_at(kinds["fields"], F.lit(segment)))

        return _once(at, lambda v: _once(F.struct(F.try_variant_get(v, "$", "array<variant>").alias("items"), F.try_variant_get(v, "$", "map<string,variant>").alias("fields")), inside))

    for segment in path:
        node = step(node, segment)
    return node


#: A path that is a name of the item itself: fixed value.
_NAME = re.compile(r"\$\.([A-Za-z_][A-Za-z0-9_]*)", re.ASCII)


def _names(mapping: Mapping) -> dict[str, tuple[str, str]] | None:
    """Column to name and type, if all that a mapping wants are an item's own names, each as one type; else null."""
    found = {c: (m[1], mapping.types.get(c, "string")) for c, path in mapping.fields.items() if (m := _NAME.fullmatch(path))}
    kinds = set(found.values())
    plain = len(found) == len(mapping.fields) and not mapping.sold_out and all(re.fullmatch(r"\w+(\([\d, ]+\))?", kind) for _, kind in kinds)
    return found if plain and len({name.lower() for name, _ in kinds}) == len(kinds) else None


def extract(raw: DataFrame, mapping: Mapping, payload: str = "payload") -> DataFrame:
    """One row an item, with raw's other columns; a path that isn't there gives null, never zero. Bad JSON gives no rows.

    Where all paths are names of the item, an item is read once, as a struct; else it is searched for each path.
    """
    kept, parsed, names = [c for c in raw.columns if c != payload], F.try_parse_json(F.col(payload)), _names(mapping)
    if names:
        kinds = ", ".join(f"`{name}`: {kind}" for name, kind in dict.fromkeys(names.values()))
        rows = raw.select(*kept, F.explode(F.try_variant_get(parsed, mapping.results, f"array<struct<{kinds}>>")).alias("_item"))
        return rows.select(*kept, *[F.col("_item")[name].alias(c) for c, (name, _) in names.items()])
    rows = raw.select(*kept, F.explode(F.try_variant_get(parsed, mapping.results, "array<variant>")).alias("_item"))
    cols = {name: F.try_variant_get("_item", path, mapping.types.get(name, "string")) for name, path in mapping.fields.items()}
    if mapping.sold_out:
        cols["is_sold_out"] = _is_sold_out(F.col("_item"), mapping.sold_out)
    return rows.withColumns(cols).drop("_item")


def segment_lookup(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Journeys whose segments name a key of a dictionary of flight details in the same payload.

    Paths: j[0].s[*].b[0].FL[0] keys dctFltDtl; the first of lstFr has the fares. Absent amounts stay null.
    """
    schema = "struct<j:array<struct<s:array<struct<b:array<struct<FL:array<string>>>,lstFr:array<struct<BF:decimal(12,2),TF:decimal(12,2)>>>>>>,dctFltDtl:map<string,struct<AC:string,FN:string,DDT:string,DTM:string>>>"
    parsed = raw.withColumn("_p", F.from_json(payload, schema))
    rows = parsed.select(*[c for c in raw.columns if c != payload], F.explode(F.get("_p.j", F.lit(0))["s"]).alias("s"), F.col("_p.dctFltDtl").alias("details"))
    rows = rows.withColumn("key", F.get(F.get("s.b", F.lit(0))["FL"], F.lit(0))).withColumn("d", F.try_element_at("details", F.col("key"))).withColumn("fare", F.get("s.lstFr", F.lit(0)))
    return rows.select(*[c for c in raw.columns if c != payload], "key", F.col("d.AC").alias("carrier"), F.col("d.FN").alias("flight"), F.concat_ws(" ", "d.DDT", "d.DTM").alias("departure"), F.col("fare.BF").alias("base_fare"), F.col("fare.TF").alias("total"))


def failure_kind(error: Column, status: Column) -> Column:
    """What kind of failure an error text or status is; null for none."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(low.contains("challenge") | status.isin(401, 403, 407, 451), "blocked").when(low.contains("halted"), "halted")
        .when(low.contains("robots"), "robots_disallowed").when((status == 429) | low.contains("rate"), "rate_limited")
        .when(low.contains("timeout"), "timeout").when(status >= 500, "server_error").when(low != "", "error")
    )


def run_status(ok: Column, failed: Column, blocked: Column) -> Column:
    """The status of a collection run from its counters."""
    return F.when((ok == 0) & (blocked > 0), "BLOCKED").when(ok == 0, "FAILED").when((failed > 0) | (blocked > 0), "PARTIAL").otherwise("SUCCEEDED")
