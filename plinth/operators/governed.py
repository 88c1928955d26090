"""What roles may read, as SQL: a table function of the role, and views of one role.

The condition is inside of the function, so a user's SQL can't leave it out. It can't be got round by order either: an optimiser
may test a user's condition on a row before this one, and an expression that fails, or says what it saw, would tell of a
row that the role may not read. So every column is null there unless the row may be read, and what a user's expression meets of
other rows is nulls alone, wherever it ends up in the plan. For a role that sees all, the test folds away with the role.

A user's filters don't reach a scan through such columns, but the condition itself does. Columns that are no secret (open) pass as
they are, and filters on them are pushed down; keys by which a table is partitioned are the usual ones.

Whoever may define views or read paths is beyond this: give users the function or view alone.
Defined results: a row whose mark is null is not published; a null or unknown role sees what is published; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Roles that see what is not published.
FULL = ("nso", "admin")


def _name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def publish(rows: DataFrame, name: str, published: str = "is_published", full: Iterable[str] = FULL, open: Iterable[str] = ()) -> None:
    """Make name(role) a table function of the session: rows' columns but for published, of the rows that the role may read."""
    spark, shown = rows.sparkSession, [f for f in rows.schema.fields if f.name != published]
    if unknown := {published, *open} - set(rows.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    under, allowed = f"_rows_of_{name}", "_readable"
    while allowed in rows.columns:
        allowed += "_"
    rows.createOrReplaceTempView(under)
    roles = ", ".join(_text(r) for r in full)
    test = _name(published) + (f" or coalesce(lower({_name(name)}.role) in ({roles}), false)" if roles else "")
    columns = ", ".join(_name(f.name) if f.name in set(open) else f"if({_name(allowed)}, {_name(f.name)}, null) as {_name(f.name)}" for f in shown)
    returns = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in shown)
    spark.sql(f"create or replace temporary function {_name(name)}(role string) returns table ({returns}) return select {columns} from (select *, {test} as {_name(allowed)} from {_name(under)}) where {_name(allowed)}")


def view_of(spark: SparkSession, name: str, role: str, view: str) -> None:
    """Make view what role reads of a published name."""
    spark.sql(f"select * from {_name(name)}({_text(role)})").createOrReplaceTempView(view)
