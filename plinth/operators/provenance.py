"""Tamper evidence: Merkle roots, canonical JSON, hash chains per series, their verification, and lineage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.lineage import cut

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _level_up(nodes: Column) -> Column:
    """Parents of a level of hex digests; an odd last node is paired with itself."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.unhex(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i)))), 256))


def merkle_root(leaves: Column, depth: int = 32) -> Column:
    """The root of an ordered binary SHA-256 tree over an array of hex digests; of none, the digest of the empty text."""
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), leaves, lambda nodes, _: F.when(F.size(nodes) > 1, _level_up(nodes)).otherwise(nodes))
    return F.when(F.size(leaves) == 0, F.lit(EMPTY)).otherwise(F.get(folded, F.lit(0)))


def _beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with the columns of the few rows of right (null where it has none) that have equal or equally missing keys; left stays where it is."""
    named = F.broadcast(right.withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(on)}))
    return left.join(named, reduce(and_, [left[k].eqNullSafe(named[f"_of_{i}"]) for i, k in enumerate(on)]), "left").drop(*[f"_of_{i}" for i in range(len(on))])


def _subtrees(by: list[str], text: bool, whole: bool):
    """Batches in the order of by and _leaf to those of the largest subtrees of each run of leaves, or (whole) batches of these in order to roots.

    A run is what has one _at, the place in its group of the run's first leaf. Only a stack of subtrees is kept between batches, two of
    a level at most. A run of missing leaves is one row without a node.
    """

    def fold(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        def parts(nodes: list[bytes], at: int) -> list[tuple]:
            """The largest subtrees (level, place in it, digest) of consecutive leaves from a place on, from left to right."""
            left, right, level = [], [], 0
            while nodes:
                if at & 1:
                    left.append((level, at, nodes[0]))
                    nodes, at = nodes[1:], at + 1
                if len(nodes) & 1:
                    right.append((level, at + len(nodes) - 1, nodes[-1]))
                    nodes = nodes[:-1]
                nodes = [sha256(a + b).digest() for a, b in zip(nodes[::2], nodes[1::2])]
                level, at = level + 1, at >> 1
            return left + right[::-1]

        def grow(stack: list, level: int, place: int, node: bytes) -> None:
            """Put the next subtree on the stack, with those before it that it completes."""
            while place & 1 and stack and stack[-1][:2] == (level, place - 1):
                node = sha256(stack.pop()[2] + node).digest()
                level, place = level + 1, place >> 1
            stack.append((level, place, node))

        def ended(key: tuple, stack: list) -> list[tuple]:
            if not whole:
                return [(*key[:-1], place << level, level, node) for level, place, node in stack] or [(*key[:-1], 0, None, None)]
            n = sum(1 << level for level, _, _ in stack)
            while len(stack) > 1:
                # the last node of a level is paired with itself
                level, place, node = stack[-1]
                if place & 1:
                    raise ValueError(f"subtrees of {key} don't adjoin")
                grow(stack, level, place + 1, node)
            return [(*key, n, stack[0][2].hex() if stack else EMPTY)]

        def firsts(columns: list[pa.Array], n: int) -> list[int]:
            """Where a row's key is another than that of the row before it."""
            new = np.arange(n) == 0
            for c in columns:
                codes = np.array([repr(x) for x in c.to_pylist()]) if pa.types.is_nested(c.type) else c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return np.flatnonzero(new).tolist()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        key, stack, last, at, schema = None, [], None, 0, None
        more = [("n_leaves", pa.int64()), ("root", pa.string())] if whole else [("_at", pa.int64()), ("_level", pa.int32()), ("_node", pa.binary())]
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([*[batch.schema.field(k) for k in by], *[pa.field(*f) for f in more]])
            keys = [batch.column(k) for k in ([*by] if whole else [*by, "_at"])]
            leaves = batch.column("_node" if whole else "_leaf").to_numpy(zero_copy_only=False).tolist()
            places, levels = (batch.column(c).to_pylist() for c in ("_at", "_level")) if whole else (None, None)
            starts, out = firsts(keys, batch.num_rows), []
            for i, end in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(c[i].as_py() for c in keys)
                # NaN is a key too, though unequal to itself
                if now != key and repr(now) != repr(key):
                    out += [] if key is None else ended(key, stack)
                    key, stack, last, at = now, [], None, 0 if whole else now[-1]
                if whole:
                    found = [(levels[j], places[j] >> levels[j], leaves[j]) for j in range(i, end) if leaves[j] is not None]
                else:
                    few = [b for a, b in zip([last, *leaves[i : end - 1]], leaves[i:end]) if b is not None and a != b]
                    last = few[-1] if few else last
                    found = parts([bytes.fromhex(x) for x in few] if text else few, at)
                    at += len(few)
                for subtree in found:
                    grow(stack, *subtree)
            if out:
                yield made(out)
        if key is not None:
            yield made(ended(key, stack))

    return fold


def merkle_by(rows: DataFrame, by: list[str], leaf: str, levels: int = 16, prefix: int | None = None) -> DataFrame:
    """The root over each group's distinct leaves in order, however many they are. Leaves are digests, as hex texts or (half the size) as bytes.

    Leaves are shuffled once. A group of no more than 2^levels rows is one run of its partition. One of more is parted by as many
    leading hex signs as leave 2^levels leaves to each part (or prefix, for all groups), digests being spread evenly over those; what
    was shuffled is counted first, so that each part knows its first leaf's place. A run is read once, in order, and leaves its largest subtrees, two of a
    level at most; those of a group are put together in the same way. No array holds a group or a part. The sizes that are broadcast
    are a row for each 2^levels rows and one for each 2^(levels - 4), at most.
    """
    text = isinstance(rows.schema[leaf].dataType, T.StringType)
    rows = rows.select(*by, F.col(leaf).alias("_leaf"))
    if prefix is None:
        large = rows.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > (1 << levels))
        rows = _beside(rows, large.select(*by, F.ceil(F.log(F.col("_rows") / (1 << levels)) / F.log(F.lit(16.0))).cast("int").alias("_signs")), by)
    else:
        rows = rows.withColumn("_signs", F.lit(prefix))
    start = F.col("_leaf") if text else F.hex(F.substring("_leaf", 1, 8))
    start = F.when(F.col("_leaf").isNotNull() & (F.col("_signs") > 0), F.substring(start, F.lit(1), F.col("_signs"))).otherwise("")
    keys = [*by, "_start"]
    rows = rows.select(*by, start.alias("_start"), "_leaf").repartition(*keys)
    # what makes up a whole group is not counted; that is in the sum and no filter, which would be moved before the shuffle and make another
    sizes = rows.groupBy(*keys).agg(F.count_distinct(F.when(F.col("_start") != "", F.col("_leaf"))).alias("_size")).where("_size > 0")
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    placed = _beside(rows, sizes.select(*keys, before.alias("_before")), keys)
    runs = placed.select(*by, F.coalesce("_before", F.lit(0)).alias("_at"), "_leaf").sortWithinPartitions(*by, "_leaf")
    kinds = [rows.schema[k] for k in by]
    part = T.StructType([*kinds, T.StructField("_at", T.LongType()), T.StructField("_level", T.IntegerType()), T.StructField("_node", T.BinaryType())])
    root = T.StructType([*kinds, T.StructField("n_leaves", T.LongType()), T.StructField("root", T.StringType())])
    nodes = runs.mapInArrow(_subtrees(by, text, False), part).repartition(*by).sortWithinPartitions(*by, "_at")
    return nodes.mapInArrow(_subtrees(by, False, True), root)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys and no blanks; every value is a quoted text, or null."""
    return F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def _canonical(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError("a binary fraction has no one text: cast it to a decimal")
    if isinstance(kind, T.DecimalType):
        plain = F.regexp_replace(F.regexp_replace(F.format_number(value, kind.scale), ",", ""), r"(\.[0-9]*?)0+$", "$1")
        text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), "^-0$", "0"), F.lit('"'))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = value.cast("string")
    elif isinstance(kind, T.StringType):
        escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        text = F.concat(F.lit('"'), escaped, F.lit('"'))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_trunc("second", value) == value
        text = F.concat(F.lit('"'), F.when(whole, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit('+00:00"'))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_canonical(e["key"], kind.keyType), F.lit(":"), _canonical(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), _canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def with_canonical(rows: DataFrame, fields: dict[str, Column], name: str = "body") -> DataFrame:
    """rows with the canonical JSON text of the fields, whatever their types: sorted keys, no blanks.

    Decimals are quoted plain text without trailing zeros, times are in UTC (the session's zone), nested values go all the
    way down. Floats and doubles raise TypeError, since their text isn't one. Maps need unique text keys.
    """
    body = rows.select(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]).alias("_body"))
    kind = body.schema["_body"].dataType
    parts = [F.concat(F.lit(f'"{f.name}":'), _canonical(fields[f.name], f.dataType)) for f in kind.fields]
    return rows.withColumn(name, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def with_digest(rows: DataFrame, fields: dict[str, Column], name: str) -> DataFrame:
    """rows with the SHA-256 of the canonical text of the fields: of a methodology, a weight set, a payload, a lineage node."""
    return with_canonical(rows, fields, name).withColumn(name, F.sha2(name, 256))


def sealed(rows: DataFrame, series: list[str], order: str, fields: dict[str, Column], hashes: Column, previous: str = "") -> DataFrame:
    """series, order, inputs_root, input_count, previous_hash and provenance_hash of each published value.

    The hash is over the canonical text of the fields with the Merkle root of the value's distinct ingress hashes, their
    count, and the hash before it in its series. hashes is an array for each row: what one publication lists. To go on with a
    stored chain, pass its head as previous.
    """
    made = rows.withColumn("_leaves", F.array_sort(F.array_distinct(hashes))).withColumns({"inputs_root": merkle_root(F.col("_leaves")), "input_count": F.size("_leaves")})
    whole = fields | {"inputs_root": F.col("inputs_root"), "input_count": F.col("input_count")}
    # keys are sorted, so what is before and after the hash that a row refers to is known without it
    head, tail = ({k: c for k, c in whole.items() if (k < "previous_hash") == low} for low in (True, False))
    made = with_canonical(with_canonical(made, head, "_head"), tail, "_tail")
    start = F.concat(F.left(F.col("_head"), F.length("_head") - 1), F.lit(',"previous_hash":"'))
    end = F.concat(F.lit('",'), F.substring(F.col("_tail"), F.lit(2), F.length("_tail"))) if tail else F.lit('"}')
    parted = made.withColumns({"_body": start, "_end": end})
    chain = chained(parted, series, order, "_body", previous, "_end").withColumnRenamed("chain_hash", "provenance_hash")
    kept = parted.select(*series, F.col(order).cast("bigint").alias(order), "inputs_root", "input_count")
    return kept.join(chain.select(*series, order, "previous_hash", "provenance_hash"), [*series, order])


def lineage_checked(nodes: DataFrame, digest: str, parents: str, fields: dict[str, Column]) -> DataFrame:
    """nodes with intact (the digest is that of the fields and the parents in order) and n_dangling (parents that are no nodes)."""
    made = with_digest(nodes, fields | {"parents": F.array_sort(parents)}, "_again").withColumn("intact", F.col("_again") == F.col(digest)).drop("_again")
    edges = nodes.select(F.col(digest).alias("_of"), F.explode(parents).alias("_parent")).distinct()
    lost = edges.join(nodes.select(F.col(digest).alias("_parent")).distinct(), "_parent", "left_anti").groupBy("_of").agg(F.count("*").alias("n_dangling"))
    return made.join(lost, made[digest] == lost["_of"], "left").drop("_of").withColumn("n_dangling", F.coalesce("n_dangling", F.lit(0)))


def _linked(series: list[str], order: str, body: str, with_end: bool):
    """Batches of rows in the order of their series to batches with hashes; only the last hash is kept between rows."""

    def fold(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        of, last = None, ""
        for batch in batches:
            column = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            keys = list(zip(*[column[c] for c in series])) if series else [()] * batch.num_rows
            ends = column["_chain_end"] if with_end else None
            before, after = [], []
            for i, (key, text, first) in enumerate(zip(keys, column[body], column["_chain_first"])):
                of, last = (key, last) if key == of else (key, first)
                before.append(last)
                whole = (text or "") + last + (ends[i] or "") if with_end else last + (text or "")
                last = hashlib.sha256(whole.encode()).hexdigest()
                after.append(last)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in (*series, order, body)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(after, pa.string())], [*series, order, body, "previous_hash", "chain_hash"])

    return fold


def chained(rows: DataFrame, series: list[str], order: str, body: str, genesis: str = "", end: str | None = None, first: str | None = None) -> DataFrame:
    """Each row with previous_hash and chain_hash = sha256(previous || body), along each series in its order (ties: the body's).

    With end, the hash is over body || previous || end. A series starts from genesis, or from the column first where it
    isn't null. Null texts count as empty. A chain is serial by nature: series run side by side, each as a sorted run
    of its partition that is read once, so that neither its length nor the number of series needs memory.
    """
    start = F.lit(genesis) if first is None else F.coalesce(F.col(first), F.lit(genesis))
    more = {"_chain_first": start} | ({"_chain_end": F.col(end)} if end else {})
    parts = rows.select(*series, F.col(order).cast("bigint").alias(order), F.col(body).cast("string").alias(body), *[c.alias(n) for n, c in more.items()])
    runs = (parts.repartition(*series) if series else parts.repartition(1)).sortWithinPartitions(*series, order, body)
    kind = T.StructType([*[parts.schema[c] for c in (*series, order, body)], T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])
    return runs.mapInArrow(_linked(series, order, body, end is not None), kind)


def verified(chain: DataFrame, series: list[str], order: str, body: str) -> DataFrame:
    """Per series: rows, whether the chain holds, and the first position and reason where it doesn't.

    The first row's own back-link is taken as given: it may continue an earlier part of the chain.
    """
    before = F.lag("chain_hash").over(Window.partitionBy(*series).orderBy(order))
    reason = F.when(F.sha2(F.concat("previous_hash", body), 256) != F.col("chain_hash"), "digest mismatch").when(F.col("before") != F.col("previous_hash"), "broken back-link")
    checked = chain.withColumn("before", before).withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    return checked.groupBy(*series).agg(F.count("*").alias("n"), (F.count(F.when(bad, 1)) == 0).alias("valid"), F.min(F.when(bad, F.col(order))).alias("first_broken"), F.min_by("reason", F.when(bad, F.col(order))).alias("reason"))


def previous_as_of(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """series with the latest earlier value of the same (null-safe) series."""
    return series.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", most: int | None = None) -> DataFrame:
    """node, ancestor, distance: the transitive closure of parent edges, by doubling of paths until no pair is added.

    Rounds grow with the logarithm of the depth; each is one join on the middle node. With most, a lineage that has an
    ancestor more steps away raises ValueError.
    """
    closed = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).distinct()
    before, total = -1, closed.count()
    while before != total:
        left = closed.withColumnsRenamed({"ancestor": "middle", "distance": "d1"})
        right = closed.withColumnsRenamed({"node": "middle", "distance": "d2"})
        longer = left.join(right, "middle").select("node", "ancestor", (F.col("d1") + F.col("d2")).alias("distance"))
        closed = closed.unionAll(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        closed = cut(closed)
        before, total = total, closed.count()
        if most is not None and not closed.where(F.col("distance") > most).isEmpty():
            raise ValueError(f"a lineage is deeper than {most} steps")
    return closed


def dangling(edges: DataFrame, nodes: DataFrame, parent: str = "parent", node: str = "node") -> DataFrame:
    """Edges whose parent is not a node."""
    return edges.join(nodes, edges[parent] == nodes[node], "left_anti")
