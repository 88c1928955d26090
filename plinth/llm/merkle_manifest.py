"""A Merkle manifest of a table: a digest for each row, a tree for each group, a tree over the groups, and a proof for each row.

Every three nodes in a row become one (of the last run: fewer, even one), until one is left. Rows get their places in their
group from a range sort by group, key and digest: a partition's rows are numbered in a stream, and what earlier
partitions hold of a group is added, so a group with a third of all rows is spread over as many partitions as it fills.

Proofs come by fractal traversal. A tree is cut into aligned blocks of 3^(HEIGHT * STACKED) nodes. A block's task walks its nodes
in order and keeps a stack of existing subtrees of HEIGHT levels, each with the nodes that authenticate where the walk
is, and for each a desired subtree, the next one of its level, which is built by one node a step, and so is whole when the
walk gets there. So a step takes as many hashes as there are stacked subtrees, and a task keeps one block. The nodes on
top of the blocks are the leaves of the same job again, until a group is one block, and its root is a leaf of the tree over
groups; the proofs from above are joined to their blocks (one row a block) and appended to each row's own.

Defined results: a null field is `-`; rows with equal key and digest are neighbours in either order, which gives the same
tree, and rows with a null key come first; a null group is a group of its own, before all others; a very long text is
read once, for its digest; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plinth.llm.common import BATCH_ROWS, materialise, released, table

#: Nodes that become one.
WIDE = 3
#: Levels of a subtree, and subtrees on top of each other in a block: blocks of 3^8 = 6561 nodes.
HEIGHT, STACKED = 2, 4
BLOCK = WIDE ** (HEIGHT * STACKED)
PROOF = "array<struct<place:int,others:array<string>>>"
_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: of each field `-` if null, else its bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


# --- places ----------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """rows with at (the place in its group, in the order of the columns, from 0) and n (the group's rows); group: a column without nulls.

    Ordering columns may be null (nulls first) and are numbers or texts.
    """
    names = rows.columns
    keys = [group, *order] if group else order
    runs = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import numpy as np

        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if group:
                own = batch.column(batch.schema.get_field_index(group)).to_pylist()
                first = np.array([i for i in range(n) if own[i] != (own[i - 1] if i else last)], np.int64)
                at = np.arange(n)
                run = np.searchsorted(first, at, "right")
                at = np.where(run > 0, at - (first[run - 1] if len(first) else 0), at + done)
                last, done = (own[-1], int(at[-1]) + 1) if n else (last, done)
            else:
                at = np.arange(done, done + n)
                done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(at, pa.int64())], [*names, "_part", "_at"])

    numbered = materialise(runs.mapInArrow(released(number), T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])))
    by = ["_part", group] if group else ["_part"]
    counts = numbered.groupBy(*by).agg(F.count("*").alias("_n"))
    # a row for each partition of a group: by group, no more than there are partitions
    whole = Window.partitionBy(*([group] if group else [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    return numbered.join(counts, by).select(*names, (F.col("_at") + F.col("_before")).alias("at"), "n")


# --- one block -------------------------------------------------------------------------------------------------


class Builder:
    """Takes the nodes of a subtree in order and gives its levels, from the given one up to below its root; and the root."""

    def __init__(self, lowest: int, levels: int):
        self.lowest, self.levels, self.root = lowest, levels, None
        self.open: list[list[str]] = [[] for _ in range(levels)]
        self.kept: list[list[str]] = [[] for _ in range(levels - lowest)]

    def add(self, node: str, level: int = 0) -> None:
        while level < self.levels:
            if level >= self.lowest:
                self.kept[level - self.lowest].append(node)
            self.open[level].append(node)
            if len(self.open[level]) < WIDE:
                return
            node, self.open[level] = joined(self.open[level]), []
            level += 1
        self.root = node

    def close(self) -> None:
        """No more nodes come: what is begun becomes a node, even of one."""
        for level in range(self.levels):
            if self.open[level]:
                node, self.open[level] = joined(self.open[level]), []
                self.add(node, level + 1)


def depth(n: int) -> int:
    """The levels from n leaves to their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDE), levels + 1
    return levels


def top(nodes: list[str], levels: int) -> str:
    """The node that is so many levels above the nodes of an aligned block."""
    made = Builder(levels, levels)
    for node in nodes:
        made.add(node)
    made.close()
    return made.root


def traversal(nodes: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each node of an aligned block in order, its proof up to so many levels: its place among, and the others of, each run."""
    spans = []  # of the subtrees at each height of the stack: lowest level, levels, nodes below
    for low in range(0, levels, HEIGHT):
        high = min(low + HEIGHT, levels)
        spans.append((low, high, WIDE**high))

    def built(low: int, high: int, part: list[str]) -> Builder:
        made = Builder(low, high)
        for node in part:
            made.add(node)
        made.close()
        return made

    existing = [built(low, high, nodes[:span]) for low, high, span in spans]
    desired = [Builder(low, high) for low, high, _ in spans]
    for at in range(len(nodes)):
        proof = []
        for (low, high, span), tree in zip(spans, existing, strict=True):
            inside = at % span
            for level in range(low, high):
                q = inside // WIDE**level
                run = tree.kept[level - low][q - q % WIDE : q - q % WIDE + WIDE]
                proof.append((q % WIDE, run[: q % WIDE] + run[q % WIDE + 1 :]))
        yield proof
        for k, (low, high, span) in enumerate(spans):
            if at + span < len(nodes):
                desired[k].add(nodes[at + span])
            if (at + 1) % span == 0:
                desired[k].close()
                existing[k], desired[k] = desired[k], Builder(low, high)


# --- trees -----------------------------------------------------------------------------------------------------


def _in_blocks(names: list[str], work: Callable[[dict[str, list]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function over Arrow batches, sorted by (_group, _block, at), that hands work the columns of one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {c: [] for c in names}
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names}
            keys = list(zip(columns["_group"], columns["_block"], strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != own and held["at"]:
                    yield from work(held)
                    held = {c: [] for c in names}
                own = keys[lo]
                for c in names:
                    held[c] += columns[c][lo:hi]
                lo = hi
        if held["at"]:
            yield from work(held)

    return released(run)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "at")


def proofs(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame], *carried: str) -> DataFrame:
    """_group, at, node, the carried columns, subroot (the group's), root and proof, for each of nodes (_group, at, n, node, and carried).

    crown gets the groups' roots (_group, node) and says what stands over each: _group, root, proof. _group has no nulls. The
    blocks' tops are written and are the nodes of the next round, which has a BLOCK-th of the rows; so rounds are few, and the
    last one has no group of more than a block. What stands over a block comes as a row before the block's own.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    block = F.floor(F.col("at") / BLOCK).cast("long").alias("_block")

    def tops(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        n = held["n"][0]
        row = held["_group"][0], held["_block"][0], -(-n // BLOCK), top(held["node"], min(HEIGHT * STACKED, depth(n)))
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["_group", "at", "n", "node"])

    parts = _by_block(nodes.select("_group", block, "at", "n", "node"))
    above = materialise(parts.mapInArrow(_in_blocks(["_group", "_block", "at", "n", "node"], tops), "_group string, at long, n long, node string"))
    if most > BLOCK:
        above = materialise(proofs(above, crown))
    else:
        over = crown(above.select("_group", "node")).select(F.col("_group").alias("_of"), "root", "proof")
        above = above.join(over, F.col("_group") == F.col("_of")).withColumn("subroot", F.col("node"))
    heads = above.select("_group", F.col("at").alias("_block"), F.lit(-1).cast("long").alias("at"), "subroot", "root", F.col("proof").alias("_upper"))
    rows = nodes.select("_group", block, "at", "n", "node", *carried).unionByName(heads, allowMissingColumns=True)
    kinds = {f.name: T.StructField(f.name, f.dataType) for f in rows.schema.fields}
    out = T.StructType([*[kinds[c] for c in ("_group", "at", "node", *carried, "subroot", "root")], T.StructField("proof", kinds["_upper"].dataType)])

    def walk(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        subroot, root, upper = held["subroot"][0], held["root"][0], held["_upper"][0]
        own = {c: held[c][1:] for c in ("_group", "at", "node", *carried)}
        kept, at, size = [], 0, len(own["at"])
        for proof in traversal(own["node"], min(HEIGHT * STACKED, depth(held["n"][1]))):
            kept.append([{"place": p, "others": o} for p, o in proof] + upper)
            if len(kept) == BATCH_ROWS or at + len(kept) == size:
                part = slice(at, at + len(kept))
                columns = [pa.array(own[c][part], arrow[c]) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([subroot] * len(kept)), pa.array([root] * len(kept)), pa.array(kept, pa.list_(_STEP))], out.names)
                at, kept = at + len(kept), []

    arrow = {f.name: to_arrow_type(f.dataType) for f in out.fields if f.name != "proof"}
    return _by_block(rows).mapInArrow(_in_blocks(["_block", "n", "_upper", *out.names[:-1]], walk), out)


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its proof give."""
    def up(below: Column, step: Column) -> Column:
        left = F.slice(step["others"], F.lit(1), step["place"])
        right = F.slice(step["others"], step["place"] + 1, F.size(step["others"]))
        return F.sha2(F.concat(F.array_join(left, ""), below, F.array_join(right, "")), 256)

    return F.aggregate(proof, node, up)


def _alone(roots: DataFrame) -> DataFrame:
    return roots.select("_group", F.col("node").alias("root"), F.array().cast(PROOF).alias("proof"))


def _over_groups(roots: DataFrame) -> DataFrame:
    """The tree over the groups' roots, in the order of the groups, as a crown."""
    leaves = placed(roots, ["_group"]).select(F.lit("").alias("_group"), "at", "n", "node", F.col("_group").alias("_tree"))
    return materialise(proofs(materialise(leaves), _alone, "_tree").select(F.col("_tree").alias("_group"), "root", "proof"))


def manifest(rows: DataFrame, key: str, group: str, leaf: str, *carried: str) -> DataFrame:
    """key, group, the carried columns, leaf, subroot, root and proof (from the leaf to the root) for each row of rows.

    A proof's steps go up level by level: a node's place in its run, and the run's other nodes from left to right. key is a number or a
    text; groups are ordered by the bytes of their texts.
    """
    # as a text that is never null, in the groups' order: a null comes first
    own = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    named = {c: f"_kept{i}" for i, c in enumerate((group, *carried))}
    parts = rows.select(own.alias("_group"), F.col(key).alias("_key"), F.col(leaf).alias("node"), *[F.col(c).alias(n) for c, n in named.items()])
    trees = proofs(materialise(placed(parts, ["_key", "node"], "_group")), _over_groups, "_key", *named.values())
    return trees.select(F.col("_key").alias(key), *[F.col(n).alias(c) for c, n in named.items()], F.col("node").alias(leaf), "subroot", "root", "proof")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = ("source", "lang", "n_chars")
    whole = leaf_digest([F.col(c) for c in ("doc_id", *rest, "text")])
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(cut & F.contains("text", F.lit("\n")), leaf_digest([*[F.col(c) for c in ("doc_id", *rest)], F.replace("text", F.lit("\n"), F.lit(""))]))
    leaves = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", whole.alias("leaf"), tampered.alias("tampered")))
    made = manifest(leaves, "doc_id", "source", "leaf", "tampered")
    again = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: s["others"])), "")
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_sql() -> str:
    """The same by recursion over levels: of nodes, of the places above each leaf, and of the tampered leaf's way up."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    digest = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    byte = f"list_reduce([xor(a, b)::bigint] || [0::bigint for k in range(8)], lambda c, k: {bit})"
    crc = f"xor(list_reduce([4294967295::bigint] || [ascii(s)::bigint for s in string_split(doc_id::varchar, '')], lambda a, b: {byte}), 4294967295)"
    return f"""
with recursive docs as (
  select doc_id, source, {digest('text')} as leaf,
    case when {crc} % 2 = 0 then {digest("replace(text, chr(10), '')")} else {digest('text')} end as tampered,
    row_number() over (partition by source order by doc_id) - 1 as place, count(*) over (partition by source) as n
  from documents),
nodes as (
  select source, 0 as level, place, leaf as node, n from docs
  union all
  select source, level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((n + 2) // 3)
  from nodes where n > 1 group by source, level, place // 3),
tops as (select source, node, level, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
over_nodes as (
  select 0 as level, place, node, n from tops
  union all
  select level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((n + 2) // 3) from over_nodes where n > 1 group by level, place // 3),
steps as (
  select d.doc_id, s.level, string_agg(s.node, '' order by s.place) filter (s.place < d.place // pow(3, s.level)::bigint) as before,
    string_agg(s.node, '' order by s.place) filter (s.place > d.place // pow(3, s.level)::bigint) as behind
  from docs d join nodes s on s.source is not distinct from d.source and s.n > 1 and s.place // 3 = d.place // pow(3, s.level + 1)::bigint
  group by d.doc_id, s.level
  union all
  select d.doc_id, t.level + s.level, string_agg(s.node, '' order by s.place) filter (s.place < t.place // pow(3, s.level)::bigint),
    string_agg(s.node, '' order by s.place) filter (s.place > t.place // pow(3, s.level)::bigint)
  from docs d join tops t on t.source is not distinct from d.source join over_nodes s on s.n > 1 and s.place // 3 = t.place // pow(3, s.level + 1)::bigint
  group by d.doc_id, t.level + s.level),
climbed as (
  select doc_id, 0 as level, tampered as node from docs
  union all
  select c.doc_id, c.level + 1, sha256(coalesce(s.before, '') || c.node || coalesce(s.behind, '')) from climbed c join steps s on s.doc_id = c.doc_id and s.level = c.level),
ends as (select doc_id, arg_max(node, level) as folded_root from climbed group by doc_id),
told as (select doc_id, sha256(string_agg(coalesce(before, '') || coalesce(behind, ''), '' order by level)) as proof_sha256 from steps group by doc_id)
select d.doc_id, d.leaf, t.node as subroot, r.node as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.node as verified
from docs d join tops t on t.source is not distinct from d.source join ends e on e.doc_id = d.doc_id left join told p on p.doc_id = d.doc_id
cross join (select node from over_nodes where n = 1) r"""
