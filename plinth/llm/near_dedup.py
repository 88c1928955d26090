"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

A document's set is its distinct word shingles (A-Z lower-cased; the whole sequence where it has fewer words).
Two documents are linked when 100 * |intersection| >= similarity * |union|.

1. One pass makes, for each document, the size and a 128-bit fingerprint of its set, BANDS keys of ROWS MinHash
   samples each, and an odd sketch: a bitmap of SKETCH_BITS in which each (sample number, value) flips one bit.
   Documents with one fingerprint become one class, so exact copies cost one row from there on.
2. Classes that share a band key are candidates. At 80 % similarity a pair shares none of the 36 bands of 5 with
   a probability of 6e-7. First each bucket's members are compared with one leader only, the class with the most
   company over all its buckets. Pairs of far too high XOR population count are dropped by the sketch: at 180 samples
   the bound drops a pair at 80 % with a probability of 1.5e-7 (samples and parity collisions), less than the bands do.
3. The rest are confirmed on the full sets, from the texts. Of the links to leaders a forest is kept, one link a class
   and those between leaders that share a member, and merged into components. Buckets that hold several components
   get DRAWN more leaders, others in each bucket, for members of other components: members of a large group share many
   buckets, and so meet many leaders at the cost of a few rows a bucket.
4. What buckets still hold several components after that is settled exactly, whatever their size: every class in them
   gives out the rarest of its shingles, so many that two sets of the wanted similarity share one of them at least (all
   sets take one order: by hashed counts over the classes in question, of a fixed size, then by hash). Pairs of
   different components that share such a shingle, have enough shingles left from there on and pass the sketch are
   confirmed. Texts that
   merely share a common passage have rare shingles of their own, and so never meet. So every candidate pair is either
   already connected, or compared, or proved to be too far apart: no bucket is capped, and no group is expanded.

Defined results: texts without words (or null) have the empty set and are linked with nothing; a doc_id that is
repeated with other texts is one document; rows without doc_id are components of their own, with a null
component_id; every row gets its own result row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import combine, fresh_name, held_bits, materialise, mix, released, span_hashes, table, text_slices, words

BANDS, ROWS = 36, 5
SKETCH_BITS = 512
SIMILARITY = 80
#: Estimated percent similarity below which a candidate pair is dropped unseen: at 80 %, with a probability of 1.5e-7.
SCREEN = 60
#: More leaders drawn for each bucket that still holds several components.
DRAWN = 2
#: Hashed counters of shingles, whatever the size of the input: 4 MB as sent to tasks.
COUNTERS = 1 << 22

_K = BANDS * ROWS
_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, _K, dtype=np.uint64)
_WORDS = SKETCH_BITS // 64
_SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    w = words(data, offs)
    h = span_hashes(data, w.start, w.end, lower=True)
    n = w.counts()
    grams = combine(*(h[k : len(h) - size + 1 + k] for k in range(size))) if len(h) >= size else h[:0]
    out = []
    for first, count in zip(w.first[:-1].tolist(), n.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(grams[first : first + count - size + 1]))
        elif count:
            whole = combine(*(h[first + k : first + k + 1] for k in range(count)))
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(h[:0])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The samples of nonempty sets, as (sets, _K) values of 64 bits."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), _K), np.uint64)
    buffer = np.empty_like(flat)
    for k in range(_K):
        np.multiply(flat, _MUL[k], out=buffer)
        buffer += _ADD[k]
        out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (sample number, value), as (sets, SKETCH_BITS / 64) words."""
    n = len(samples)
    spot = (mix(samples + np.arange(_K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)) % np.uint64(SKETCH_BITS)
    at = spot.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    bits = (np.bincount(at.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(bits, axis=1).view(np.uint64)


def _lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """One list for each row; rows that aren't full have an empty one."""
    bounds = np.concatenate(([0], np.cumsum(np.where(full, values.shape[1], 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel().view(np.int64)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                full = n > 0
                some = [s for s in sets if len(s)]
                if some:
                    samples = minhashes(some)
                    keys = samples.reshape(len(some), BANDS, ROWS)
                    bands = combine(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS)).copy(), *(keys[:, :, r] for r in range(ROWS)))
                    sketch = odd_sketches(samples)
                else:
                    bands, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((0, _WORDS), np.uint64)
                fps = [np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), *(pa.array(f) for f in fps), _lists(bands, full), _lists(sketch, full)], ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(run), _SIGNATURE)


def differing_bits(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(_WORDS)))


def most_bits(percent: int = SCREEN) -> int:
    """Expected XOR population count of sketches of sets of that similarity: n/2 (1 - (1 - 2/n)^(2k(1-J)))."""
    return round(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * _K * (1 - percent / 100))))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for batch in batches:
            a, row, linked = batch.column(0).to_pylist(), 0, []
            for _, data, offs in text_slices(batch, "text_b"):
                for own in shingle_sets(data, offs, shingle):
                    if a[row] != last_id or row == 0:
                        lead = np.frombuffer((batch.column(2)[row].as_py() or "").encode(), np.uint8)
                        last_id, last_set = a[row], shingle_sets(lead, np.array([0, len(lead)]), shingle)[0]
                    common = np.intersect1d(own, last_set, assume_unique=True).size
                    linked.append(common > 0 and 100 * common >= similarity * (own.size + last_set.size - common))
                    row += 1
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a long, b long")


def counters(texts: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are among texts, by COUNTERS hashed counters: four times the binary logarithm.

    Counts of 1 within a task are left out: this only orders shingles, and any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for _, data, offs in text_slices(batch):
                if len(found := np.concatenate(shingle_sets(data, offs, shingle))):
                    np.add.at(total, (found % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total > 1)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], ["slot", "n"])

    sums = texts.select("text").mapInArrow(released(run), "slot long, n long").groupBy("slot").agg((4 * F.log2(F.sum("n"))).cast("int").alias("level")).toPandas()
    out = np.zeros(COUNTERS, np.uint8)
    out[sums["slot"].to_numpy(np.int64)] = sums["level"].to_numpy(np.uint8)
    return out


def rarest(texts: DataFrame, levels: np.ndarray, shingle: int, similarity: int) -> DataFrame:
    """shingle, rep, component, weight, size, left: the rarest shingles of each text (rep, component, weight, text).

    There are as many as a set may lack of another one of the similarity, and one more, so two such sets share one of them
    at least; left is how many of the set's shingles are not before it in the order. Of the smaller of two sets, or of
    either if equally large, fewer do: those that have at least least_common() left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, shingle)
                first = [s[np.argsort(levels[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[: len(s) + (-similarity * len(s)) // 100 + 1]] for s in sets]
                n = np.array([len(f) * (len(s) > 0) for f, s in zip(first, sets, strict=True)])
                at, size = pa.array(np.repeat(np.arange(len(sets)), n)), np.repeat([len(s) for s in sets], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat = np.concatenate([f[:k] for f, k in zip(first, n, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(rows.column(c).take(at) for c in ("rep", "component", "weight")), pa.array(size.astype(np.int64)), pa.array(size - place)], ["shingle", "rep", "component", "weight", "size", "left"])

    return texts.select("rep", "component", "weight", "text").mapInArrow(released(run), "shingle long, rep long, component long, weight long, size long, left long")


def least_common(size_a: Column, size_b: Column, similarity: int) -> Column:
    """How many shingles two sets of these sizes have in common at the least, if they are similar."""
    return F.ceil(similarity * (size_a + size_b) / (100 + similarity))


def close_pairs(rare: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar by a rarest() shingle that they share, and their sketches.

    A shingle's rows of one component, that of the greatest weight, are compared with those of others only, so a
    shingle that a large component shares doesn't pair its members.
    """
    homes = rare.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.struct("weight", "component")).alias("home")).where("c0 <> c1").select("shingle", F.col("home.component").alias("home"))
    own = rare.join(homes, "shingle").join(classes.select("rep", "sketch"), "rep")
    own = own.withColumns({"at_home": F.col("component") == F.col("home"), "fit": F.col("left") >= least_common(F.col("size"), F.col("size"), similarity)})
    x, y = (own.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "size", "left", "at_home", "fit", "sketch")]) for side in "xy")
    once = F.col("at_home_y") | (F.col("rep_x") < F.col("rep_y"))
    smaller = (F.col("fit_x") & (F.col("size_x") <= F.col("size_y"))) | (F.col("fit_y") & (F.col("size_y") <= F.col("size_x")))
    reach = F.least("left_x", "left_y") >= least_common(F.col("size_x"), F.col("size_y"), similarity)
    met = x.where("not at_home_x").join(y, "shingle").where((F.col("component_x") != F.col("component_y")) & once & smaller & reach & (differing_bits("sketch_x", "sketch_y") <= most_bits()))
    return met.select(*_ordered(F.col("rep_x"), F.col("rep_y"))).distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents whose id is among ids, written once, and maybe of others: by a bitmap of fixed size.

    Spares the joins that follow a shuffle of every text; they drop the bitmap's false positives.
    """
    held = held_bits(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(batch.column(0).to_numpy(zero_copy_only=False))))

    return materialise(docs.selectExpr("cast(doc_id as long) as id", "text").where("id is not null").mapInArrow(released(run), "id long, text string"))


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of a link; links is read several times.

    Each round takes the smallest label among neighbours and then the label of that label, so the rounds grow with
    the logarithm of the longest shortest path. Labels are written between rounds.
    """
    both = links.selectExpr("a as u", "b as v").unionAll(links.selectExpr("b as u", "a as v"))
    both = materialise(both.where("u <> v").distinct())
    labels = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")).selectExpr("u as node", "c as component"))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "component": "c"}), "v").groupBy("u").agg(F.min("c").alias("c")).withColumnRenamed("u", "node")
        lower = labels.join(near, "node").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        following = materialise(lower.join(jump, "c").select("node", F.least("c", "further").alias("component"), "old"))
        if following.where("component <> old").isEmpty():
            return following.select("node", "component")
        labels = following.select("node", "component")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of class ids whose sketches don't rule them out."""
    sketch = classes.select("rep", "sketch")
    joined = pairs.join(sketch.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b").join(sketch.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a")
    return joined.where(differing_bits("sa", "sb") <= most_bits()).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def forest(links: DataFrame) -> DataFrame:
    """Links (a: leader, b) thinned to one for each b, and one for each pair of leaders that a b joins."""
    first = links.groupBy("b").agg(F.min("a").alias("first"))
    bridges = links.join(first, "b").where("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b")).distinct()
    return first.select(F.col("first").alias("a"), "b").unionAll(bridges)


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) after more links, which are followed between components, not nodes."""
    ends = [label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(between)
    moved = label.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return materialise(moved.unionAll(top.join(label, "node", "left_anti")))


def link_classes(classes: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """node, component over class ids, for those that have a link."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keys.join(buckets, "key"))
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    order = F.struct(-F.col("company"), F.xxhash64("rep"), "rep")
    leaders = members.join(company, "rep").groupBy("key").agg(F.min(order).alias("lead")).select("key", F.col("lead.rep").alias("lead"))
    pairs = members.join(leaders, "key").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tried = materialise(_screened(pairs, classes))
    links = materialise(confirmed(tried, texts_of(docs, tried.selectExpr("a as id").unionAll(tried.selectExpr("b as id"))), shingle, similarity))
    label = components(forest(links))

    def still_open(rows: DataFrame) -> DataFrame:
        """Rows (key, rep) of buckets that hold several components, with them."""
        named = rows.select("key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
        return materialise(named.join(several, "key").select("key", "rep", "component"))

    left = still_open(members.where("n > 2"))
    if left.isEmpty():
        return label
    texts = texts_of(docs, left.selectExpr("rep as id"))
    drawn = left.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("rep", "key", F.lit(k)), "rep", "component")).alias(f"l{k}") for k in range(DRAWN)])
    drawn = drawn.select("key", F.explode(F.array_distinct(F.array(*[F.struct(f"l{k}.rep", f"l{k}.component") for k in range(DRAWN)]))).alias("lead"))
    pairs = left.join(drawn, "key").where("component <> lead.component").select(*_ordered(F.col("rep"), F.col("lead.rep"))).distinct()
    added = materialise(confirmed(_screened(pairs, classes), texts, shingle, similarity))
    if not added.isEmpty():
        label = merged(label, added)
        left = still_open(left)

    named = left.select("rep", "component").distinct()
    named = texts.withColumnRenamed("id", "rep").join(named.join(named.groupBy("component").agg(F.count("*").alias("weight")), "component"), "rep")
    rare = materialise(rarest(named, counters(texts, shingle), shingle, similarity))
    added = materialise(confirmed(close_pairs(rare, classes, similarity), texts, shingle, similarity))
    return label if added.isEmpty() else merged(label, added)


def find(docs: DataFrame, shingle: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    sig = materialise(signatures(docs, shingle))
    grouped = sig.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "fp1", "fp2")
    classes = materialise(grouped.agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")))
    label = link_classes(classes, docs, shingle, similarity)
    named = classes.select("n_shingles", "fp1", "fp2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "fp1", "fp2", F.coalesce("component", "rep").alias("c"))
    out = sig.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["n_shingles", "fp1", "fp2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 80 %) the document of the smallest id stays.

    Of rows that repeat the staying doc_id, one stays. Rows without doc_id stay.
    """
    found = materialise(find(docs, shingle=5).where("doc_id is not null"))
    key, stays = fresh_name("id", docs.columns), fresh_name("stays", docs.columns)
    # ids that go, and ids that rows share: all other documents stay without a shuffle of their texts
    special = materialise(found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n"), F.bool_or("kept").alias(stays)).where(f"n > 1 or not {stays}"))
    held = held_bits(special, key)

    @F.pandas_udf("boolean")
    def perhaps(doc_id: pd.Series) -> pd.Series:
        return pd.Series(held(doc_id.to_numpy()))

    maybe = perhaps(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    sure = docs.where(F.col("doc_id").isNull() | ~maybe)
    rest = docs.where(F.col("doc_id").isNotNull() & maybe).join(special.drop("n"), F.col("doc_id") == F.col(key), "left")
    return sure.unionAll(rest.where(F.coalesce(F.col(stays), F.lit(True))).select(*docs.columns).dropDuplicates(["doc_id"]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
