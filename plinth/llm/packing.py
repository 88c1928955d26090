"""Best-fit packing of token sequences, in bulk-synchronous sweeps over documents and gaps sorted by size.

Sizes are whole numbers up to the capacity (2048), so the range sort of documents and of gaps is a count for
each size, and a sweep handles every document of one size, and every sequence with one gap, at once:

1. Each task encodes its texts, cuts what is too long, and ranks its pieces within each length. The pieces
   (without ids) are written once.
2. Counts by (task, length) give each task's first rank in a length, and each length's count.
3. Supersteps, longest first: all documents of a length look for their successor, the smallest gap that holds
   them; ranks resolve who gets which sequence; gaps are updated; what finds no gap opens sequences. A
   superstep handles ranges of ranks and of sequences, never single documents, so the plan's size depends on the
   capacity alone.
4. A piece finds its place from its length and rank by binary search in the plan.

Only the counts (at most 2048) and the plan are on the driver. Defined results: a null or empty text is the end
id alone; repeated rows are packed each; pieces of one length are interchangeable, so ties change no sequence's fill; a
very long text is encoded in parts; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import materialise, released, table, text_slices
from plinth.llm.tokens import encoder, vocabulary

CAPACITY = 2048
_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]


def _ranks(length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each piece's rank among those of its length, on from the counts before, which are brought up to date."""
    order = np.argsort(length, kind="stable")
    size = length[order]
    first = np.flatnonzero(np.diff(size, prepend=-1))
    counts = np.diff(np.append(first, len(size)))
    out = np.empty(len(length), np.int64)
    out[order] = before[size] + np.arange(len(size)) - np.repeat(first, counts)
    before[size[first]] += counts
    return out


def pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its rank among its task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocab), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                ids, bounds = enc.encode_ended(data, offs, end_id)
                parts = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(parts)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = bounds[doc] + piece * capacity
                length = np.minimum(bounds[doc + 1] - first, capacity)
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(first.tolist(), length.tolist(), strict=True)]
                cols = (rows.column("doc_id").take(pa.array(doc)), piece, piece * capacity, length, crc, np.full(len(doc), task), _ranks(length, ranks))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, _PIECES, strict=True)], [n for n, _ in _PIECES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan: rows (length, first rank, end rank, first sequence, offset); rank r goes to first sequence + r - first rank."""
    plan, opened = [], 0
    gaps: list[int] = []  # sizes of gaps at hand, sorted
    holders: dict[int, list[tuple[int, int]]] = {}  # gap size -> ranges (first sequence, sequences)

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in holders:
                holders[gap] = []
                insort(gaps, gap)
            holders[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no successor: what is left opens sequences
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = holders[gap].pop()
            if not holders[gap]:
                del holders[gap], gaps[at]
            each = gap // length
            whole = min(n, left // each)
            for j in range(each if whole else 0):
                plan.append((length, rank, rank + whole, first, capacity - gap + j * length))
                rank += whole
            put(gap - each * length, first, whole)
            left -= whole * each
            first, n = first + whole, n - whole
            if n and 0 < left < each:
                for j in range(left):
                    plan.append((length, rank, rank + 1, first, capacity - gap + j * length))
                    rank += 1
                put(gap - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(gap, first, n)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a table that is read, not computed, each time) with sequence_id and offset."""
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    plan = supersteps({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    span = int(plan[:, 2].max()) + 1 if len(plan) else 1
    keys = plan[:, 0] * span + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, rank = (cols[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            cols["sequence_id"] = pa.array(plan[at, 3] + rank - plan[at, 1])
            cols["offset"] = pa.array(plan[at, 4])
            del cols["rank"]
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    ranked = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, vocab, end_id, capacity)), capacity)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
