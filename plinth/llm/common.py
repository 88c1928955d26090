"""What the corpus operators share: reading tables, cutting lineage, and walking texts in Arrow batches.

Texts are walked as the UTF-8 bytes that Arrow holds, with numpy, in slices of bounded bytes: a slice holds
whole texts only, so nothing is ever cut to fit. White space is the ASCII set of the words pattern
``[^\\x20\\x09-\\x0D]+``; no byte of a multi-byte character is in it, so working on bytes is exact.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at once. A longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: texts of 100 kB then make batches of 50 MB, where Spark's own 10,000 rows make 1 GB.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, if they are more; it stays so, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names in spark.checkpoint.dir.

    Where the setting is missing, one machine's own session (master local) takes a folder of its warehouse; any
    other session has to name a folder that its executors share.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_plinth_work"
    return f"{base.rstrip('/')}/plinth-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and return a reader of it; lineage ends there.

    The files outlive lost executors. They stay until the folder is emptied, as checkpoints do.
    """
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `most` bytes of text (or one row), as (rows, bytes, offsets). Null texts are empty."""
    at = batch.schema.get_field_index(column)
    col = batch.column(at)
    if col.null_count:
        col = col.fill_null("")
        batch = batch.set_column(at, batch.schema.field(at), col)
    offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to SLICE_BYTES."""
    if not _powers:
        for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(SLICE_BYTES + 1, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def hand_back() -> None:
    """Give the memory that this process has freed back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def released(run: Callable) -> Callable:
    """run, a function over Arrow batches, whose task hands its freed memory back at the end: workers live on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


#: Bits of held_bits(): 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


def _spots(*keys: np.ndarray) -> np.ndarray:
    return (combine(*(k.astype(np.int64).view(np.uint64) for k in keys)) % np.uint64(FILTER_BITS)).astype(np.int64)


def held_bits(df: DataFrame, *columns: str) -> Callable[..., np.ndarray]:
    """A function that tells which keys (arrays of the long columns) may be rows of df: by a bitmap of FILTER_BITS.

    It goes out with tasks to spare a shuffle most of the rows that its join would drop; the join drops the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_spots(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["word", "bits"])

    keys = df.select(*[F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(columns)])
    found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    filled = filled.view(np.uint8)

    def held(*keys: np.ndarray) -> np.ndarray:
        at = _spots(*keys)
        return (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return held


def fresh_name(wish: str, taken: Iterable[str]) -> str:
    """A column name like wish that is none of those taken, whatever their case."""
    low, name, k = {c.lower() for c in taken}, f"_{wish}", 0
    while name.lower() in low:
        k += 1
        name = f"_{wish}{k}"
    return name


@dataclass
class Words:
    """The words of a slice of texts: byte spans, the text each is in, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _WHITE) -> Words:
    """The words of a slice; between says for each byte whether it parts words."""
    solid = ~between[data]
    if not solid.size:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(offs), np.int64))
    full = offs[1:] > offs[:-1]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    begins[heads] = solid[heads]
    ends[tails] = solid[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs, "left")
    return Words(start, end, np.repeat(np.arange(len(offs) - 1), np.diff(first)), first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans (in order of their starts, none inside of another), by polynomial prefix sums.

    A slice above SLICE_BYTES is summed in parts of half of that, so memory is bounded by the spans' number; a span
    longer than a part is hashed part by part, with the powers carried on.
    """
    codes = _BYTES[_LOWER] if lower else _BYTES
    if len(data) <= SLICE_BYTES:
        return mix(_sums(data, start, end, codes) + (end - start).astype(np.uint64))
    part, out = SLICE_BYTES // 2, np.empty(len(start), np.uint64)
    long = end - start > part
    short = np.flatnonzero(~long)
    cuts = np.searchsorted(start[short], np.arange(0, len(data) + part, part))
    for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        own, base = short[i:j], k * part
        if len(own):
            out[own] = _sums(data[base : base + 2 * part], start[own] - base, end[own] - base, codes)
    zero = np.zeros(1, np.int64)
    for k in np.flatnonzero(long).tolist():
        total = 0
        for at in range(int(start[k]), int(end[k]), part):
            piece = data[at : min(at + part, int(end[k]))]
            total += int(_sums(piece, zero, zero + len(piece), codes)[0]) * pow(int(_BASE), at - int(start[k]), 1 << 64)
        out[k] = total & ((1 << 64) - 1)
    return mix(out + (end - start).astype(np.uint64))


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    up, down = _power_tables()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p + np.uint64(0x2545F4914F6CDD1D))
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end), the code points before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
