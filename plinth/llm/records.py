"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

File format (all integers little-endian). A file is a run of frames:

    length   u64   bytes of the payload
    check    u32   masked CRC-32 of the 8 bytes of length
    payload        doc_id i64, flags u32 (1: doc_id is null; 2: ids are u32, else u16), then the ids
    check    u32   masked CRC-32 of the payload
    end      u8    0x0A

A checksum is masked by rotating it right by 15 bits and adding 0xA282EAD8, so that a checksum of data which
holds checksums stays strong. Ids are u16 wherever the vocabulary allows it.

Documents are dealt by range of doc_id and sorted within, so the part files in the order of their numbers hold
all documents in ascending doc_id order (null first, equal ids by a hash of the text). Spark's own writer commits the files
(a frame is the value of a row, 0x0A is the row's end), so lost or repeated tasks leave no half files, and any
file system that Spark knows will do. The index is a Parquet table beside the files: file, position, offset and
bytes of each frame, doc_id, tokens, tokens before it, and the CRC-32 of its ids as u32.

Defined results: a null or empty text is a sequence of the end id alone; repeated rows are each written; rows that repeat as
a whole are written in any order; a very long text is encoded in parts and makes one frame (below 2 GB); further columns
are not read, whatever their names; an empty table gives an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import released, table, text_slices, workspace
from plinth.llm.tokens import encoder, vocabulary

_NULL_ID, _WIDE = 1, 2
_INDEX = "part long, file string, position long, offset long, bytes long, doc_id long, n_tokens long, before long, ids_crc32 long"
_ARROW = pa.schema([("part", pa.int64()), ("file", pa.string()), ("position", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """A frame without its end byte, which the writer of rows adds."""
    payload = struct.pack("<qI", doc_id or 0, _NULL_ID * (doc_id is None) | _WIDE * wide) + ids.astype("<u4" if wide else "<u2", copy=False).tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def parse(data, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The frame at an offset: doc_id, ids as u32, and where the next frame begins. Damage raises ValueError."""
    (size,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or len(data) < at + 17 + size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged payload at {at}")
    doc_id, flags = struct.unpack_from("<qI", payload)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=12).astype("<u4")
    return None if flags & _NULL_ID else doc_id, ids, at + 17 + size


def write(docs: DataFrame, path: str, vocab: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs to path/data, then the index to path/index from what the files hold; returns the index."""
    spark = docs.sparkSession

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        wide = max(enc.size, end_id + 1) > 1 << 16
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                ids, bounds = enc.encode_ended(data, offs, end_id)
                ids = ids if wide else ids.astype("<u2")
                out = [frame(d, ids[i:j], wide) for d, i, j in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    # the bounds are sampled from the keys, so no text is among them; the row's number parts rows that repeat as a whole
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    dealt.select("doc_id", "text").mapInArrow(released(frames), "value binary").select(F.col("value").cast("string").alias("value")).write.text(f"{path}/data")
    scan(spark, f"{path}/data").write.parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The index of the record files below path, made by reading every frame and verifying its checksums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, data = batch.column(0)[at].as_py(), memoryview(batch.column(1)[at].as_buffer())
                part, here, before, out = int(name.split("part-", 1)[1].split("-", 1)[0]), 0, 0, []
                while here < len(data):
                    doc_id, ids, following = parse(data, here)
                    out.append((part, name, len(out), here, following - here, doc_id, len(ids), before, zlib.crc32(ids)))
                    here, before = following, before + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types, strict=True)], schema=_ARROW) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in _ARROW.types], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, _INDEX)


def starts(index: DataFrame) -> DataFrame:
    """The index with start: ids of all sequences before it. The totals are one row a file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, ids: all sequences below path, or those of the rows (file, offset) of wanted, in any order."""

    def whole(batches):
        for batch in batches:
            names = batch.schema.names
            for at in range(batch.num_rows):
                data, docs, out = memoryview(batch.column(names.index("content"))[at].as_buffer()), [], []
                if "offsets" in names:
                    places = batch.column(names.index("offsets"))[at].as_py()
                    found = [parse(data, o) for o in places]
                else:
                    found, here = [], 0
                    while here < len(data):
                        found.append(parse(data, here))
                        here = found[-1][2]
                for d, ids, _ in found:
                    docs.append(d)
                    out.append(ids.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if wanted is not None:
        files = files.join(wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets")), "file").select("content", "offsets")
    else:
        files = files.select("content")
    return files.mapInArrow(whole, "doc_id long, ids array<long>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "documents"), workspace(spark), vocabulary("byte_bpe_50k.json"), end_id=2)
    return starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")
