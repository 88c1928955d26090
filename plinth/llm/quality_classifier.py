"""Quality classifier by compression: which dictionary, of good or of bad texts, makes a text smaller.

Two zstandard dictionaries are built, from blocks of good and of bad labelled texts. A text is compressed in
blocks of BLOCK bytes, each with either dictionary alone, so that a long text is measured throughout and not
only until the compressor has its own history. The difference of the sizes over the bytes (of the whole text,
of its worst and of its best block) becomes a probability by logistic calibration on labelled rows that the
dictionaries were not built from.

Fitting uses a bounded sample (samples.ROWS_PER_CLASS rows a class, of long texts windows); the intercept is then moved
from the sample's share of good rows to samples.REFERENCE_SHARE, so scores don't move with the table's size. Scoring
covers every text whole, block by block. A model is some 70 kB and goes out with the tasks.

Defined results: a null or empty text has differences of 0 and the score that the calibration gives those; with
fewer than MIN_ROWS rows of either class, or texts too few for a dictionary, every score is the share of good labels
(0.5 without labels). Repeated rows are scored each; score() replaces an input column of the score's name, accept() keeps
every input column. A very long text takes time and memory in proportion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from plinth.llm.common import fresh_name, released, table, text_slices
from plinth.llm.samples import Sample, held_out, labelled_sample, logistic, shift, sigmoid

BLOCK = 1024
DICTIONARY_BYTES = 32_768
LEVEL = 3
THRESHOLD = 0.3
MIN_ROWS = 8


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """For each text: bytes saved by the good dictionary against the bad one, a byte of text; then of the worst and best block."""
    g, b = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if text:
            parts = blocks(text)
            d = np.array([len(b(x)) - len(g(x)) for x in parts], float)
            n = np.array([len(x) for x in parts], float)
            each = d / (n + 32)
            out[i] = d.sum() / (n.sum() + 32), each.min(), each.max()
    return out


def fit(sample: Sample) -> Model:
    """A model from a labelled sample; half of it (by crc32 of doc_id) builds the dictionaries."""
    rows = sample.rows
    y = rows["y"].to_numpy(int) if len(rows) else np.zeros(0, int)
    prior = 0.5 if sample.share is None else float(sample.share)
    texts = [t.encode() for t in rows["text"]]
    build = np.array([zlib.crc32(f"half {i}".encode()) % 2 == 0 for i in rows["doc_id"]], bool)
    if min((y[build] == 0).sum(), (y[build] == 1).sum(), (y[~build] == 0).sum(), (y[~build] == 1).sum()) < MIN_ROWS // 2:
        return Model(b"", b"", (), prior)
    try:
        made = [zstandard.train_dictionary(DICTIONARY_BYTES, [x for t, k in zip(texts, build & (y == c), strict=True) if k for x in blocks(t)], level=LEVEL).as_bytes() for c in (1, 0)]
    except zstandard.ZstdError:
        return Model(b"", b"", (), prior)
    x = differences([t for t, k in zip(texts, ~build, strict=True) if k], *made)
    weights = logistic(x * 10, y[~build])
    weights[-1] += shift(y[~build])
    return Model(made[0], made[1], tuple(weights), prior)


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    w = np.array(model.weights)
    return sigmoid(differences(texts, model.good, model.bad) * 10 @ w[:-1] + w[-1])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the column score, from one pass in Arrow batches."""
    names = [c for c in docs.columns if c.lower() != column.lower()]
    schema = StructType([*docs.select(*names).schema.fields]).add(column, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch, text):
                raw = data.tobytes()
                s = score_texts([raw[i:j] for i, j in zip(offs[:-1], offs[1:], strict=True)], model)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], [*rows.schema.names, column])

    return docs.select(*names).mapInArrow(released(run), schema)


def fit_on(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    return fit(labelled_sample(docs, labels, **bounds))


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below THRESHOLD go; the columns stay those of docs."""
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    column = fresh_name("quality_score", docs.columns)
    return score(docs, model, column=column).where(F.col(column) >= THRESHOLD).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
