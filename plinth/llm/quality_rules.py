"""Quality rules: fixed counts of a text, and a calibrated logistic regression over hashed n-grams.

Features are hashed word unigrams and bigrams and 4-grams of characters, as shares of their kind in the text; the weights
are fitted on a bounded sample of labelled rows by Adam over sparse counts, the probability is calibrated on the
other half of it, and texts are scored in Arrow batches against fixed thresholds. The counts follow their exact
definitions over the whole text (see counts()).

Defined results: a null or empty text has counts of 0, fails the base rules and has the probability of the
intercept; with fewer than MIN_ROWS rows of a class the probability is the share of good labels (1 without labels, so
that the base rules alone decide). Repeated rows get a row each; a very long text takes time and memory in proportion;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import code_points, combine, mix, released, span_hashes, table, text_slices, words
from plinth.llm.samples import Sample, labelled_sample, logistic, shift, sigmoid

BITS = 17
CHARS = 4
KINDS = 3
THRESHOLD = 0.3
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_ROWS = 8
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, KINDS * 2**BITS, or empty
    slope: float
    intercept: float
    prior: float


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(data: np.ndarray, offs: np.ndarray, w, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: feature numbers of a slice in text order, and the bounds of each text's."""
    shift, size = np.uint64(64 - BITS), 1 << BITS
    out = [((hashes >> shift).astype(np.int32), w.first)]
    pairs = combine(hashes[:-1], hashes[1:])[w.doc[:-1] == w.doc[1:]] if len(hashes) else hashes
    n = np.maximum(w.counts() - 1, 0)
    out.append(((pairs >> shift).astype(np.int32) + size, np.concatenate(([0], np.cumsum(n)))))
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    first = code_points(data)[offs]
    n = np.maximum(np.diff(first) - CHARS + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    inside = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    mixed = np.zeros(max(0, len(chars) - CHARS + 1), np.uint32)
    for k in range(CHARS):
        mixed = (mixed ^ chars[k : k + len(mixed)]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    out.append((((mixed[inside] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32) + 2 * size, bounds))
    return out


def raw_scores(found: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return sum(_segment_sums(weights[f], b) / np.maximum(1, np.diff(b)) for f, b in found)


def fit(sample: Sample, epochs: int = 40, rate: float = 1.0, ridge: float = 1e-6) -> Model:
    rows = sample.rows
    y = rows["y"].to_numpy(int) if len(rows) else np.zeros(0, int)
    prior = 1.0 if sample.share is None else float(sample.share)
    build = np.array([zlib.crc32(f"half {i}".encode()) % 2 == 0 for i in rows["doc_id"]], bool)
    none = np.zeros(0, np.float32)
    if min((y[build] == 0).sum(), (y[build] == 1).sum(), (y[~build] == 0).sum(), (y[~build] == 1).sum()) < MIN_ROWS // 2:
        return Model(none, 0.0, 0.0, prior)
    cols, vals, owner = [], [], []
    for i, text in enumerate(rows["text"]):
        data = np.frombuffer(text.encode(), np.uint8)
        offs = np.array([0, len(data)])
        w = words(data, offs)
        for f, _ in features(data, offs, w, span_hashes(data, w.start, w.end)):
            c, n = np.unique(f, return_counts=True)
            cols.append(c)
            vals.append((n / max(1, len(f))).astype(np.float32))
            owner.append(np.full(len(c), i, np.int32))
    cols, vals, owner = np.concatenate(cols), np.concatenate(vals), np.concatenate(owner)
    inside = build[owner]
    c, v, o = cols[inside], vals[inside], owner[inside]
    size = KINDS << BITS
    weights, m, s, bias = np.zeros(size), np.zeros(size), np.zeros(size), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y[build] == 1).sum()), 0.5 / max(1, (y[build] == 0).sum())) * build
    for step in range(1, epochs + 1):
        r = (sigmoid(np.bincount(o, weights[c] * v, len(y)) + bias) - y) * share
        g = np.bincount(c, r[o] * v, size) + ridge * weights
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        bias -= r.sum()
    raw = np.bincount(owner, weights[cols] * vals, len(y))
    slope, intercept = logistic(raw[~build, None], y[~build])
    return Model(weights.astype(np.float32), float(slope), float(intercept) + shift(y[~build]), prior)


def repeated_words(doc: np.ndarray, hashes: np.ndarray, window: int = 3) -> np.ndarray:
    """Which words are in windows (of words of one text) that the text has twice or more."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) >= window:
        grams = combine(*(hashes[k : len(hashes) - window + 1 + k] for k in range(window)))
        at = np.flatnonzero(doc[: len(grams)] == doc[window - 1 :])
        keys = mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            spot = np.searchsorted(twice, keys)
            hit = at[(spot < len(twice)) & (twice[np.minimum(spot, len(twice) - 1)] == keys)]
            for k in range(window):
                out[hit + k] = True
    return out


def counts(data: np.ndarray, offs: np.ndarray, w, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words; word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word that
    equal an earlier line; n_repeat_words: words in three-word windows that the text has twice or more."""
    points = code_points(data)
    per = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOLS[data], out=per[1:])
    chars = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(points[w.end] - points[w.start], out=chars[1:])
    rep = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(repeated_words(w.doc, hashes), out=rep[1:])
    # lines: cut at each line end and at each text's end
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((breaks + 1, offs[:-1])))
    end = np.sort(np.concatenate((breaks, offs[1:])))
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(breaks, offs)) + 1)
    solid = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    start, end, owner = start[solid], end[solid], owner[solid]
    keys = mix(span_hashes(data, start, end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.unique(keys, return_index=True)[1]
    dup = np.bincount(owner, minlength=len(offs) - 1) - np.bincount(owner[distinct], minlength=len(offs) - 1)
    return {"n_words": w.counts(), "word_chars": np.diff(chars[w.first]), "n_symbols": np.diff(per[offs]), "n_dup_lines": dup, "n_repeat_words": np.diff(rep[w.first])}


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                w = words(data, offs)
                hashes = span_hashes(data, w.start, w.end)
                cols = counts(data, offs, w, hashes)
                if len(model.weights):
                    p = sigmoid(raw_scores(features(data, offs, w, hashes), model.weights) * model.slope + model.intercept)
                else:
                    p = np.full(rows.num_rows, model.prior)
                failed = (cols["n_words"] < MIN_WORDS) | (100 * cols["n_repeat_words"] > MAX_REPEATED * cols["n_words"])
                arrays = [rows.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols.values()), pa.array(failed), pa.array(p.astype(float)), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *cols, "base_failed", "probability", "kept"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))
