"""Benchmark decontamination: latent semantic retrieval of passages, then longest common subsequence and answers.

Words are folded (A-Z and Latin-1 capitals lower-cased, ASCII signs parting words), so case and signs hide nothing.

1. One pass counts, over all documents, in how many each word of the benchmark occurs (IDF).
2. Terms are the benchmark's informative words: in at most MAX_SHARE of documents, and in any case the rarest
   TERMS_EACH of each item. Passages are windows of WINDOW words, weighted by TF-IDF.
3. A randomised SVD of the passage-term matrix (windows side by side over the whole corpus, all that hold MIN_TERMS
   terms or more, and the benchmark's own) gives the latent space. A product X'(XQ) with RANK + OVER random columns,
   summed over tasks in a tree, gives an orthonormal range Q; a second one gives the small matrix Q'X'XQ, whose
   eigenvectors turn Q into singular vectors, of which the RANK of largest singular values stay. The matrices, terms by
   RANK + OVER, are bounded by the benchmark. Items are kept in blocks of MAX_ITEMS, so a
   large benchmark is a query set against all rows, in blocks.
4. In one pass over the texts, two sets of candidates: windows at every STRIDE-th word are projected, and those with a
   cosine of at least COSINE to a benchmark passage are taken; and, exactly, every place that shares a run of RUN words
   (or a shorter passage's all) with a passage, by hashes of all runs. Either is verified there and then, on the words
   around: by the longest common subsequence (bit-parallel), by a shared run of RUN words, or by a weaker subsequence
   along with the item's answer (its last sentence). So no verbatim run is lost by the latent space; what shares no run
   (subsequences, answers) depends on it.

Nothing of the corpus goes to the driver but counts and sums over the benchmark's terms. Defined results: null or empty
texts match nothing; items without a word are left out; repeated rows are judged each; an empty table gives no rows, with an
empty benchmark nothing matches; a very long text is searched whole, in memory in proportion to its words; further columns
are kept by drop_contaminated(), whatever their names, and not read by matches().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import _LOWER, combine, materialise, released, span_hashes, table, text_slices, words

WINDOW, STRIDE = 64, 16
#: Longer items are cut into passages of this many words; each stands for the item.
ITEM_WORDS = 48
MAX_SHARE = 0.01
TERMS_EACH = 8
RANK = 256
#: Columns that the sketch has besides, which the small decomposition drops again.
OVER = 32
#: Partial sums that one task adds up at a time.
FAN_IN = 64
COSINE = 0.4
#: Terms that a corpus passage holds at least (or as many as the poorest benchmark passage has, if fewer).
MIN_TERMS = 3
#: Shares of a benchmark passage's words: as a common subsequence alone, and along with the answer.
LCS_ALONE, LCS_WITH_ANSWER = 0.7, 0.5
RUN = 13
MAX_ITEMS = 4096

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[c for c in range(128) if not chr(c).isalnum()]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals of Latin-1 (C3 80 to C3 9E but C3 97, in UTF-8)."""
    out = _LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3)
    follow = out[lead + 1]
    out[lead[(follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1] += 0x20
    return out


def folded_words(data: np.ndarray, offs: np.ndarray):
    data = fold(data)
    w = words(data, offs, _BETWEEN)
    return w, span_hashes(data, w.start, w.end)


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return folded_words(data, np.array([0, len(data)]))[1]


class Lookup:
    """Numbers of known hashes, -1 for others; a bitmap on the leading bits spares most searches."""

    def __init__(self, known: np.ndarray):
        self.known = known  # sorted
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(known >> np.uint64(44)).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known hashes are, and their numbers."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit = self.known[number] == hashes[at]
        return at[hit], number[hit]


@dataclass(frozen=True)
class Passage:
    """A benchmark passage: its item, words, and the item's answer words."""

    item: int
    words: np.ndarray
    answer: np.ndarray


def benchmark_passages(rows: list[tuple[int, str]]) -> list[Passage]:
    out = []
    for item, text in rows:
        h = hashes_of(text or "")
        sentences = [s for s in (hashes_of(x) for x in re.split(r"[.!?]\s|\n", text or "")) if len(s)]
        answer = sentences[-1] if len(sentences) > 1 else h[:0]
        n = max(1, -(-len(h) // ITEM_WORDS))
        size = -(-len(h) // n)
        out += [Passage(item, h[i : i + size], answer) for i in range(0, len(h), size or 1)]
    return out


def windows(doc: np.ndarray, first: np.ndarray, at: np.ndarray, term: np.ndarray, least: int = MIN_TERMS, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of term occurrences (at: word numbers of a slice), per passage and term: passage number, term, count; and each
    passage's first word. Passages begin at every stride-th word of a text; those of fewer than least terms are left out."""
    inside = at - first[doc[at]]
    steps = WINDOW // stride
    start = (inside // stride)[:, None] - np.arange(steps)
    ok = start >= 0
    key = (first[doc[at]][:, None] + start * stride)[ok]
    who = np.broadcast_to(term[:, None], start.shape)[ok]
    pairs, counts = np.unique(key * (1 << 24) + who, return_counts=True)
    begin, who = pairs >> 24, pairs & ((1 << 24) - 1)
    some = np.flatnonzero(np.diff(np.concatenate(([-1], begin))))
    size = np.diff(np.concatenate((some, [len(begin)])))
    keep = np.repeat(size >= least, size)
    passage = np.repeat(np.arange(len(size)), size)[keep]
    passage = np.cumsum(np.concatenate(([0], np.diff(passage) > 0))) if len(passage) else passage
    return passage, who[keep], counts[keep], begin[some[size >= least]]


def weighted(passage: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length for each passage."""
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(passage, w * w))
    return w / norm[passage]


def _products(passage: np.ndarray, term: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X'(Xq) for the passages of one batch."""
    starts = np.flatnonzero(np.diff(np.concatenate(([-1], passage))))
    y = np.add.reduceat(q[term] * weight[:, None], starts, axis=0)
    order = np.argsort(term, kind="stable")
    t = term[order]
    firsts = np.flatnonzero(np.diff(np.concatenate(([-1], t))))
    out = np.zeros_like(q)
    out[t[firsts]] = np.add.reduceat(y[passage[order]] * weight[order][:, None], firsts, axis=0)
    return out


@dataclass
class Latent:
    """What a task needs: terms (sorted hashes), their idf, the projection, and the benchmark passages with their vectors."""

    terms: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    passages: list[Passage]
    vectors: np.ndarray
    least: int


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each word occurs, and the number of texts: sums over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total, n = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, data, offs in text_slices(batch):
                w, h = folded_words(data, offs)
                at, number = look.positions(h)
                total += np.bincount(np.unique(w.doc[at] * len(vocabulary) + number) % len(vocabulary), minlength=len(vocabulary))
                n += len(offs) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["word", "n"])

    sums = docs.select("text").mapInArrow(released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    words_ = sums[sums.word >= 0]
    out[words_.word.to_numpy()] = words_.n.to_numpy()
    return out, int(sums[sums.word < 0].n.sum())


def corpus_passages(docs: DataFrame, terms: np.ndarray, least: int) -> DataFrame:
    """The passage-term counts of all documents (windows side by side), a binary row for each slice of texts that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(terms)
        for batch in batches:
            for _, data, offs in text_slices(batch):
                w, h = folded_words(data, offs)
                at, number = look.positions(h)
                if len(at):
                    p, t, c, _ = windows(w.doc, w.first, at, number, least, WINDOW)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (p, t, np.minimum(c, WINDOW))], ["passage", "term", "count"])

    return docs.select("text").mapInArrow(released(run), "passage binary, term binary, count binary")


def _summed(found: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X'(Xq) over all corpus passages: one partial matrix a task, cut in strips of terms, summed by strip."""
    strip, shape, narrow = 256, q.shape, q.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape, np.float32), False
        for batch in batches:
            for p, t, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p, t, c = (np.frombuffer(x, "<i4") for x in (p, t, c))
                total += _products(p, t, weighted(p, t, c, idf).astype(np.float32), narrow)
                any_rows = True
        if any_rows:
            parts = range(0, shape[0], strip)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([total[i : i + strip].tobytes() for i in parts], pa.binary())], ["strip", "part"])

    def add(strips: pa.Table) -> pa.Table:
        total = np.zeros(len(strips.column("part")[0].as_buffer()) // 4)
        for x in strips.column("part"):
            total += np.frombuffer(x.as_buffer(), "<f4")
        return pa.table({"strip": strips.column("strip")[:1].combine_chunks(), "branch": strips.column("branch")[:1].combine_chunks(), "part": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    level, branches = found.mapInArrow(released(run), "strip long, part binary").withColumn("branch", F.spark_partition_id().cast("long")), found.rdd.getNumPartitions()
    while branches > 1:
        level, branches = level.withColumn("branch", F.expr(f"branch div {FAN_IN}")).groupBy("strip", "branch").applyInArrow(add, "strip long, branch long, part binary"), -(-branches // FAN_IN)
    out = np.zeros(shape)
    for row in level.collect():
        part = np.frombuffer(row["part"], "<f4").reshape(-1, shape[1])
        out[row["strip"] : row["strip"] + len(part)] += part
    return out


def _rows_of(passages: list[Passage], look: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, t, c = [], [], []
    for i, x in enumerate(passages):
        number, count = np.unique(look.positions(x.words)[1], return_counts=True)
        p.append(np.full(len(number), i))
        t.append(number)
        c.append(count)
    return np.concatenate(p), np.concatenate(t), np.concatenate(c)


def fit(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> Latent | None:
    """The latent space of all of docs for a block of benchmark items; None if no item has a word."""
    passages = [p for p in benchmark_passages(items) if len(p.words)]
    if not passages:
        return None
    vocabulary = np.unique(np.concatenate([p.words for p in passages]))
    df, n = document_frequencies(docs, vocabulary)
    informative = df <= MAX_SHARE * n
    for p in passages:
        own = np.searchsorted(vocabulary, np.unique(p.words))
        informative[own[np.argsort(df[own], kind="stable")[:TERMS_EACH]]] = True
    terms, idf = vocabulary[informative], np.log((n + 1) / (df[informative] + 1)) + 1
    p, t, c = _rows_of(passages, Lookup(terms))
    own = weighted(p, t, c, idf)
    rank, wide = min(rank, len(terms)), min(rank + OVER, len(terms))
    least = min(MIN_TERMS, int(np.bincount(p, minlength=len(passages)).min()))
    found = materialise(corpus_passages(docs, terms, least))
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(terms), wide)))[0]
    q = np.linalg.qr(_summed(found, idf, q) + _products(p, t, own, q))[0]
    small = q.T @ (_summed(found, idf, q) + _products(p, t, own, q))
    q = q @ np.linalg.eigh((small + small.T) / 2)[1][:, : -rank - 1 : -1]  # by falling singular value
    vectors = np.zeros((len(passages), rank))
    np.add.at(vectors, p, q[t] * own[:, None])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Latent(terms, idf, q.astype(np.float32), passages, vectors.astype(np.float32), least)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    return combine(*(h[k : len(h) - n + 1 + k] for k in range(n))) if len(h) >= n else h[:0]


def _grams(h: np.ndarray, n: int) -> set[int]:
    return set(_run_hashes(h, n).tolist())


def _holds(text: np.ndarray, part: np.ndarray) -> bool:
    return len(part) > 0 and not _grams(part, len(part)).isdisjoint(_grams(text, len(part)))


class Runs:
    """All runs of min(RUN, length) words of the passages, by length: sorted hashes, and who holds each where."""

    def __init__(self, passages: list[Passage]):
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, p in enumerate(passages):
            n = min(RUN, len(p.words))
            found.setdefault(n, []).append((_run_hashes(p.words, n), k))
        self.by_length = []
        for n, parts in sorted(found.items()):
            hashes = np.concatenate([g for g, _ in parts])
            order = np.argsort(hashes, kind="stable")
            who = np.concatenate([np.full(len(g), k) for g, k in parts])[order]
            where = np.concatenate([np.arange(len(g)) for g, _ in parts])[order]
            known, first = np.unique(hashes[order], return_index=True)
            self.by_length.append((n, Lookup(known), np.append(first, len(order)), who, where))

    def hits(self, h: np.ndarray, doc: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Rows of text, passage and the word number where the passage would begin, each once; known: words of any passage."""
        out = [np.zeros((0, 3), np.int64)]
        ahead = np.concatenate((known.cumsum(), [0]))  # ahead[-1] is what stands before the first word
        for n, look, first, who, where in self.by_length:
            if len(h) < n:
                break
            start = np.arange(len(h) - n + 1)
            start = start[(ahead[start + n - 1] - ahead[start - 1] == n) & (doc[start] == doc[start + n - 1])]
            if not len(start):
                continue
            at, number = look.positions(combine(*(h[start + i] for i in range(n))))
            times = first[number + 1] - first[number]
            row = np.repeat(first[number] - np.concatenate(([0], times.cumsum()[:-1])), times) + np.arange(times.sum())
            out.append(np.unique(np.column_stack((np.repeat(doc[start[at]], times), who[row], np.repeat(start[at], times) - where[row])), axis=0))
        return np.concatenate(out)


class Matcher:
    def __init__(self, latent: Latent):
        self.latent, self.look = latent, Lookup(latent.terms)
        self.runs = [_grams(p.words, min(RUN, len(p.words))) for p in latent.passages]
        self.exact, self.vocabulary = Runs(latent.passages), Lookup(np.unique(np.concatenate([p.words for p in latent.passages])))

    def _verified(self, w, h: np.ndarray, doc: int, first: int, k: int) -> tuple[float, bool, bool] | None:
        """Share of the subsequence, whether a run and whether the answer, on the words around first; None if too little."""
        own = self.latent.passages[k]
        text = h[max(w.first[doc], first - STRIDE) : min(w.first[doc + 1], first + WINDOW + max(STRIDE, len(own.words)))]
        common = lcs(own.words, text)
        share = common / len(own.words)
        run = common >= min(RUN, len(own.words)) and not self.runs[k].isdisjoint(_grams(text, min(RUN, len(own.words))))
        answer = share >= LCS_WITH_ANSWER and _holds(text, own.answer)
        return (share, run, answer) if run or (share >= LCS_ALONE and len(own.words) > RUN) or answer else None

    def _cosine(self, words_: np.ndarray, k: int) -> float:
        number, count = np.unique(self.look.positions(words_)[1], return_counts=True)
        y = ((1 + np.log(count)) * self.latent.idf[number]) @ self.latent.basis[number]
        return float(y @ self.latent.vectors[k] / max(np.linalg.norm(y), 1e-9))

    def slice(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, float, float, int, bool]]:
        """Matches of a slice: text number, benchmark passage, cosine, share of the subsequence, whether a run, whether the answer."""
        w, h = folded_words(data, offs)
        known = np.zeros(len(h), bool)
        known[self.vocabulary.positions(h)[0]] = True
        for doc, k, first in self.exact.hits(h, w.doc, known).tolist():
            if found := self._verified(w, h, doc, first, k):
                yield doc, k, self._cosine(h[max(w.first[doc], first) : min(w.first[doc + 1], first + WINDOW)], k), *found
        at, number = self.look.positions(h)
        if not len(at):
            return
        p, t, c, begin = windows(w.doc, w.first, at, number, self.latent.least)
        if not len(p):
            return
        weight = weighted(p, t, c, self.latent.idf).astype(np.float32)
        starts = np.flatnonzero(np.diff(np.concatenate(([-1], p))))
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            end = starts[lo + 4096] if lo + 4096 < len(starts) else len(p)
            y = np.add.reduceat(self.latent.basis[t[part[0] : end]] * weight[part[0] : end, None], part - part[0], axis=0)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
            cosines = y @ self.latent.vectors.T
            for row, k in zip(*np.nonzero(cosines >= COSINE), strict=True):
                first = int(begin[lo + row])
                doc = int(w.doc[first])
                if found := self._verified(w, h, doc, first, k):
                    yield doc, int(k), float(cosines[row, k]), *found


def blocks_of(items: DataFrame, id_column: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most MAX_ITEMS items, by a hash of id and text."""
    rows = items.select(F.col(id_column).cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates()
    n = max(1, -(-rows.count() // MAX_ITEMS))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, shared_run, answer_found: the best match of each row of docs with each item."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, shared_run boolean, answer_found boolean"
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(items):
        latent = fit(docs, block)
        if latent is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], latent=latent) -> Iterator[pa.RecordBatch]:
            m = Matcher(latent)
            for batch in batches:
                for part, data, offs in text_slices(batch):
                    ids, best = part.column("doc_id").to_pylist(), {}
                    for doc, k, *found in m.slice(data, offs):
                        key = doc, latent.passages[k].item
                        best[key] = [max(a, b) for a, b in zip(best.get(key, found), found, strict=True)]
                    if best:
                        cols = list(zip(*((ids[d], i, *v) for (d, i), v in best.items()), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "shared_run", "answer_found"])

        out = out.unionAll(rows.mapInArrow(released(run), schema))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; the columns stay those of docs."""
    out = docs
    for block in blocks_of(table(spark, sf_dir, "benchmark")):
        latent = fit(docs, block)
        if latent is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], latent=latent) -> Iterator[pa.RecordBatch]:
            m = Matcher(latent)
            for batch in batches:
                for part, data, offs in text_slices(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[doc for doc, *_ in m.slice(data, offs)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(released(run), docs.schema)
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
