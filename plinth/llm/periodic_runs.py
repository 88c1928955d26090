"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are parted into classes by the factor (the words) of a length that begins at each. The classes of
length l + 1 come from those of length l by looking at the class of the next position. Where two neighbouring members of a
class of length l are l apart, a square of period l begins, and l is the smallest period of it: were it not, a member would lie
between them. Squares of one period at positions in a row are one run.

The first lengths are refined for a whole text at once in numpy, which ends most texts: nothing of them repeats
three times. What goes on is refined by the smaller half: of the parts that a class falls into, all but the largest split the
classes of the positions before theirs, so that a position is moved a logarithmic number of times. A run that is wanted here has
four periods, so each of its squares has two more with the same root: classes of less than three members are left alone,
though they still split others once, and no length beyond a quarter of a text is looked at.

Words are compared as texts, not as hashes. A text is one row of one task, in memory and time n log n of its words; texts
are independent, so a hot key or a group of copies has nothing to meet in.

Defined results: a null or empty text has no words, no runs, and the digests of empty text; repeated rows get a row each; further
columns are not read by find() and kept by collapse(), whatever their names; an empty table gives no rows; a null doc_id
stays null (and its text is not rewritten by the query).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import bounded_batches, fresh_name, released, table

#: A run has so many periods at least, and so many words at least.
PERIODS, LEAST = 4, 6
#: Lengths that are refined for a whole text at once.
AT_ONCE = 3
#: Members that a class needs to hold the first squares of a run of PERIODS periods.
MEMBERS = PERIODS - 1

Run = tuple[int, int, int]  # start, length, period


def _merged(squares: Iterable[int], period: int) -> Iterator[Run]:
    """Runs from the places of a period's squares."""
    first = last = None
    for at in sorted(squares):
        if first is not None and at != last + 1:
            yield first, last - first + 2 * period, period
            first = None
        first, last = at if first is None else first, at
    if first is not None:
        yield first, last - first + 2 * period, period


def _squares(label: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Places of members whose next member of the same class is that length away; places ascend."""
    order = np.argsort(label, kind="stable")
    own, at = label[order], place[order]
    return at[:-1][(own[1:] == own[:-1]) & (at[1:] - at[:-1] == length)]


def _numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes numbered from 0, and how many members each has."""
    _, label, size = np.unique(code, return_inverse=True, return_counts=True)
    return label, size


def runs(ids: np.ndarray) -> list[Run]:
    """All wanted runs of a sequence of numbered words, by start, then period."""
    n, found = len(ids), []
    most = n // PERIODS
    if n < LEAST or not most:
        return []
    label, size = _numbered(ids)
    place = np.flatnonzero(size[label] >= MEMBERS)
    label = label[place].astype(np.int64)
    for length in range(1, AT_ONCE + 1):
        if len(place) < MEMBERS or length > most:
            return _wanted(found)
        found += _merged(_squares(label, place, length).tolist(), length)
        # the class of the next position; one that is left alone, or beyond the end, is of no class that matters
        whole = np.full(n + 1, -1, np.int64)
        whole[place] = label
        after = whole[place + 1]
        keep = (after >= 0) & (place + length < n)
        alone = place[~keep]
        place, parent = place[keep], label[keep]
        label, size = _numbered(parent * n + after[keep])
        if length == AT_ONCE:
            break
        big = size[label] >= MEMBERS
        place, label = place[big], label[big].astype(np.int64)
    members: list[list[int]] = [[] for _ in size]
    of: dict[int, int] = {}
    kids: dict[int, list[int]] = defaultdict(list)
    for at, c, p in zip(place.tolist(), label.tolist(), parent.tolist(), strict=True):
        if not members[c]:
            kids[p].append(c)
        members[c].append(at)
    split = [[at] for at in alone.tolist()]  # of less than MEMBERS, whatever they are with
    for parts in kids.values():
        largest = max(parts, key=lambda c: len(members[c]))
        split += [members[c] for c in parts if c != largest]
    for c, own in enumerate(members):
        if len(own) >= MEMBERS:
            of.update(dict.fromkeys(own, c))
    if of:
        found += _refined(of, members, split, AT_ONCE + 1, n)
    return _wanted(found)


def _wanted(found: list[Run]) -> list[Run]:
    return sorted((r for r in found if r[1] >= max(LEAST, PERIODS * r[2])), key=lambda r: (r[0], r[2]))


def _refined(of: dict[int, int], members: list[list[int]], split: list[list[int]], length: int, n: int) -> Iterator[Run]:
    """Runs of periods from length on. of: the class of each position that is in one of MEMBERS or more, for that length;
    members: ascending positions by class; split: members of the parts that have still to split the classes before them.
    """
    before: dict[int, int] = {}
    behind: dict[int, int] = {}
    first, last, size = [], [], []
    gaps: dict[int, list[int]] = defaultdict(list)  # by distance, members whose next one came to be so far away
    for own in members:
        first.append(own[0] if own else -1)
        last.append(own[-1] if own else -1)
        size.append(len(own))
        if len(own) >= MEMBERS:
            for a, b in zip(own, own[1:]):
                behind[a], before[b] = b, a
                gaps[b - a].append(a)

    def take(at: int, c: int) -> None:
        a, b = before.pop(at, None), behind.pop(at, None)
        size[c] -= 1
        if a is None:
            first[c] = -1 if b is None else b
        elif b is None:
            del behind[a]
        else:
            behind[a] = b
            gaps[b - a].append(a)
        if b is None:
            last[c] = -1 if a is None else a
        elif a is None:
            del before[b]
        else:
            before[b] = a

    def listed(c: int) -> list[int]:
        at, own = first[c], []
        while at is not None and at >= 0:
            own.append(at)
            at = behind.get(at)
        return own

    most = n // PERIODS
    while of and length <= most:
        squares = gaps.pop(length, ())
        yield from _merged({at for at in squares if at in of and behind.get(at, -1) - at == length}, length)
        end = n - length  # no factor of the next length begins there
        if end in of:
            take(end, of.pop(end))
        made: dict[tuple[int, int], int] = {}
        parts: dict[int, list[int]] = defaultdict(list)
        for k, splitter in enumerate(split):
            for at in splitter:
                c = of.get(at - 1)
                if c is None:
                    continue
                new = made.get((c, k))
                if new is None:
                    new = made[c, k] = len(size)
                    parts[c].append(new)
                    first.append(at - 1)
                    last.append(-1)
                    size.append(0)
                take(at - 1, c)
                of[at - 1] = new
                tail = last[new]
                if tail >= 0:
                    behind[tail], before[at - 1] = at - 1, tail
                    gaps[at - 1 - tail].append(tail)
                last[new] = at - 1
                size[new] += 1
        split = []
        for c, new in parts.items():
            every = [*new, c] if size[c] else new
            largest = max(every, key=size.__getitem__)
            for part in every:
                small = size[part] < MEMBERS
                if part != largest or small:
                    own = listed(part)
                    if part != largest:
                        split.append(own)
                    if small:
                        for at in own:
                            del of[at]
        length += 1


def kept_words(found: list[Run], n: int) -> np.ndarray:
    """Whether each word is kept: no run contains it beyond that run's first period."""
    drops = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        drops[start + period] += 1
        drops[start + length] -= 1
    return np.cumsum(drops[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for x in column:
        buffer = x.as_buffer()
        yield None if buffer is None else buffer.to_pybytes()


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that are kept, joined by one space."""
    return b" ".join(words if not found else [words[i] for i in np.flatnonzero(kept_words(found, len(words))).tolist()])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (all, by start, then period) and the collapsed text, for every row of docs (doc_id, text)."""
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, every, left = [], [], []
            for text in _texts(batch.column("text")):
                words = (text or b"").split()  # bytes are split at exactly 0x20 and 0x09 to 0x0D
                found = runs(numbered(words))
                sizes.append(len(words))
                every.append([{"start": s, "length": x, "period": p} for s, x, p in found])
                left.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(every, struct), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(run), kind)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs in text reduced to their first period; texts without runs, and null ones, are as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, new = batch.schema.get_field_index(text), []
            for old in _texts(batch.column(at)):
                words = (old or b"").split()
                found = runs(numbered(words))
                new.append(None if old is None else (collapsed(words, found) if found else old).decode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), docs.schema)


def _run_text(r: Column) -> Column:
    return F.concat_ws(",", r["start"], r["length"], r["period"])


def report(found: DataFrame) -> DataFrame:
    """Digest columns of find()'s rows: counts, the run with most periods, and hashes of the runs and of the text that is left."""
    # by products, so exactly; runs are in order, so of equal ones the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_run_text(r), F.lit("\n"))), "")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by the id's crc32, go on periodically from a place that the crc32 gives."""
    words, h, g, n, a, p = (fresh_name(x, docs.columns) for x in ("words", "h", "g", "n", "a", "p"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias(h))
    chosen = chosen.withColumn(words, F.when(F.col(h) % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    chosen = chosen.withColumns({g: F.floor(F.col(h) / 10).cast("long"), n: F.size(words).cast("long")})
    chosen = chosen.withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n)))
    chosen = chosen.withColumn(p, F.expr(f"1 + ({n} - {a}) div (3 + {g} % 8)"))
    whole = F.transform(words, lambda w, i: F.when(i < F.col(a), w).otherwise(F.get(F.col(words), (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))))
    return chosen.select("doc_id", F.when(F.col(n) > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(rewritten(table(spark, sf_dir, "documents"))))
