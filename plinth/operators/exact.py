"""The exact tier: elementary and national indices in 34-digit decimals, half-even, for values that are to be sealed.

Doubles carry 15 to 16 digits, so a level near 100 at 8 places differs from this tier at near-ties alone. Logarithms are taken in
Arrow batches, once for equal pairs of prices of a cell, and summed by cell in each as whole numbers of 10^-PLACES; a sum travels as LIMBS numbers below 10^DIGITS_A_LIMB,
which Spark adds up in partial aggregates. So sums are exact in any order, and a cell is one row when its index is
finished, however many pairs it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 34
#: A logarithm of two prices has 34 digits; those of one near 1 begin behind the point.
PLACES, LIMBS, DIGITS_A_LIMB = 40, 4, 15


def _log_sums(cell: list[str]):
    """Batches of counted pairs to rows of cell, n and the limbs of the sum of logarithms: one for each cell of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, wide, base = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN), Context(prec=4 * DIGITS), 10**DIGITS_A_LIMB
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sums: dict[tuple, list] = {}
            keys = zip(*[columns[c].to_pylist() for c in cell], strict=True) if cell else iter([()] * batch.num_rows)
            for i, (key, now, then, k) in enumerate(zip(keys, *[columns[c].to_pylist() for c in ("current_price", "base_price", "_k")], strict=True)):
                held = sums.setdefault(key, [i, 0, Decimal(0)])
                held[1] += k
                held[2] = wide.add(held[2], wide.multiply(ctx.ln(ctx.divide(now, then)), k))
            limbs: list[list[int]] = []
            for _, _, total in sums.values():
                left, parts = int(wide.to_integral_value(total.scaleb(PLACES, wide))), []
                for _ in range(LIMBS - 1):
                    left, part = divmod(left, base)
                    parts.append(part)
                limbs.append([*parts, left])
            first = pa.array([held[0] for held in sums.values()], pa.int64())
            kept = [columns[c].take(first) for c in cell]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([held[1] for held in sums.values()], pa.int64()), *[pa.array([x[k] for x in limbs], pa.int64()) for k in range(LIMBS)]], [*cell, "n", *(f"limb{k}" for k in range(LIMBS))])

    return run


def _finish(cell: list[str], base: int, min_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN)
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            levels, means = [], []
            for n, *limbs in zip(column["n"].to_pylist(), *[column[f"limb{k}"].to_pylist() for k in range(LIMBS)], strict=True):
                total = sum(int(x) * 10 ** (DIGITS_A_LIMB * k) for k, x in enumerate(limbs))
                mean = ctx.divide(Decimal(total).scaleb(-PLACES, Context(prec=4 * DIGITS)), Decimal(n))
                levels.append(ctx.multiply(Decimal(base), ctx.exp(mean)).quantize(Decimal("1e-8"), context=ctx) if n >= min_pairs else None)
                means.append(mean.quantize(Decimal("1e-12"), context=ctx))
            yield pa.RecordBatch.from_arrays([*[column[c] for c in cell], pa.array(levels, pa.decimal128(20, 8)), pa.array(means, pa.decimal128(20, 12)), column["n"]], [*cell, "level", "mean_log", "n_pairs"])

    return run


def jevons_exact(pairs: DataFrame, cell: list[str], base: int = 100, min_pairs: int = 1) -> DataFrame:
    """level decimal(20,8), mean_log decimal(20,12) and n_pairs of each cell, over its positive pairs.

    Nothing is trimmed here: for a trimmed index pass what index.trimmed leaves. A logarithm of so many digits costs far more than
    counting, so equal pairs are counted before.
    """
    money = [F.col(c).cast("decimal(12,2)").alias(c) for c in ("current_price", "base_price")]
    keys = [pairs.schema[c] for c in cell]
    summed = T.StructType([*keys, *[T.StructField(c, T.LongType()) for c in ("n", *(f"limb{k}" for k in range(LIMBS)))]])
    counted = pairs.select(*cell, *money).where("current_price > 0 and base_price > 0").groupBy(*cell, "current_price", "base_price").agg(F.count("*").alias("_k"))
    parts = counted.mapInArrow(_log_sums(cell), summed)
    sums = parts.groupBy(*cell).agg(F.sum("n").alias("n"), *[F.sum(F.col(f"limb{k}").cast("decimal(18,0)")).alias(f"limb{k}") for k in range(LIMBS)])
    out = T.StructType([*keys, T.StructField("level", T.DecimalType(20, 8)), T.StructField("mean_log", T.DecimalType(20, 12)), T.StructField("n_pairs", T.LongType())])
    return sums.mapInArrow(_finish(cell, base, min_pairs), out)


def _half_even_share(share: Column, total: Column) -> Column:
    """share / total at 10 places, exactly half-even, for numbers of 10 places: by whole numbers and what they leave."""
    one = F.lit(10**10).cast("decimal(11,0)")
    top, whole = (share * one).cast("decimal(12,0)") * one, (total * one).cast("decimal(22,0)")
    quotient = F.floor((top - F.pmod(top, whole)) / whole).cast("decimal(12,0)")
    rest = top - quotient * whole
    up = (2 * rest > whole) | ((2 * rest == whole) & (F.pmod(quotient, F.lit(2).cast("decimal(1,0)")) == 1))
    return ((quotient + F.when(up, 1).otherwise(0).cast("decimal(1,0)")) / one).cast("decimal(12,10)")


def laspeyres_exact(levels: DataFrame, weights: DataFrame, by: list[str], unit: str) -> DataFrame:
    """level decimal(20,8), coverage decimal(12,10) and n_included of each group of levels, over the units of weights (unit, share).

    Units without a level are left out, and their share goes to the others in proportion; without any, the level is null.
    All of it is in decimals of Spark's own, and partial aggregates.
    """
    share = weights.select(F.col(unit).alias("_unit"), F.col("share").cast("decimal(12,10)").alias("_share"))
    rows = levels.select(*by, unit, F.col("level").cast("decimal(20,8)").alias("_level")).join(share, F.col(unit) == F.col("_unit"), "left")
    rows = rows.select(*by, F.when(F.col("_level").isNotNull(), F.col("_share")).alias("_share"), "_level")
    covered = rows.groupBy(*by).agg(F.coalesce(F.sum("_share"), F.lit(0)).cast("decimal(20,10)").alias("_covered"), F.count("_share").alias("n_included"))
    weight = F.when(F.col("_covered") > 0, _half_even_share(F.col("_share"), F.col("_covered")))
    totals = rows.join(covered, by).groupBy(*by, "_covered", "n_included").agg(F.sum((weight * F.col("_level")).cast("decimal(36,18)")).alias("_sum"))
    return totals.select(*by, F.bround("_sum", 8).cast("decimal(20,8)").alias("level"), F.col("_covered").cast("decimal(12,10)").alias("coverage"), "n_included")
