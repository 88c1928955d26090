"""Maintained reports against the same reports over all rows."""

import itertools

from pyspark.sql import functions as F

from plinth.operators import serving
from plinth.operators.gold import Gold

SCHEMA = "day date, window int, route string, total decimal(12,2), is_sold_out boolean"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def given(spark, n=400, shift=0):
    x = spark.range(n).withColumn("i", F.col("id") + shift)
    total = F.when(F.col("i") % 7 != 0, F.col("i") * 37 % 113 + F.lit(0.25)).cast("decimal(12,2)")
    return x.select(F.when(F.col("i") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("i") % 10).cast("int"))).alias("day"), F.when(F.col("i") % 13 != 0, F.col("i") % 4).cast("int").alias("window"), F.lit("r").alias("route"), total.alias("total"), F.when(F.col("i") % 17 != 0, F.col("i") % 3 == 0).alias("is_sold_out"))


def gold_at(path, rows):
    return Gold(str(path), rows.schema, "day", ("window",), "total", ("is_sold_out",))


def same(spark, gold, rows):
    got = gold.partials(spark)
    assert rows_of(gold.curve(got, "window", "is_sold_out")) == rows_of(serving.lead_time_curve(rows, "window"))
    want = serving.summary(rows, "total", {"n_is_sold_out": F.col("is_sold_out")})
    assert rows_of(gold.summary(got)) == rows_of(want.select(*gold.summary(got).columns))


def test_any_order_of_appends(spark, tmp_path):
    rows = given(spark)
    for at, order in enumerate(itertools.islice(itertools.permutations(range(3)), 0, 6, 2)):
        gold = gold_at(tmp_path / str(at), rows)
        for part in order:
            gold.append(rows.where(F.coalesce(F.dayofmonth("day"), F.lit(0)) * 5 % 3 == part))
        same(spark, gold, rows)


def test_a_restated_day_replaces_its_own_partial_only(spark, tmp_path):
    rows, gold = given(spark), gold_at(tmp_path, given(spark))
    gold.append(rows)
    day = F.col("day") == "2024-01-04"
    new = given(spark, 90, 1000).where(day)
    assert gold.restate(new) == 2
    now = rows.where(~day | day.isNull()).unionAll(new)
    same(spark, gold, now)
    gold.append(new)  # later rows of a restated day count beside it
    same(spark, gold, now.unionAll(new))
    gold.restate(rows.limit(0), spark.sql("select date '2024-01-04' as day union all select null"))
    same(spark, gold, rows.where(~day))
    assert gold.summary(gold.partials(spark, 1)).first()["n"] == 400  # as of the first commit


def test_a_batch_counts_once(spark, tmp_path):
    rows, gold = given(spark), gold_at(tmp_path / "gold", given(spark))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has lost its checkpoint, and hands every batch over again
        stream.writeStream.foreachBatch(gold.sink("fares")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/checkpoint-{_}").start().awaitTermination()
    same(spark, gold, rows)
    assert gold.append(rows, "fares-0") is None


def test_tables_without_rows(spark, tmp_path):
    gold = gold_at(tmp_path, given(spark))
    assert gold.curve(gold.partials(spark), "window", "is_sold_out").count() == 0
    assert tuple(gold.summary(gold.partials(spark)).first()) == (0, 0, 0, 0, None, None, None)
    gold.append(given(spark).limit(0))
    assert tuple(gold.summary(gold.partials(spark)).first()) == (0, 0, 0, 0, None, None, None)
