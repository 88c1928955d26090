"""The cleaning chain: raw payloads to fares, in seven stages, as one job over a table or over a stream.

Extraction, currency, canonical forms, validation and the audit of components are one projection of the payloads, so
these are scanned and parsed once; what a stage refuses keeps its row, with the stage and the reason, and has no part in later
stages. The rows are then written, in the batch's own folder of the shared one: duplicates and outliers need them by other keys.

A stream hands each micro-batch to Chain.batch() under its number. A batch's files are in folders of that number alone, and are
replaced when it is done again; a finished batch leaves a mark, which makes a repeat do nothing and without which no reader sees
the batch. So a batch that was killed anywhere, or that is handed over twice, counts once, and nothing that others have written is
ever touched. Fares are upserted on reading: of each source, fingerprint and day the newest batch's row counts.

Duplicates and outliers are judged within a batch, so rows that can be of one stratum (a day of observation) belong in one batch.
Defined results: a payload that isn't JSON, or of a source that nobody knows, is a failed one, with a row in the rejections; a
payload without items has no rows; an amount that can't be read is null, never zero; unpriced rows stay, without any amount.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import canonical
from plinth.functions.money import parse_all
from plinth.functions.text_forms import nfkc_of_each
from plinth.operators import audit, dedup, robust
from plinth.sources import sinks
from plinth.sources.payload import Mapping, extract

#: Amounts of an item, the total last.
AMOUNTS = (*audit.COMPONENTS, "taxes_fees", "total_fare")
#: What an item may say of its inventory: fixed values. Anything else counts as available.
STATUSES = ("AVAILABLE", "SOLD_OUT", "PRICE_UNAVAILABLE")
#: Within what outliers are sought.
STRATUM = ["route", "cabin", "lead_window", "observation_date"]
#: What makes an offer the same one, in the order of its digest.
IDENTITY = ("route", "carrier", "flight_number", "departure_utc", "cabin", "currency", "lead_window", "observation_date", "fare_basis", "booking_class")
CONTENT = ("total_fare", *audit.COMPONENTS, "inventory_status")
#: What a winner may have won by: completeness decides, but is never named.
REASONS = ("source_trust", "freshness")
DRIFT_DAYS, GRACE_HOURS = 1, 3
#: Sources, and routes, that may be broadcast; more of them are joined by a shuffle.
BROADCAST = 100_000
COUNTERS = ("extracted", "currency_failures", "canonicalisation_failures", "structural_rejects", "partial_breakdown", "total_mismatch", "sold_out", "price_unavailable", "duplicates", "cross_source_conflicts", "outliers", "written")


def _refused(rows: DataFrame, stage: str, test: Column, reason: Column) -> DataFrame:
    """rows with stage and reason where no earlier stage has refused the row and the test holds."""
    hit = F.col("stage").isNull() & F.coalesce(test, F.lit(False))
    return rows.withColumns({"reason": F.when(hit, reason).otherwise(F.col("reason")), "stage": F.when(hit, F.lit(stage)).otherwise(F.col("stage"))})


def _dimension(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are BROADCAST at most: a few sources that have all the payloads would else be as many tasks."""
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def extracted(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """raw's columns with a row for each item of its payload; stage and reason are still null."""
    none = F.lit(None).cast("string")
    return extract(raw, mapping).withColumns({"stage": none, "reason": none, "observation_date": canonical.local_day(F.col("captured_at"))})


def priced(rows: DataFrame, currency: str) -> DataFrame:
    """Stage 2: amounts as decimals, which of them could not be read, and the currency that was given if it is another."""
    given = F.upper(F.trim(F.coalesce(F.nullif("currency", F.lit("")), F.lit(currency))))
    texts = rows.withColumns({"_texts": nfkc_of_each(F.array(*[F.col(c) for c in AMOUNTS])), "original_currency": F.nullif(given, F.lit(currency)), "currency": F.lit(currency)})
    read = parse_all(texts, "_texts", len(AMOUNTS), "_read")
    told = {c: F.col(f"_read{i}") for i, c in enumerate(AMOUNTS)}
    bad = {c: F.col(c).isNotNull() & ~told[c]["status"].isin("ok", "missing") for c in AMOUNTS}
    read = read.withColumn("unparseable", audit.named(*[(bad[c], c) for c in AMOUNTS]))
    read = read.withColumns({c: told[c]["value"] for c in AMOUNTS})
    return _refused(read, "currency", F.array_contains("unparseable", "total_fare"), F.concat(F.lit("total_fare "), told["total_fare"]["status"])).drop("_texts", *[f"_read{i}" for i in range(len(AMOUNTS))])


def canonicalised(rows: DataFrame) -> DataFrame:
    """Stage 3: carrier, flight, cabin, texts of bounded length, times and inventory. Unpriced rows have no amount at all.

    An unpriced row without a readable departure gets the local midnight of its lead time, and is flagged as modelled.
    """
    carrier = canonical.carrier(F.col("carrier_iata"))
    text = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n))
    status = F.upper(F.coalesce(F.nullif("inventory_status", F.lit("")), F.lit("AVAILABLE")))
    out = rows.withColumns({
        "carrier": carrier, "cabin": canonical.cabin(F.col("cabin")), "fare_basis": text("fare_basis", 32), "booking_class": text("booking_class", 4),
        "seats_remaining": F.greatest(F.col("seats_remaining").try_cast("int"), F.lit(0)), "is_refundable": F.col("is_refundable").try_cast("boolean"),
        "_departs": canonical.local_timestamp(F.trim("departure_local")), "arrival_utc": canonical.local_timestamp(F.trim("arrival_local")),
        "inventory_status": F.when(status.isin(*STATUSES), status).otherwise("AVAILABLE"),
    }).withColumn("flight_number", canonical.flight_number(F.col("flight_number"), F.col("carrier")))
    out = _refused(out, "canonicalisation", F.col("carrier").isNull(), F.lit("invalid carrier designator"))
    worthless = F.coalesce(F.col("total_fare") <= 0, F.lit(True))
    unpriced = (F.col("inventory_status") != "AVAILABLE") | worthless
    out = _refused(out, "canonicalisation", F.col("_departs").isNull() & ~unpriced, F.lit("undecodable departure time"))
    out = out.withColumns({"departure_utc": canonical.departure(F.col("_departs"), F.col("observation_date"), F.col("lead_window")), "_modelled": F.col("_departs").isNull() & unpriced, "_unpriced": unpriced})
    out = out.withColumn("inventory_status", F.when((F.col("inventory_status") == "AVAILABLE") & worthless, "PRICE_UNAVAILABLE").otherwise(F.col("inventory_status")))
    return out.withColumns({c: F.when(~F.col("_unpriced"), F.col(c)) for c in AMOUNTS}).drop("_departs", "_unpriced", "carrier_iata", "departure_local", "arrival_local")


def validated(rows: DataFrame) -> DataFrame:
    """Stage 4: rows without a route, of a circular one, or departing before they were seen are refused; drifted lead times are flagged."""
    reason = audit.validate(F.col("origin"), F.col("destination"), [F.col(c) for c in AMOUNTS], F.col("departure_utc"), F.col("captured_at"), GRACE_HOURS)
    drift = canonical.lead_drift(F.col("departure_utc"), F.col("observation_date"), F.col("lead_window"))
    return _refused(rows, "structural", reason.isNotNull(), reason).withColumn("lead_drift", F.when(F.abs(drift) > DRIFT_DAYS, drift))


def audited(rows: DataFrame) -> DataFrame:
    """Stage 5: one missing component is derived, and the row graded and flagged; its fingerprint and content are digested."""
    out = audit.component_audit(rows.withColumnRenamed("taxes_fees", "_given"), total="total_fare", unparseable="unparseable")
    out = out.withColumn("taxes_fees", F.coalesce("taxes_fees", "_given").cast("decimal(12,2)")).drop("_given")
    out = out.withColumns({c: F.when(F.col("derived") == c, F.col("derived_amount")).otherwise(F.col(c)).cast("decimal(12,2)") for c in audit.COMPONENTS})
    marks = audit.named((F.col("inventory_status") == "SOLD_OUT", "SOLD_OUT"), (F.col("inventory_status") == "PRICE_UNAVAILABLE", "PRICE_UNAVAILABLE"), (F.col("_modelled"), "MODELLED"), (F.col("lead_drift").isNotNull(), "STALE_OBSERVATION"))
    tokens = {"departure_utc": "timestamp", **dict.fromkeys(CONTENT[:-1], "decimal")}
    fields = {c: dedup.token(F.col(c), tokens.get(c, "text")) for c in (*IDENTITY, *CONTENT)}
    out = out.withColumns({"flags": F.concat(marks, "flags"), "fingerprint": dedup.digest([fields[c] for c in IDENTITY]), "completeness": audit.completeness(audit.COMPONENTS, F.col("quality_grade"), F.col("flight_number"), F.col("total_fare"))})
    return out.withColumn("content_hash", dedup.digest([F.col("fingerprint"), *[fields[c] for c in CONTENT]])).drop("_modelled", "derived_amount", "residual")


def deduplicated(rows: DataFrame) -> DataFrame:
    """Stage 6: rows with is_duplicate, dedup_reason, spread and conflict, and the flags that follow; leads: see Chain.fares()."""
    out = dedup.survivors(rows, "fingerprint", "trust_rank", "completeness", "captured_at", "content_hash", "total_fare", REASONS)
    more = audit.named((F.col("conflict"), "CROSS_SOURCE_CONFLICT"), (F.col("is_duplicate"), "DUPLICATE_SUPPRESSED"))
    # a batch's one row of a source, fingerprint and day, found while rows are together by fingerprint
    first = F.row_number().over(Window.partitionBy("fingerprint", "source", "observation_date").orderBy("place", "content_hash", "raw_id"))
    return out.withColumns({"flags": F.concat("flags", more), "leads": first == 1})


def screened(rows: DataFrame, threshold: float = robust.THRESHOLD) -> DataFrame:
    """Stage 7: modified z-scores of survivors with a price, by stratum, in log space; outliers of grade A fall to C."""
    judged = rows.withColumn("_price", F.when(~F.col("is_duplicate") & (F.col("total_fare") > 0), F.col("total_fare")))
    out = robust.capped(robust.scored(judged, STRATUM, "_price"), STRATUM, "content_hash", threshold)
    high, low = F.col("is_outlier") & (F.col("score") > 0), F.col("is_outlier") & (F.col("score") < 0)
    grade = F.when(F.col("is_outlier") & (F.col("quality_grade") == "A"), "C").otherwise(F.col("quality_grade"))
    return out.withColumns({"flags": F.concat("flags", audit.named((high, "OUTLIER_HIGH"), (low, "OUTLIER_LOW"))), "quality_grade": grade}).drop("_price", "n", "uses_log", "centre", "mad", "mean_deviation", "scale", "method", "members")


def counted(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """COUNTERS of a batch: of all rows of the first five stages, and of the accepted ones with their marks. One row."""
    at = lambda stage: F.count_if(F.col("stage") == stage)
    passed, flag = F.col("stage").isNull(), lambda f: F.array_contains("flags", f)
    first = rows.agg(
        F.count("*").alias("extracted"), F.coalesce(F.sum(F.size("unparseable")), F.lit(0)).alias("currency_failures"), at("canonicalisation").alias("canonicalisation_failures"), at("structural").alias("structural_rejects"),
        F.count_if(passed & (flag("PARTIAL_BREAKDOWN") | flag("COMPONENT_UNPARSEABLE"))).alias("partial_breakdown"), F.count_if(passed & flag("TOTAL_MISMATCH")).alias("total_mismatch"),
        F.count_if(flag("SOLD_OUT") & ~F.coalesce(F.col("stage").isin("currency", "canonicalisation"), F.lit(False))).alias("sold_out"), F.count_if(flag("PRICE_UNAVAILABLE") & ~F.coalesce(F.col("stage").isin("currency", "canonicalisation"), F.lit(False))).alias("price_unavailable"),
    )
    then = marked.agg(F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("conflict") & (F.col("place") == 1)).alias("cross_source_conflicts"), F.count_if("is_outlier").alias("outliers"), F.count_if(F.col("leads") & F.col("observation_date").isNotNull()).alias("written"))
    return first.crossJoin(then).select(*[F.col(c).cast("long").alias(c) for c in COUNTERS])


@dataclass(frozen=True)
class Chain:
    """mapping: where a payload's items and fields are; trust: source and trust_rank, of every source that is known;
    routes: route, origin and destination; folder: where fares, rejections, counters and batches are kept."""

    mapping: Mapping
    trust: DataFrame
    routes: DataFrame
    folder: str
    currency: str = "INR"
    threshold: float = robust.THRESHOLD

    def stages(self, raw: DataFrame) -> DataFrame:
        """The first five stages over raw (raw_id, source, route, lead_window, captured_at, payload), in one projection."""
        known = raw.join(_dimension(self.trust.select("source", "trust_rank")), "source").join(_dimension(self.routes.select("route", "origin", "destination")), "route", "left")
        return audited(validated(canonicalised(priced(extracted(known, self.mapping), self.currency))))

    def failed(self, raw: DataFrame) -> DataFrame:
        """Payloads that can't be read, or whose source is unknown, as rejections."""
        known = _dimension(self.trust.select("source").distinct())
        unknown = raw.join(known, "source", "left_anti").select("raw_id", F.concat(F.lit("no collector registered for source "), F.coalesce("source", F.lit(""))).alias("reason"))
        broken = raw.join(known, "source", "left_semi").where(F.try_parse_json("payload").isNull()).select("raw_id", F.lit("payload is not JSON").alias("reason"))
        return unknown.unionByName(broken).select("raw_id", F.lit("extraction").alias("stage"), "reason")

    def at(self, part: str, number: int | None = None) -> str:
        return f"{self.folder}/{part}" + ("" if number is None else f"/batch={number}")

    def batch(self, raw: DataFrame, number: int) -> None:
        """Clean a batch and merge it, once."""
        spark = raw.sparkSession
        if sinks.exists(spark, self.at("done", number)):
            return
        self.stages(raw).write.mode("overwrite").parquet(self.at("staged", number))
        rows = spark.read.parquet(self.at("staged", number))
        deduplicated(rows.where("stage is null")).write.mode("overwrite").parquet(self.at("unique", number))
        screened(spark.read.parquet(self.at("unique", number)), self.threshold).write.mode("overwrite").parquet(self.at("marked", number))
        marked = spark.read.parquet(self.at("marked", number))
        self.failed(raw).unionByName(rows.where("stage is not null").select("raw_id", "stage", "reason")).write.mode("overwrite").parquet(self.at("rejections", number))
        counted(rows, marked).write.mode("overwrite").parquet(self.at("counters", number))
        spark.range(1).write.mode("overwrite").parquet(self.at("done", number))

    def run(self, stream: DataFrame) -> None:
        """Clean what a stream of raw rows has that no earlier run of this folder took."""
        query = stream.writeStream.option("checkpointLocation", self.at("checkpoint")).trigger(availableNow=True).foreachBatch(self.batch).start()
        query.awaitTermination()

    def finished(self, spark: SparkSession, part: str) -> DataFrame:
        """Rows of a part (marked, rejections, counters) of all batches that are done, with their batch."""
        return spark.read.parquet(self.at(part)).join(spark.read.parquet(self.at("done")).select("batch"), "batch", "left_semi")

    def fares(self, spark: SparkSession) -> DataFrame:
        """One row for each source, fingerprint and day: the newest batch's, and of that one's the survivor.

        Each batch has marked the row of each key that leads, so only several batches are compared, and those of before there were marks.
        """
        rows = self.finished(spark, "marked")
        marks = "leads" in rows.columns
        rows = rows.where(F.coalesce("leads", F.lit(True))) if marks else rows
        if not marks or spark.read.parquet(self.at("done")).select("batch").distinct().limit(2).count() > 1:
            newest = F.row_number().over(Window.partitionBy("source", "fingerprint", "observation_date").orderBy(F.col("batch").desc(), "place", "content_hash", "raw_id"))
            rows = rows.withColumn("_nth", newest).where("_nth = 1").drop("_nth")
        return rows.drop("batch", "stage", "reason", "place", "completeness", "trust_rank", "leads")

    def rejections(self, spark: SparkSession) -> DataFrame:
        return self.finished(spark, "rejections").drop("batch")

    def counters(self, spark: SparkSession) -> DataFrame:
        """COUNTERS over all batches. One row."""
        return self.finished(spark, "counters").agg(*[F.sum(c).alias(c) for c in COUNTERS])
