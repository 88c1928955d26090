"""From raw documents to packed training sequences: the stages, in order, and a run over them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined results: null and empty texts are scored like any other, linked with nothing, hold no benchmark item and no
personal data, and pack as the end id alone; of rows that repeat a doc_id one is kept by the second stage, rows without
doc_id all are; further columns go along under their names; an empty table gives no rows; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontaminate, near_dedup, packing, pii, quality_classifier
from plinth.llm.common import materialise
from plinth.llm.tokens import vocabulary


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, as pieces with a place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier.accept),
    ("near-duplicates", near_dedup.keep_one),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("personal data", pii.clean),
    ("best-fit packing", pack),
]

#: Dictionaries, sketches, latent spaces and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
