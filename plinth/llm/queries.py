"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontaminate, html_extract, licenses, merkle_manifest, near_dedup, packing, periodic_runs, pii, quality_classifier, quality_rules, records, secret_scan, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.op1,
        "op2_pii_crf": pii.op2,
        "op3_html_extract": html_extract.op3,
        "op4_best_fit_packing": packing.op4,
        "op5_near_dedup": near_dedup.op5,
        "op6_url_filter": url_filter.op6,
        "op7_license_scan": licenses.op7,
        "op8_decontaminate": decontaminate.op8,
        "op9_quality_rules": quality_rules.op9,
        "op10_token_records": records.op10,
        "op11_merkle_manifest": merkle_manifest.op11,
        "op12_secret_crf": secret_scan.op12,
        "op13_periodic_runs": periodic_runs.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.op6_sql(), "op7_license_scan": licenses.op7_sql(), "op11_merkle_manifest": merkle_manifest.op11_sql()}
