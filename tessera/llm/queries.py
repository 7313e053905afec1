"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, filter_audit, html_text, mixing, ngram_join, periodic_runs, pieces, pipeline, secrets, sharding, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
        "op2_mixing": mixing.op2_mixing,
        "op3_html_extraction": html_text.op3_html_extraction,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_sharding": sharding.op6_sharding,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_secrets": secrets.op9_secrets,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_sentencepiece": pieces.op13_sentencepiece,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op6_sharding": sharding.op6_sql(), "op9_secrets": secrets.op9_sql(), "op11_filter_audit": filter_audit.OP11_SQL}
