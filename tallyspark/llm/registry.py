"""Queries and SQL of the corpus operators, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import centroids, chat, decontaminate, exact_dedup, html_text, language, lexical, line_dedup, lm_score, near_dup, packing, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_warc": warc.query,
        "op3_decontaminate": decontaminate.query,
        "op4_html_text": html_text.query,
        "op5_language": language.query,
        "op6_packing": packing.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_lm_score": lm_score.query,
        "op9_near_dup": near_dup.query,
        "op10_toxicity": toxicity.query,
        "op11_lexical": lexical.query,
        "op12_centroids": centroids.query,
        "op13_chat": chat.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op2_warc": warc.SQL,
        "op3_decontaminate": decontaminate.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op9_near_dup": near_dup.SQL,
        "op11_lexical": lexical.SQL,
        "op12_centroids": centroids.SQL,
        "op13_chat": chat.SQL,
    }
