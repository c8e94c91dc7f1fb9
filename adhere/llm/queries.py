"""The operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (alignment, bpe, exact_dedup, hard_negatives, html_extract, langid, mixing, pii, projection_dedup, simhash,
               suffix_dedup, toxicity, warc)

QUERIES = (
    suffix_dedup.op1_suffix_dedup,
    bpe.op2_byte_bpe,
    exact_dedup.op3_exact_dedup,
    pii.op4_pii_spans,
    langid.op5_language_id,
    warc.op6_warc_transactions,
    mixing.op7_source_mix,
    simhash.op8_simhash_vptree,
    projection_dedup.op9_projection_neighbours,
    toxicity.op10_toxicity_ftrl,
    alignment.op11_token_alignment,
    hard_negatives.op12_hard_negatives,
    html_extract.op13_html_extract,
)
SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_warc_transactions": warc.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = corpus_pipeline.ORACLE_SQL
    return SQL | ({"pipeline": pipeline} if pipeline else {})
