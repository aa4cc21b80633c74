"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillon.llm import embedding_join, exact_dedup, language_id, line_dedup, mixing, ngram_join, periodic_runs, pieces, secrets
from quillon.llm import substring_dedup, toxicity, url_filters, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_language_id": language_id.op6_language_id,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_sentence_pieces": pieces.op8_sentence_pieces,
        "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
        "op10_embedding_near_dedup": embedding_join.op10_embedding_near_dedup,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    whole = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return whole | {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_source_mixing": mixing.OP5_SQL,
        "op7_url_filters": url_filters.OP7_SQL,
        "op10_embedding_near_dedup": embedding_join.OP10_SQL,
        "op11_periodic_runs": periodic_runs.OP11_SQL,
        "op12_substring_dedup": substring_dedup.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
