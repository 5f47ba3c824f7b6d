"""The queries of the thirteen operators, by their contracts, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, ngrams, oracles, pages, phrases, pieces, quality, runs, sharding, substrings, toxicity, urls, vectors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": lambda s, d: mixing.op1(_read(s, d, "documents")),
        "op2_sharding": lambda s, d: sharding.op2(_read(s, d, "documents")),
        "op3_html_extraction": lambda s, d: pages.op3(_read(s, d, "pages")),
        "op4_top_k": lambda s, d: vectors.op4(_read(s, d, "embeddings")),
        "op6_embedding_dedup": lambda s, d: vectors.op6(_read(s, d, "embeddings")),
        "op5_sentencepiece": lambda s, d: pieces.op5(_read(s, d, "documents")),
        "op7_substring_dedup": lambda s, d: substrings.op7(_read(s, d, "documents")),
        "op8_ngram_join": lambda s, d: ngrams.op8(_read(s, d, "documents")),
        "op9_url_filter": lambda s, d: urls.op9(_read(s, d, "pages")),
        "op10_toxicity": lambda s, d: toxicity.op10(_read(s, d, "documents"), _read(s, d, "labels")),
        "op11_periodic_runs": lambda s, d: runs.op11(_read(s, d, "documents")),
        "op12_phrases": lambda s, d: phrases.op12(_read(s, d, "documents")),
        "op13_quality": lambda s, d: quality.op13(_read(s, d, "documents"), _read(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE,
        "op4_top_k": oracles.TOP_K,
        "op6_embedding_dedup": oracles.NEAR_VECTORS,
        "op7_substring_dedup": oracles.SUBSTRINGS,
        "op8_ngram_join": oracles.NEAR_DOCUMENTS,
        "op11_periodic_runs": runs.ORACLE,
        "op12_phrases": phrases.ORACLE,
    }
