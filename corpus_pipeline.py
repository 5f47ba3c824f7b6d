"""A corpus pipeline of five operators: toxicity, near duplicates, repeated passages, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, ngrams, pieces, substrings, toxicity
from quillon.llm.common import shared_dir, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; labels outside the held-out fold fit it.

    Null and empty texts stay; without labels of both classes nobody is rejected. Empty in, empty out.
    """
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a Jaccard similarity of 0.75, the smallest doc_id stays.

    Texts without words are in no group and stay; rows that share the kept doc_id all stay.
    """
    return ngrams.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that also start in a document of a smaller doc_id are cut out.

    A document of which nothing is left goes; null and blank texts stay. Rows of one doc_id do not cut one another.
    Empty in, empty out.
    """
    return substrings.dedup_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says; null sources are one source.

    Null and empty texts have no words and follow their source's rate; a source of size 0 goes; repeated rows draw alike. Empty in, empty out.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text: a row for each copy in the mix; null texts are empty.

    Repeated rows give equal rows; texts of any length are encoded whole. Empty in, empty out.
    """
    return pieces.op5(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Posterior scores, hash-ordered prefixes and token merges have no SQL form; the tests compare
#: each stage with a brute-force version of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    While a stage runs, texts go to Python in small batches: workers of all stages share an
    executor's memory with what the stages before have left behind.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        with small_batches(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
