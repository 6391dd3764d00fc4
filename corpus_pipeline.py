"""The corpus pipeline: language identification, exact dedup, n-gram Jaccard join, PII surrogates, packing.

Each stage is called as (spark, docs, sf_dir) with its predecessor's rows and gives a DataFrame. Language
identification drops documents without letters or with a posterior under language_id.MIN_SCORE; of equal
texts and of each component of near copies one document stays; PII is replaced in the texts; packing gives
the pieces with their sequences. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, language_id, ngram_join, packing, pii
from quillon.llm._base import materialize

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: language_id.keep_known(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.keep_first(docs)),
    ("ngram_jaccard_join", lambda spark, docs, sf_dir: ngram_join.keep_representatives(docs)),
    ("pii_surrogates", lambda spark, docs, sf_dir: pii.without_pii(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(docs)),
]
ORACLE_SQL = None  # naive Bayes and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
