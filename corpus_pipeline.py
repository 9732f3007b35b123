"""The corpus pipeline: filter, deduplicate, decontaminate and tokenise `documents`.

STAGES lists (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet below spark.checkpoint.dir and rereads it as the docs of the next one, so no stage is evaluated twice and a
lost executor costs one stage at most. All stages but the last keep the columns of documents.

Rows at the edges follow the operators: null and empty texts take the score of an empty text in the first two stages,
have no duplicates and no contamination, and encode to the begin and end ids. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgermatch.llm import decontaminate, jaccard_join, quality_knn, toxicity
from ledgermatch.llm.common import shared_path, table
from ledgermatch.llm.piece_codec import transcode


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    return quality_knn.keep_good(spark, docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the toxicity model rejects go."""
    return toxicity.keep_civil(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the document of the smallest doc_id stays."""
    return jaccard_join.one_of_each(spark, docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.remove_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the ids of each document, with their count and digests of ids and decoded text."""
    return transcode(spark, docs, public_tokenizers.path("piece_bpe_32k.model"),
                     ("n_tokens", "input_ids", "ids_sha256", "decoded_sha256"), carry=("doc_id",))


STAGES = [
    ("good", good),
    ("civil", civil),
    ("distinct", distinct),
    ("uncontaminated", uncontaminated),
    ("tokenised", tokenised),
]

#: Trained models, hashing and tokenizers can't be stated in SQL; tests/llm/ holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
