"""Training-corpus pipeline over ``documents``.

STAGES are applied in order; each takes (spark, docs, sf_dir), works on all rows
that its predecessor kept, and returns a DataFrame that ``run`` writes as Parquet
in the shared folder and rereads for the next one.  All but the last return the
columns of ``documents``; the last returns the piece ids' digest of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deliverylens.llm import decontamination, exact_dedup, ngram_join, sentencepieces, toxicity
from deliverylens.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8), that of the smallest doc_id."""
    return ngram_join.one_of_each(docs, k=5, share=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, as counts and digests."""
    return sentencepieces.with_pieces(docs, sentencepieces.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode_pieces),
]

#: A trained network and a tokenizer library: SQL can't express them.  Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
