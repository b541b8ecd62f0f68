"""Corpus pipeline: quality, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them in order to ``documents``. All but the last return the columns of
documents.

In every stage null and empty texts and null ids are rows like others: they
aren't near copies, hold no test item and no personal data, and stay, unless
the classifier rejects an empty text. Rows that repeat stay or go together.
Further columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import stage, table
from strandweave.llm.decontaminate import drop_contaminated
from strandweave.llm.minhash_dedup import drop_near_duplicates
from strandweave.llm.pii import replaced
from strandweave.llm.quality_fm import keep_good
from strandweave.llm.sentencepiece_viterbi import encoded_and_checked

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the new text."""
    out = replaced(docs)
    n = F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of what is left."""
    return encoded_and_checked(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs


#: A fitted model, banded candidates and byte-pair ids aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None
