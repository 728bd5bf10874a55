"""From raw documents to packed training sequences, stage by stage.

Each stage takes all documents that its predecessor kept, written as Parquet and read again, and returns the columns
of documents; the last returns the packed pieces. A stage imports its operator when it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    from tabiya.llm.quality_rules import kept_documents

    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in the largest document only."""
    from tabiya.llm.line_dedup import deduped_documents

    return _recounted(deduped_documents(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    from tabiya.llm.jaccard_join import representatives

    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights, in training order; a document read again is there again."""
    from tabiya.llm.mixing import mixed_documents

    return _recounted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    from tabiya.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Near copies and token ids can't be expressed in SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabiya.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
