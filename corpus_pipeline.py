"""Corpus preparation: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written
and read again as the next one's documents. All but the last return the
columns of ``documents``. A stage keeps or drops repeated rows together and
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import decontaminate, minhash, packing, quality, toxicity
from askgrid.llm.common import materialise
from askgrid.sources.tables import Tables

# The similarity of near duplicates of whole documents, in percent of five-word runs.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; null and empty texts are scored as empty."""
    tables = Tables(spark, sf_dir)
    return quality.drop_low_quality(docs, quality.train(tables.documents, tables.labels))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic; null and empty texts are scored as empty."""
    tables = Tables(spark, sf_dir)
    return toxicity.drop_toxic(docs, toxicity.train(tables.documents, tables.labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; rows without words or without an id stay."""
    return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many words of benchmark windows; those without words stay."""
    return decontaminate.drop_documents(docs, Tables(spark, sf_dir).benchmark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Tokenising and trained models cannot be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

