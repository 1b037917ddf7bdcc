"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, sharding.

All stages but the last return the columns of the documents, whatever these
are called; the last adds shard and slot (with underscores where the documents
have such columns). Every stage takes empty tables, null, empty and very long
texts, repeated rows and ids in several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexeum.llm import common as C
from lexeum.llm import decontam, mixing, neardup, quality, sharding

SHARDS = 8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as any text; rows that repeat a document
    are judged alike; without labelled rows of both classes, all documents stay
    or go by the share of good ones.
    """
    labels = C.read_table(spark, sf_dir, "labels").filter(~C.held_out(F.col("doc_id"), 4, 2))
    return quality.keep_good(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least doc_id.

    Documents without words are in no group, and those without doc_id stay; of
    rows that repeat doc_id and text one stays.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Documents without words stay; items without id or words find nothing.
    """
    return decontam.decontaminate(docs, C.read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row a copy.

    Documents without words are taken in no copy beyond the certain ones, and
    so are left out where their source shrinks; documents without source are a
    source of their own.
    """
    return mixing.mix(docs, importance=mixing.by_length("text"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there; rows of equal texts, and those without text, share a shard."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
    ("sharding", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
