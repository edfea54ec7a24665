"""Corpus preparation as stages; each reads, as Parquet, what the one before it wrote.

Quality classifier, line dedup, SimHash near-dedup, repeated-substring removal,
packing.  All stages but the last return the columns of documents; where a stage
changes a text, n_chars follows.  Near copies are documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more; one document stays
of each group that such pairs connect, the first by id.

Null texts pass as empty ones (the classifier judges them, one of all texts
without a word stays in the third stage, packing gives them their end token);
documents with a null id are treated like others, as the smallest id; texts of
any length are read whole; equal rows are copies of each other; an empty table
gives an empty result; further columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import line_dedup, packing, quality_classifier, simhash, suffix_dedup
from logloom.llm.common import Stored, table
from logloom.llm.queries import vocabulary
from logloom.session import reachable


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return _counted(line_dedup.without_repeats(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return simhash.without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return _counted(suffix_dedup.without_repeats(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("packing", sequences),
]

#: The stages are models and iterations; they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    store = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.put(docs)
    return docs
