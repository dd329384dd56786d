"""The corpus pipeline: documents become packed training sequences.

Quality first, so that nothing later works on what goes anyway; then near-duplicates, secrets, the mix of sources
by token budget, and packing. Each stage works on all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of documents, whatever those are.

Defined cases are those of the operators: rows without a doc_id leave at the first stage, as do blank texts;
of rows that repeat a doc_id one is left from the second stage on. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import mixing, near_dedup, ordinal_quality, packing, secret_ledger
from gritstone.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the threshold."""
    return ordinal_quality.select(docs, ordinal_quality.train(docs, ordinal_quality.grades_of(table(spark, sf_dir, "labels"))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.remove(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no rule finds a secret."""
    return secret_ledger.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, as equal shares of the sources as these can give."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins and offsets."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", deduplicate), ("secrets", without_secrets), ("mixing", mix), ("packing", pack)]

#: Fitting, sketches, the knapsack and best fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
