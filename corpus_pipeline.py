"""The corpus pipeline: five operators over ``documents``, each on what the one before kept.

Every stage reads whole texts of any length, takes a null text as empty, and makes no rows
of an empty table. All but the last return the columns they are given, extra ones of any
name included; what else is defined stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parzelle.llm import decontamination, mixing, sharding, simhash, toxicity
from parzelle.llm.common import table
from parzelle.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from the labelled ones among them, doesn't reject.

    Null ids and rows without a label teach nothing, but are judged; repeated rows are judged
    alike, so all or none of them stay. Without toxic examples none is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.train(*toxicity.examples(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints.

    It is the one with the smallest id (null last), of several with that id the one with the
    smallest hash of its text. Texts without words are one component, and of rows equal
    in id and text one stays.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Rows equal in id and text stay or go together; texts and items without tokens leak nothing.
    An empty benchmark keeps every row.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of the sources takes it.

    A null source is one of its own; sources without words are not taken; rows equal in id
    and text stand at one place of the seeded order and are taken together.
    """
    return mixing.mix(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ``shard`` and ``slot``.

    Columns with these names are replaced; repeated rows each have a slot of their own; equal
    fractional ranks follow the order of the sources.
    """
    return sharding.interleave(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
