"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellerlake.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from tellerlake.llm.common import stored, table
from tellerlake.llm.queries import SHARDS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the model learns from `labels` and the stage's own documents."""
    return quality_rules.kept_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document, in training order."""
    return mixing.training_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest in training order: every column but the text, with position, size, checksum, shard and slot of each row."""
    return sharding.shard_in_order(docs, SHARDS, [c for c in docs.columns if c != "text"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality), ("n-gram Jaccard join", distinct), ("benchmark decontamination", uncontaminated),
    ("mixing sources", mixed), ("sharding", sharded)]

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
