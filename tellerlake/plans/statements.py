"""Logged statements as data: cleaning, tagging, guarding and daily volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def analysed(statements: DataFrame, sql: str = "statement") -> DataFrame:
    """Each statement cleaned, with its lineage and both guard flags."""
    cleaned = statements.withColumn("cleaned", X.clean_statement(F.col(sql)))
    return cleaned.withColumns({
        "lineage": X.lineage(F.col("cleaned")),
        "is_destructive": X.is_destructive(F.col("cleaned")),
        "is_destructive_word": X.is_destructive(F.col("cleaned"), "word"),
    })


def lineage_volume(statements: DataFrame, day: Column) -> DataFrame:
    return statements.groupBy(day.alias("date"), "lineage").agg(F.count("*").alias("statements"))


def daily_counter(log: DataFrame, keys: list[str]) -> DataFrame:
    """Query counter per UTC day and keys."""
    return log.groupBy(F.to_date("ts").alias("date"), *keys).agg(F.count("*").alias("query_count"))


def daily_volume(counters: DataFrame) -> DataFrame:
    return counters.groupBy("date").agg(F.sum("query_count").alias("total_queries")).orderBy("date")
