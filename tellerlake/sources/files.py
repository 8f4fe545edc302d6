"""File and JDBC connectors: typed CSV scans, CSV/JSON/parquet sinks, partitioned reads over JDBC."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SOURCE_SCHEMAS

CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV scan with header; lines that do not fit keep their text in ``_corrupt_record``."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def scan_known_csvs(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Load ``<table>.csv`` paths into their tables; unknown files are skipped with a warning."""
    loaded = {}
    for path in paths:
        table = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
        if table not in SOURCE_SCHEMAS:
            warnings.warn(f"no table for {path}, skipped", stacklevel=2)
            continue
        loaded[table] = scan_csv(spark, path, SOURCE_SCHEMAS[table])
    return loaded


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_fact(df: DataFrame, path: str, date_key: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Add fact rows, laid out by year and month of their YYYYMMDD key for partition pruning.

    Rebalancing gathers a month into few files of the advisory size and splits a hot month over tasks. ``finish`` derives
    the columns that need no other row after that: they are not shuffled.
    """
    date = F.col(date_key)
    laid = df.withColumns({"_year": F.floor(date / 10000).cast("int"), "_month": F.floor(date / 100).cast("int") % 100}).hint("rebalance", "_year", "_month")
    (
        finish(laid).drop("_year", "_month")
        .withColumn("key_year", F.floor(date / 10000).cast("int"))
        .withColumn("key_month", F.floor(date / 100).cast("int") % 100)
        .write.mode(mode)
        .partitionBy("key_year", "key_month")
        .parquet(path)
    )


def scan_jdbc(spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int,
              partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """Parallel JDBC read, split over ranges of a numeric key."""
    if partitions < 1 or lower > upper:
        raise ValueError("need at least one partition and lower <= upper")
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def any_source_filled(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: is there at least one row? Each branch reads a single row."""
    branches = [
        df.limit(1).agg((F.count("*") > 0).alias("has_rows")).select(F.lit(name).alias("table_name"), "has_rows")
        for name, df in sorted(tables.items())
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def write_parted(df: DataFrame, path: str, by: str) -> None:
    """Overwrite a table of folders by the column ``by``; its schema is kept beside it, as a table without rows has no file."""
    df.limit(0).write.mode("overwrite").parquet(f"{path}.schema")
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_parted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}.schema").schema).parquet(path)
