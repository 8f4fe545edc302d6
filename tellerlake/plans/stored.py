"""The warehouse as its committed loads have left it, and tables laid out for joins."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import stored_table


class StoredWarehouse:
    """Dimensions and facts read from their loads; marts and pages take them in place of derived ones.

    Filters reach the files: facts lie in folders by year and month of their date key.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return stored_table(self.spark, self.folder, name)

    def current(self, name: str) -> DataFrame:
        """The current versions of a dimension with history."""
        return self.table(name).filter("is_current")

    def day(self, fact: str, date_column: str, first: int, last: int) -> DataFrame:
        """Rows of a fact with date keys (yyyymmdd) from ``first`` to ``last``; the folders of other months are not read."""
        months = (F.col("key_year") * 100 + F.col("key_month")).between(first // 100, last // 100)
        return self.table(fact).filter(months & F.col(date_column).between(first, last))


class JoinLayout:
    """Tables in buckets by a join key: they are joined and grouped by it without a shuffle.

    The tables are named in the session's catalogue; their files lie in ``folder``. All of them have the same number of
    buckets, which should be a few for each core that reads them. A key with very many rows makes a large bucket, so the
    layout is for keys that are like a member's, not for a country's. Rows are written where they lie, a file for each
    task and bucket: they are not shuffled, and a task sorts its own share of a bucket, not all of it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self._names: dict[str, str] = {}

    def write(self, name: str, rows: DataFrame) -> None:
        table = f"layout_{name}_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", os.path.join(self.folder, name)).saveAsTable(table))
        self._names[name] = table

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name])

    def release(self) -> None:
        """Take the names out of the catalogue; the files stay."""
        for table in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._names.clear()
