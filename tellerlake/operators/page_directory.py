"""Pages and lookups of a stored table that read only the files they need."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import read_parted, write_parted

FILE_ROWS = 1_000_000
MAX_FILES = 1000  # a larger table has larger files, so that its directory stays small


class PagedTable:
    """A table sorted by a unique key, with a directory: first key, last key and rows of each of its files.

    ``counted`` columns have a directory of their own: the rows of each of their values in each file. They should have few
    values, as the directory has a row for each value and file.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    @staticmethod
    def write(rows: DataFrame, folder: str, key: str, counted: list[str] | None = None, file_rows: int = FILE_ROWS) -> PagedTable:
        spark = rows.sparkSession
        parts = min(MAX_FILES, max(1, -(-rows.count() // file_rows)))
        data = os.path.join(folder, "data")
        rows.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(data)
        stored = spark.read.schema(rows.schema).parquet(data).withColumn("_file", F.col("_metadata.file_name"))
        kinds = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value")),
                        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in counted or []])
        files = stored.select("_file", key, F.explode(kinds).alias("k")).groupBy("_file", "k.field", "k.value").agg(
            F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
        write_parted(files.withColumnRenamed("_file", "file").repartition(1), os.path.join(folder, "directory"), "field")
        return PagedTable(spark, folder, key)

    def _directory(self, field: str = "") -> DataFrame:
        files = read_parted(self.spark, os.path.join(self.folder, "directory"))
        return files.filter(F.col("field").isNull() if field == "" else F.col("field") == field)

    def _read(self, files: list[str]) -> DataFrame:
        paths = [os.path.join(self.folder, "data", f) for f in files]
        data = self.spark.read.parquet(os.path.join(self.folder, "data")) if not paths else None
        return data.filter("false") if data is not None else self.spark.read.parquet(*paths)

    def page(self, skip: int = 0, limit: int = 100, where: tuple[str, object] | None = None) -> DataFrame:
        """The rows skip to skip + limit in key order, with total, page_number and total_pages.

        ``where``: a counted column and the value that rows have to have. Only files that hold rows of the page are read,
        their names come from the directory.
        """
        if skip < 0 or limit < 1:
            raise ValueError("skip >= 0 and limit >= 1")
        files = self._directory(where[0] if where else "")
        if where:
            files = files.filter(F.col("value") == F.lit(str(where[1]).lower() if isinstance(where[1], bool) else str(where[1])))
        upto = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))  # a row for each file
        placed = files.withColumn("upto", upto)
        own = placed.filter((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + limit)).orderBy("low").collect()  # files of one page
        total = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
        rows = self._read([r["file"] for r in own])
        if where:
            rows = rows.filter(F.col(where[0]) == F.lit(where[1]))
        before = own[0]["upto"] - own[0]["n"] if own else 0
        return rows.orderBy(self.key).offset(skip - before if own else 0).limit(limit).withColumns({
            "total": F.lit(total).cast("bigint"), "page_number": F.lit(skip // limit + 1), "total_pages": F.ceil(F.lit(total) / F.lit(limit)).cast("int")})

    def lookup(self, *keys) -> DataFrame:
        """The rows with the given keys: one file for each key."""
        hit: Column = F.lit(False)
        for k in keys:
            hit = hit | F.lit(k).between(F.col("low"), F.col("high"))
        files = sorted(r["file"] for r in self._directory().filter(hit).select("file").collect())  # a file for each key
        return self._read(files).filter(F.col(self.key).isin(list(keys)))
