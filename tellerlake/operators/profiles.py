"""Profiles of loads: sketches that are stored once a load and merged, so that checks over all loads read no rows.

Distinct counts come from HLL sketches, with a standard error of 1.04 / sqrt(2^12), 1.7 percent; membership from theta
sketches of 4,096 hashes, which are exact up to so many distinct values; ranks from KLL sketches, with an error of 1.4
percent. Counts, nulls, smallest and largest values are exact. A check that looks suspicious is recounted on the rows.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .checks import orphan_counts, repeated_keys

LOG_K = 12
DISTINCT_ERROR = 1.04 / math.sqrt(1 << LOG_K)  # standard error of a distinct count
RANK_K, RANK_ERROR = 200, 0.014
# The texts that are numbers; any other would cost a failed conversion.
NUMBER = (r"^[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?[0-9]+[fFdD]?"
          r"|(?i:nan|inf|infinity))[\x00-\x20]*\z")


def number(name: str, kind: DataType) -> Column:
    """The values of a column that are numbers, as doubles; null for the others."""
    value = F.col(name)
    if kind.typeName() in ("byte", "short", "integer", "long", "decimal", "double"):
        return value.cast("double")
    if kind.typeName() in ("date", "timestamp", "timestamp_ntz", "boolean"):  # their texts are no numbers
        return F.lit(None).cast("double")
    if kind.typeName() == "string":
        return F.when(value.rlike(NUMBER), value.try_cast("double"))
    return value.try_cast("string").try_cast("double")


class Profiles:
    """Stored profiles: ``load=N/table=T`` holds a row for each column."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, table: str, load: int, rows: DataFrame, columns: list[str]) -> None:
        """Profile the columns of one load in one pass; a load that is written again replaces itself."""
        def profile(name: str) -> Column:
            text, value = F.col(name).cast("string"), number(name, rows.schema[name].dataType)
            return F.struct(F.lit(name).alias("column_name"), F.count("*").alias("n"), F.count_if(F.col(name).isNull()).alias("nulls"),
                            F.hll_sketch_agg(text, LOG_K).alias("distinct_sketch"), F.theta_sketch_agg(text, LOG_K).alias("members"),
                            F.kll_sketch_agg_double(value, RANK_K).alias("ranks"), F.min(value).alias("low"), F.max(value).alias("high"))

        found = rows.agg(F.array(*[profile(c) for c in columns]).alias("p")).select(F.inline("p"))
        found.write.mode("overwrite").parquet(os.path.join(self.folder, f"load={load}", f"table={table}"))

    def merged(self) -> DataFrame:
        """table, column_name, n, nulls, distinct_count (estimate), low, high and the sketches, over all loads; rows are not read."""
        stored = self.spark.read.option("basePath", self.folder).parquet(self.folder)
        return stored.groupBy("table", "column_name").agg(
            F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct_sketch").alias("_distinct"), F.theta_union_agg("members").alias("members"),
            F.kll_merge_agg_double("ranks").alias("ranks"), F.min("low").alias("low"), F.max("high").alias("high"),
        ).withColumn("distinct_count", F.hll_sketch_estimate("_distinct")).drop("_distinct")

    def quantile(self, p: float) -> DataFrame:
        """table, column_name and about the p-quantile of the numeric columns: its rank is off by RANK_ERROR of the rows at most."""
        numeric = self.merged().filter(F.col("low").isNotNull())
        return numeric.select("table", "column_name", F.kll_sketch_get_quantile_double("ranks", F.lit(p)).alias("value"))

    def suspected_repeats(self) -> DataFrame:
        """table and column_name whose distinct count lies more than three standard errors below the count of values.

        So a column of which 5 percent or more of the values repeat another is found with a chance of 99.8 percent or
        more; fewer repeats may stay unseen.
        """
        values = F.col("n") - F.col("nulls")
        return self.merged().filter(F.col("distinct_count") < values * (1 - 3 * DISTINCT_ERROR)).select("table", "column_name")

    def suspected_orphans(self, links: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str]]:
        """The links (child, column, parent, key) whose child has values that the parent lacks.

        Without such values the difference of two sketches is empty, so no sound link is suspected. Up to 4,096 distinct
        values on both sides the answer is exact; beyond, a share s of missing values goes unseen with a chance of
        about (1 - s) ** 4096, 1.5 percent for one value in a thousand.
        """
        sketch = {(r["table"], r["column_name"]): r["members"] for r in self.merged().select("table", "column_name", "members").collect()}  # a sketch a column
        asked = [link for link in links if (link[0], link[1]) in sketch and (link[2], link[3]) in sketch]
        if not asked:
            return []
        gaps = [F.theta_sketch_estimate(F.theta_difference(F.lit(bytes(sketch[c, f])), F.lit(bytes(sketch[p, k])))).alias(str(i)) for i, (c, f, p, k) in enumerate(asked)]
        found = self.spark.range(1).select(*gaps).first()
        return [link for i, link in enumerate(asked) if found[i] > 0]


def orphans(profiles: Profiles, tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """constraint_name and orphans for every link; rows are counted for suspected links only."""
    suspected = profiles.suspected_orphans(links)
    out = None
    for link in links:
        name = F.lit(f"{link[0]}.{link[1]}").alias("constraint_name")
        part = orphan_counts(tables, [link]) if link in suspected else profiles.spark.range(1).select(name, F.lit(0).cast("bigint").alias("orphans"))
        out = part if out is None else out.unionByName(part)
    return out


def repeats(profiles: Profiles, tables: dict[str, DataFrame], keys: list[tuple[str, str]]) -> DataFrame:
    """key_name, repeated_keys and rows_affected for every (table, column); rows are counted for suspected columns only."""
    suspected = {(r["table"], r["column_name"]) for r in profiles.suspected_repeats().collect()}  # a row a column
    out = None
    for table, column in keys:
        name, none = f"{table}.{column}", F.lit(0).cast("bigint")
        part = (repeated_keys(tables[table].filter(F.col(column).isNotNull()), name, [column]) if (table, column) in suspected
                else profiles.spark.range(1).select(F.lit(name).alias("key_name"), none.alias("repeated_keys"), none.alias("rows_affected")))
        out = part if out is None else out.unionByName(part)
    return out
