"""Substring search by a stored trigram index: posting lists instead of a scan, then an exact check of the candidates."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_parted, write_parted

GRAM = 3
BLOCK_ROWS = 65_536  # keys of one posting list at most
BUCKETS, FOLDERS = 64, 1024  # folders of the posting lists, and at most of the texts


def grams(text: Column) -> Column:
    """Distinct runs of three characters; a shorter text is one gram itself, an empty one has none."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))
    return F.when(F.length(text) >= GRAM, runs).when(F.length(text) > 0, F.array(text))


class SubstringIndex:
    """Tables in a folder: ``postings/bucket=B`` (field, gram, block, keys) and ``texts/folder=F`` (key, block, fields in lower case).

    A block is a part of the keys, by hash; a gram's list of one block has BLOCK_ROWS keys at most, however common it is.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def build(rows: DataFrame, folder: str, key: str, fields: dict[str, Column], block_rows: int = BLOCK_ROWS) -> SubstringIndex:
        """Index the given fields, each a text expression, by a unique ``key``; null texts match nothing."""
        blocks = max(1, -(-rows.count() // block_rows))
        texts = rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"),
                            *[F.lower(text).alias(name) for name, text in fields.items()])
        texts = texts.withColumn("folder", F.col("block") % FOLDERS)
        write_parted(texts.repartition("folder", "block"), os.path.join(folder, "texts"), "folder")
        index = SubstringIndex(rows.sparkSession, folder)
        pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), grams(F.col(f"`{name}`")).alias("grams")) for name in fields]))
        lists = (index._texts().select("key", "block", pairs.alias("p")).select("key", "block", "p.field", F.explode("p.grams").alias("gram"))
                 .groupBy("field", "gram", "block").agg(F.sort_array(F.collect_list("key")).alias("keys"))
                 .withColumn("bucket", F.pmod(F.xxhash64("field", "gram"), F.lit(BUCKETS)).cast("int")))
        order = ["bucket", "field", "gram", "block"]
        write_parted(lists.repartitionByRange(*order).sortWithinPartitions(*order), os.path.join(folder, "postings"), "bucket")
        return index

    def _texts(self) -> DataFrame:
        return read_parted(self.spark, os.path.join(self.folder, "texts"))

    def candidates(self, field: str, pattern: str) -> DataFrame:
        """block and key of the rows whose field has every gram of the pattern; of shorter patterns, some gram that holds it."""
        gram = F.explode(grams(F.lower(F.lit(pattern)))).alias("gram")
        asked = self.spark.range(1).select(gram).select("gram", F.pmod(F.xxhash64(F.lit(field), "gram"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()  # grams of the pattern
        lists = read_parted(self.spark, os.path.join(self.folder, "postings")).filter(F.col("field") == field)
        if len(asked) == 1 and len(asked[0].gram) < GRAM:
            return lists.filter(F.contains("gram", F.lit(asked[0].gram))).select("block", F.explode("keys").alias("key")).distinct()
        own = lists.filter(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("gram").isin([r.gram for r in asked]))
        # one list for each gram of the pattern, in blocks of bounded size
        met = own.groupBy("block").agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == len(asked))
        both = F.aggregate(F.slice("lists", 2, max(1, len(asked))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return met.select("block", F.explode(both).alias("key"))

    def search(self, any_of: dict[str, str]) -> DataFrame:
        """Keys of the rows of which some field contains its pattern, whatever the case; an empty pattern matches every text."""
        found, exact = None, F.lit(False)
        for field, pattern in any_of.items():
            own = self.candidates(field, pattern) if pattern else self._texts().filter(F.col(f"`{field}`").isNotNull()).select("block", "key")
            found = own if found is None else found.unionByName(own)
            exact = exact | F.contains(F.col(f"`{field}`"), F.lower(F.lit(pattern)))
        folders = sorted(r.f for r in found.select((F.col("block") % FOLDERS).alias("f")).distinct().collect())  # at most FOLDERS numbers
        texts = self._texts().filter(F.col("folder").isin(folders))
        return texts.join(found.select("key").distinct(), "key", "left_semi").filter(exact).select("key")
