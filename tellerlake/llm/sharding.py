"""Contiguous shards of near equal bytes, from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_of, pieces, stored

ROWS_PER_PART = 100_000


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for its length field."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


#: Columns that ``as_stored`` adds.
STORED = ["_so_part", "_so_file", "_so_name", "_so_row"]


def as_stored(df: DataFrame) -> DataFrame:
    """``df`` plus the columns STORED, in whose order its rows were written.

    A sorted table is written as numbered files (part-N...), each a range of the order, and a file keeps the order of its
    rows; a reader may hand out the files in any order. Tables that are not read from such files have no such order
    and are refused: at once, or by the first row of a file that has another name.
    """
    def number(pattern: str) -> Column:
        found = F.regexp_extract(name, pattern, 1).try_cast("long")
        return F.coalesce(found, F.raise_error(F.concat(F.lit("no numbered file of a table: "), name)).cast("long"))

    try:
        name = F.col("_metadata.file_name")
        return df.select(*[F.col(f"`{c}`") for c in df.columns], number(r"^part-(\d+)").alias("_so_part"),
                         number(r"-c(\d+)\.").alias("_so_file"), name.alias("_so_name"), F.col("_metadata.row_index").alias("_so_row"))
    except AnalysisException as error:
        raise ValueError("rows have the order they were written in only if they are read from Parquet files") from error


def shard_by_bytes(df: DataFrame, shards: int, size: str, order: list[str], number: str | None = None) -> DataFrame:
    """All columns of ``df`` plus ``shard`` and ``slot``, and the row number in the whole table if ``number`` names it.

    Rows are put in the order of the columns ``order`` and dealt to range partitions. Each partition reports the
    sum of its sizes and its row count; running totals over the partitions, and then inside each partition, give
    every row its first byte and its row number in the whole table. A row belongs to the shard that its middle
    byte falls into when all bytes are cut at ``shards`` equal targets, so that a shard misses its target by less
    than one row at either end. ``slot`` counts the rows of a shard from 0.

    Nulls in ``order`` come first; rows equal in all of ``order`` are interchangeable, so ``order`` should hold
    whatever the result shows. A null size counts 0. Empty tables give no rows. Columns of ``df`` named ``shard``
    or ``slot`` are replaced; names beginning with ``_sh_`` are reserved. Carry only the columns needed: each is
    shuffled twice.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    parts = max(pieces(df.count(), ROWS_PER_PART), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(
        df.withColumn("_sh_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
        .repartitionByRange(parts, *order).withColumn("_sh_part", F.spark_partition_id()), "shards")
    before = W.orderBy("_sh_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition, so a single window and a broadcast stay small at any size of the table.
    totals = (
        ranged.groupBy("_sh_part").agg(F.sum("_sh_size").alias("_sh_sum"), F.count(F.lit(1)).alias("_sh_rows"))
        .select("_sh_part", F.coalesce(F.sum("_sh_sum").over(before), F.lit(0)).alias("_sh_bytes0"),
                F.coalesce(F.sum("_sh_rows").over(before), F.lit(0)).alias("_sh_rows0"),
                F.sum("_sh_sum").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_sh_total")))
    inside = W.partitionBy("_sh_part").orderBy(*order)
    placed = (
        ranged.withColumn("_sh_run", F.sum("_sh_size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_sh_nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "_sh_part")
        .withColumn("_sh_row", F.col("_sh_rows0") + F.col("_sh_nth") - 1)
        .withColumn("_sh_twice", 2 * (F.col("_sh_bytes0") + F.col("_sh_run")) - F.col("_sh_size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_sh_twice * {shards} div greatest(2 * _sh_total, 1)")).cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("_sh_row").alias("_sh_first"))  # at most `shards` rows
    return (placed.join(F.broadcast(firsts), "shard")
            .withColumn("slot", (F.col("_sh_row") - F.col("_sh_first")).cast("long"))
            .select(*df.columns, *([F.col("_sh_row").cast("long").alias(number)] if number else []), "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Manifest of the shards: the columns ``keep``, size, text_crc32, law, shard, slot, grown_shard.

    Documents stand in the order of their id (null first), then of their text's checksums, so equal rows are
    interchangeable. A null text has size 8 and no checksum; an empty one size 8 and checksum 0.
    """
    keep = free_of(keep, ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    rows = docs.select(*keep, F.col(doc_id).alias("_sd_id"), byte_size(text).alias("size"),
                       F.crc32(F.col(text).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_sd_hash"))
    out = shard_by_bytes(rows, shards, "size", ["_sd_id", "text_crc32", "_sd_hash"])
    return out.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def shard_in_order(docs: DataFrame, shards: int, keep: list[str], text: str = "text") -> DataFrame:
    """Manifest of shards that follow the order in which ``docs`` was written (``as_stored``).

    The columns of ``shard_documents``, and before them, after ``keep``, position: the row's number from 0 on.
    """
    keep = free_of(keep, ("position", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    rows = as_stored(docs).select(*keep, *STORED, byte_size(text).alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(rows, shards, "size", STORED, "position")
    return out.select(*keep, "position", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
