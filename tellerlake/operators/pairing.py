"""Every left row with every row of a catalogue, without a cross join.

The catalogue is cut into blocks of bounded size; left rows are repeated once for each block and joined on the block's
number, in whatever join strategy suits the sizes. The caller sees to it that the catalogue is bounded by a domain
(as products by their kinds and brands): the output is left rows times catalogue rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import blocks_needed

ROWS_PER_BLOCK = 1000


def pair_with(left: DataFrame, catalogue: DataFrame, key: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Left columns plus the catalogue's columns; ``key`` identifies a catalogue row."""
    exploded = _with_blocks(left, catalogue, key, rows_per_block).withColumn("_item", F.explode("_items"))
    return exploded.select(*left.columns, "_item.*")


def first_with(left: DataFrame, catalogue: DataFrame, key: str, order: Callable[[Callable[[str], Column]], list[Column]], n: int,
               keep: Callable[[Callable[[str], Column]], Column] | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The pairs of ``pair_with`` that may be among the n first of their left row: n for each row and block.

    ``order`` and ``keep`` are given a function that names a catalogue column and say by what pairs are ordered (ascending,
    nulls first) and which of them count. The pairs of a row and a block are an array inside the row and are cut there,
    so a task never holds or sorts more than one block of pairs, and the others are never rows.
    """
    items = F.col("_items")
    if keep:
        items = F.filter(items, lambda item: keep(lambda name: item[name]))
    ordered = F.transform(items, lambda item: F.struct(
        *[c.alias(f"_{i}") for i, c in enumerate(order(lambda name: item[name]))], item.alias("_item")))
    best = _with_blocks(left, catalogue, key, rows_per_block).withColumn("_first", F.explode(F.slice(F.sort_array(ordered), 1, n)))
    return best.select(*left.columns, "_first._item.*")


def _with_blocks(left: DataFrame, catalogue: DataFrame, key: str, rows_per_block: int) -> DataFrame:
    """Every left row with every block of the catalogue, ``_items``."""
    blocks = blocks_needed(catalogue.count(), rows_per_block)
    numbered = catalogue.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(*catalogue.columns)).alias("_items"))
    spread = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(numbered, "_block")
