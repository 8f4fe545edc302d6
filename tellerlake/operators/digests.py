"""Changes between two loads of a table, found by content: a tree of digests for each load.

Rows are dealt to leaves by the hash of their key. A leaf's digest adds up the digests of its rows, a node's those of
its children. Two loads are compared from the root down; only leaves whose digests differ are read and joined. So
rows that come late, change or go are found without marks and whatever their ids.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_parted, write_parted

FAN = 16
LEAF_ROWS = 100_000
MAX_DEPTH = 5
FOLDERS = 256  # folders that the leaves of a load are written to


def row_digest(columns: list[str]) -> Column:
    """Digest of a row: of each column's name, value and whether it is null."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


class Loads:
    """Digests of the loads of one table, in a folder: ``leaves/load=N/folder=F`` (key columns, leaf, digest) and ``nodes/load=N``."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], depth: int | None = None):
        self.spark, self.folder, self.keys, self.depth = spark, folder, keys, depth

    def write(self, rows: DataFrame, load: int) -> None:
        """Digest a load; keys are unique. The first load fixes the depth: leaves of about LEAF_ROWS rows."""
        if self.depth is None:
            self.depth = min(MAX_DEPTH, max(1, math.ceil(math.log(max(1, rows.count() / LEAF_ROWS), FAN))))
        leaves = FAN**self.depth
        leaf = F.pmod(F.xxhash64(*self.keys), F.lit(leaves)).cast("int")
        slim = rows.select(*self.keys, leaf.alias("leaf"), row_digest(rows.columns).alias("digest"))
        slim = slim.withColumn("folder", F.floor(F.col("leaf") * min(leaves, FOLDERS) / leaves).cast("int"))
        path = os.path.join(self.folder, "leaves", f"load={load}")
        write_parted(slim.repartitionByRange("folder", "leaf", *self.keys), path, "folder")

        # the tree: sums of digests, which add up whatever the order, and counts
        total = F.sum(F.col("digest").cast("decimal(38,0)"))
        nodes = read_parted(self.spark, path).groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), total.alias("digest"))
        nodes = nodes.withColumn("level", F.lit(self.depth))
        levels = [nodes]
        for level in reversed(range(self.depth)):
            up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
            levels.append(up.withColumn("level", F.lit(level)))
        tree = levels[0]
        for part in levels[1:]:
            tree = tree.unionByName(part)
        write_parted(tree.coalesce(1 if leaves <= 65_536 else 16), os.path.join(self.folder, "nodes", f"load={load}"), "level")

    def _nodes(self, load: int, level: int) -> DataFrame:
        path = os.path.join(self.folder, "nodes", f"load={load}")
        return read_parted(self.spark, path).filter(F.col("level") == level).select("node", F.struct("n", "digest").alias(f"_{load}"))

    def differing(self, old: int, new: int) -> list[int]:
        """Numbers of the leaves that differ, found from the root down; at most FAN ** MAX_DEPTH numbers."""
        open_ = [0]
        for level in range(self.depth + 1):
            sides = [self._nodes(load, level).filter(F.col("node").isin(open_)) if len(open_) <= 10_000 else self._nodes(load, level) for load in (old, new)]
            unlike = sides[0].join(sides[1], "node", "full").filter(~F.col(f"_{old}").eqNullSafe(F.col(f"_{new}")))
            found = sorted(r["node"] for r in unlike.select("node").collect())
            if level == self.depth or not found:
                return found
            open_ = [n * FAN + i for n in found for i in range(FAN)]
        return []

    def _leaves(self, load: int, leaves: list[int]) -> DataFrame:
        count = FAN**self.depth
        folders = sorted({leaf * min(count, FOLDERS) // count for leaf in leaves})
        rows = read_parted(self.spark, os.path.join(self.folder, "leaves", f"load={load}"))
        return rows.filter(F.col("folder").isin(folders) & F.col("leaf").isin(leaves)).drop("folder", "leaf")

    def changes(self, old: int, new: int) -> DataFrame:
        """Key columns and change (inserted, changed, deleted) of every row that differs; other leaves are not read."""
        leaves = self.differing(old, new)
        before = self._leaves(old, leaves).withColumnRenamed("digest", "_old")
        after = self._leaves(new, leaves).withColumnRenamed("digest", "_new")
        change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
        return before.join(after, self.keys, "full").select(*self.keys, change.alias("change")).filter(F.col("change").isNotNull())


def apply_changes(target: DataFrame, source: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` brought to the state of ``source``: only rows named by ``changes`` are taken from it."""
    kept = target.join(changes.filter("change <> 'inserted'").select(*keys), keys, "left_anti")
    return kept.unionByName(source.join(changes.filter("change <> 'deleted'").select(*keys), keys, "left_semi"))
