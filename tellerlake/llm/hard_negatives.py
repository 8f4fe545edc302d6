"""Hard negatives by a vertical scan with bounds (BOND) over blocks of embedding columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stored

#: Rows of a block of columns; anchors that are searched for together; columns read between two looks at the bounds.
BLOCK_ROWS, ANCHORS, STEP = 4096, 8192, 16
#: Rows that are sorted by label before they are cut into blocks.
SORT_ROWS = 65_536
#: Sums below this are exact in the floating-point products.
EXACT = 2.0**53
BLOCK = "block long, rows int, dims int, ids binary, labels binary, cells binary, anchors binary"
#: What a missing id is in a block: it sorts after every other one.
NO_ID = np.iinfo(np.int64).max


def packed(rows: pa.Table, block: int, every: int) -> dict:
    """One block: ids, labels and the vectors by column, shorter vectors filled with zeros; and the places of its anchors."""
    vectors = rows["vector"].combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(lengths.max(initial=0))
    cells = np.zeros((len(lengths), dims))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    cells[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    kind = np.int16 if np.abs(cells).max(initial=0) < 2**15 else np.float64
    ids = rows["id"].to_numpy()
    return {"block": block, "rows": len(lengths), "dims": dims, "ids": ids.tobytes(), "labels": rows["label"].to_numpy().tobytes(),
            "cells": np.ascontiguousarray(cells.T.astype(kind)).tobytes(),
            "anchors": np.flatnonzero((ids % every == 0) & (ids != NO_ID)).astype(np.int32).tobytes()}


def whole_numbers(batch: pa.RecordBatch, scale: int) -> pa.RecordBatch:
    """The rows that take part, their components as floor(scale * x)."""
    batch = batch.filter(pc.and_(pc.is_valid(batch["label"]), pc.is_valid(batch["vector"])))
    vectors = batch["vector"].cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls are no numbers here
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    fine = bad[bounds[1:]] == bad[bounds[:-1]]
    vectors = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.floor(scale * flat)))
    ids = pc.fill_null(batch["id"].cast(pa.int64()), NO_ID)
    return pa.RecordBatch.from_arrays([ids, batch["label"].cast(pa.int64()), vectors], names=["id", "label", "vector"]).filter(pa.array(fine))


def packer(every: int, scale: int):
    def pack(batches):
        """Blocks of a partition's rows, sorted by label in parts of SORT_ROWS, so that a block has few labels and narrow columns."""
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def cut():
            nonlocal number
            rows = pa.Table.from_batches(waiting).sort_by("label")
            for i in range(0, rows.num_rows, BLOCK_ROWS):
                yield pa.RecordBatch.from_pylist([packed(rows.slice(i, BLOCK_ROWS), number, every)], schema=_BLOCK)
                number += 1

        for batch in batches:
            waiting.append(whole_numbers(batch, scale))
            if sum(b.num_rows for b in waiting) >= SORT_ROWS:
                yield from cut()
                waiting = []
        if waiting:
            yield from cut()

    return pack


_BLOCK = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                    ("cells", pa.binary()), ("anchors", pa.binary())])


class Block:
    def __init__(self, row: dict):
        self.number, self.n, self.dims = row["block"], row["rows"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.known = set(np.unique(self.labels).tolist())
        cells = row["cells"]
        self.cells = np.frombuffer(cells, np.int16 if len(cells) == 2 * self.n * self.dims else np.float64).reshape(self.dims, self.n).astype(np.float64)
        self.low, self.high = np.min(self.cells, axis=1), np.max(self.cells, axis=1)

    def scan(self, vector: np.ndarray, rows: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of those of ``rows`` that may be among the ``most`` best of a window.

        Windows are scores from ``floors`` to ``ceilings``. Columns are read in the order of the vector's descending
        magnitudes; the least and largest values of the columns not read yet bound what a row may still win, and rows
        that no window can take any more leave the candidates.
        """
        size = min(len(vector), self.dims)
        order = np.argsort(-np.abs(vector[:size]), kind="stable")
        q = vector[order]
        a, b = q * self.low[order], q * self.high[order]
        if np.maximum(np.abs(a), np.abs(b)).sum() >= EXACT:
            return rows, self.in_integers(q, order, rows)
        rest_low = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0.0)
        rest_high = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0.0)
        score, floors = np.zeros(len(rows)), floors.astype(np.float64)
        if not ((rest_high[0] >= floors) & (rest_low[0] <= ceilings)).any():
            return rows[:0], np.zeros(0, np.int64)
        for begin in range(0, size, STEP):
            end = min(begin + STEP, size)
            columns = self.cells[order[begin:end]]
            score += q[begin:end] @ (columns if len(rows) == self.n else columns[:, rows])
            least, largest = score + rest_low[end], score + rest_high[end]
            wanted = np.zeros(len(rows), bool)
            for w in range(len(floors)):
                inside = least[(least >= floors[w]) & (largest <= ceilings[w])]
                if len(inside) > most:  # so many surely are in the window: the last of them is its new floor
                    floors[w] = np.partition(inside, len(inside) - most)[len(inside) - most]
                wanted |= (largest >= floors[w]) & (least <= ceilings[w])
            if not wanted.all():
                rows, score = rows[wanted], score[wanted]
            if not len(rows):
                break
        return rows, score.astype(np.int64)

    def in_integers(self, q: np.ndarray, order: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores beyond what floating-point sums hold exactly."""
        weights = [int(x) for x in q]
        scores = [sum(w * int(x) for w, x in zip(weights, column)) for column in self.cells[order][:, rows].T]
        if any(abs(s) > NO_ID for s in scores):
            raise ValueError("a score does not fit 64 bits")
        return np.array(scores, np.int64)


class Best:
    """The best rows seen so far with a score from ``low`` to ``high``; equal scores go by id."""

    def __init__(self, most: int, low: int, high: int):
        self.most, self.low, self.high = most, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        return self.low if len(self.scores) < self.most else int(self.scores[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        own = (scores >= self.floor) & (scores <= self.high)
        if own.any():
            scores, ids = np.concatenate([self.scores, scores[own]]), np.concatenate([self.ids, ids[own]])
            order = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[order], ids[order]


class Anchor:
    """An anchor with its windows: one for all scores, or one for each positive."""

    def __init__(self, row: dict, most: int, band: tuple[int, int]):
        self.block, self.place, self.id, self.label = row["block"], row["place"], row["id"], row["label"]
        self.vector = np.frombuffer(row["vector"], np.float64)
        self.negative = row["positives"] is not None
        self.best = [Best(most, -(-band[0] * s // 100), band[1] * s // 100) for s in row["positives"]] if self.negative else [Best(most, -NO_ID, NO_ID)]

    def meet(self, block: Block) -> None:
        if self.negative:
            rows = np.flatnonzero(block.labels != self.label)
        elif self.label in block.known:
            rows = np.flatnonzero(block.labels == self.label)
            if block.number == self.block:
                rows = rows[rows != self.place]
        else:
            return
        if len(rows):
            rows, scores = block.scan(self.vector, rows, np.array([b.floor for b in self.best]), np.array([b.high for b in self.best]), self.best[0].most)
            for best in self.best:
                best.add(scores, block.ids[rows])


FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("nth", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])


def searcher(most: int, band: tuple[int, int]):
    """Searches the blocks of a cell for the cell's anchors, which come first; one block is in memory at a time."""

    def found(anchors: list[Anchor]):
        for i in range(0, len(anchors), 1024):
            out = {name: [] for name in FOUND.names}
            for a in anchors[i : i + 1024]:
                for nth, best in enumerate(a.best):
                    n = len(best.ids)
                    for name, values in zip(FOUND.names, ([a.block] * n, [a.place] * n, [a.id] * n, [nth] * n, best.ids.tolist(), best.scores.tolist())):
                        out[name].extend(values)
            yield pa.RecordBatch.from_pydict(out, schema=FOUND)

    def search(batches):
        cell, anchors = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i].as_py() for name in batch.schema.names}
                if row["cell"] != cell:
                    yield from found(anchors)
                    cell, anchors = row["cell"], []
                if row["cells"] is None:
                    anchors.append(Anchor(row, most, band))
                elif anchors:
                    block = Block(row)
                    for anchor in anchors:
                        anchor.meet(block)
        yield from found(anchors)

    return search


def anchor_rows(batches):
    """The anchors of the blocks, with their vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i].as_py() for name in batch.schema.names}
            block, places = Block(row), np.frombuffer(row["anchors"], np.int32)
            if len(places):
                vectors = np.ascontiguousarray(block.cells[:, places].T)
                yield pa.RecordBatch.from_pydict(
                    {"block": [block.number] * len(places), "place": places, "id": block.ids[places], "label": block.labels[places],
                     "vector": [v.tobytes() for v in vectors]},
                    schema=pa.schema([("block", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())]))


class Search:
    """Blocks of all rows, and searches of anchors among them.

    Anchors are dealt into groups of about ANCHORS, blocks into about four times the square root of their number; a
    cell of the grid is one group of each. So a block travels once for each group of anchors, an anchor once for each
    group of blocks, and the best of a cell are all that leaves it.
    """

    def __init__(self, rows: DataFrame, every: int, scale: int):
        self.blocks = stored(rows.mapInArrow(packer(every, scale), BLOCK), "negatives-blocks")
        counts = self.blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.octet_length("anchors") / 4), F.lit(0)).alias("anchors")).first()
        self.block_groups = min(max(1, counts["blocks"]), math.ceil(4 * math.sqrt(counts["blocks"])) or 1)
        self.anchor_groups = pieces(counts["anchors"], ANCHORS)
        self.anchors = stored(self.blocks.filter(F.octet_length("anchors") > 0).mapInArrow(anchor_rows, "block long, place int, id long, label long, vector binary"), "negatives-anchors")

    def best(self, anchors: DataFrame, most: int, band: tuple[int, int]) -> DataFrame:
        """The ``most`` best rows of each window of the anchors: block, place, anchor_id, nth (window), other, score, rank."""
        def groups(count: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

        def absent(*names: str) -> list[Column]:
            kinds = {"rows": "int", "dims": "int", "place": "int", "id": "long", "label": "long", "positives": "array<long>"}
            return [F.lit(None).cast(kinds.get(n, "binary")).alias(n) for n in names]

        asked = anchors.select("block", "place", "id", "label", "vector", "positives", *absent("rows", "dims", "ids", "labels", "cells"),
                               F.pmod(F.xxhash64("block", "place"), F.lit(self.anchor_groups)).cast("int").alias("_a"), groups(self.block_groups).alias("_b"))
        data = self.blocks.select("block", *absent("place", "id", "label", "vector", "positives"), "rows", "dims", "ids", "labels", "cells",
                                  groups(self.anchor_groups).alias("_a"), F.pmod(F.xxhash64("block"), F.lit(self.block_groups)).cast("int").alias("_b"))
        cells = asked.unionByName(data).withColumn("cell", F.col("_a") * self.block_groups + F.col("_b")).drop("_a", "_b")
        tasks = min(self.anchor_groups * self.block_groups, 10_000)
        dealt = cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", F.col("cells").isNotNull(), "block", "place")
        fields = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in FOUND)
        order = Window.partitionBy("block", "place", "nth").orderBy(F.desc("score"), "other")
        return dealt.mapInArrow(searcher(most, band), fields).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100,
                   positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row with a null label or vector, or with a component that is null or not finite, takes no part. Components
    become floor(scale * x); a row's score is its integer inner product with the anchor, as if shorter vectors went on
    with zeros; higher scores come first, equal ones by id. Anchors are the rows whose id is divisible by ``every``,
    each by itself where rows repeat; their positives the ``positives`` best other rows of the label. For each
    positive the ``negatives`` best rows of other labels are returned whose score is from band[0] to band[1] percent of
    the positive's. A null id is no anchor and sorts after all others (so does the largest long, which is returned as
    null). A score beyond 64 bits is an error. An empty table gives no rows; other columns are not read.

    Rows are packed into blocks by column. Both searches are vertical scans with bounds (``Block.scan``).
    """
    search = Search(rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), every, scale)
    nearest = stored(search.best(search.anchors.withColumn("positives", F.lit(None).cast("array<long>")), positives, band), "negatives-positives")
    own = nearest.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_p"))  # a few for each anchor
    asked = search.anchors.join(own.select("block", "place", F.col("_p")["score"].alias("positives")), ["block", "place"])
    found = search.best(asked, negatives, band)
    pairs = nearest.select("block", "place", (F.col("rank") - 1).alias("nth"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))

    def known(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)

    return (found.withColumnsRenamed({"other": "negative_id", "score": "negative_score"}).join(pairs, ["block", "place", "nth"])
            .select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"))
