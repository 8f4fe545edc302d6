"""Exact and approximate k nearest neighbours.

Copies of a vector are merged first, so a group of copies costs one vector. Distinct vectors are assigned
to the nearest of a few pivots. A query visits only the cells that can hold one of its k nearest rows, by
the triangle inequality (Voronoi pruning as in Lu et al., "Efficient processing of k nearest neighbor joins
using MapReduce", 2012). Small tables are cut into blocks of bounded size; each pair of blocks is one matrix product
that emits k rows per query, never all pairs.

Large ones travel as packed pieces of a cell. A block of queries, bounded in bytes, lies still in a task and a part of
the pieces streams past it: the vectors are shuffled once for each block and once for each part, whose numbers are
chosen so that the least is shuffled (``_grid``). A task keeps k rows of a query at a time and a bound that starts at
the k-th row near the query in its own piece and only falls. Rows beyond it, and cells that lie beyond it, are never emitted.

Rows of a piece lie in leaves of near ones. A leaf has a box, in the directions in which the vectors spread most, and
only the queries whose bound reaches the box are multiplied with its rows: a few in a hundred, not all of a cell's visitors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

CELL_ROWS = 2048
QUERY_ROWS = 1000  # queries that one scan answers
MAX_PIVOTS = 4096
PIVOTS_FROM = 16  # fewer blocks of rows than this are multiplied outright, without pivots
SEARCH_CELLS, PIECE_CELLS = 4, 16  # times CELL_ROWS: rows of a cell of the exact search, on average, and of one piece of it, at most
LEAF_ROWS, BOX_SIDES = 128, 16  # rows of a leaf; directions in which a box is known
BOUND_ROWS = 1024  # rows next to a query among which its first bound is found
BLOCK_BYTES = 448 << 20  # queries that lie in one task, and the rows found for them
PART_BYTES = 512 << 20  # vectors that stream past a block in one task
SEARCH_TASKS = 24  # pairs of a block of queries and a part of the rows, at least
FOUND_BYTES, HELD_BYTES = 24, 16  # of a row found, as it is shuffled and in a task
VISIT_ROWS, VISIT_QUERIES = 8192, 16384  # blocks of a cell and of its visitors in the approximate search
VISIT_BYTES = 8 << 20
ASKED_TILE = 64  # queries of a batch that are compared with CELL_ROWS rows at a time
TILE = 1024  # queries of one matrix product
TESTED = 1 << 12  # queries that are compared with the boxes of a piece at a time
PAIRS = 1 << 14  # pairs whose distance is taken at a time
FOUND_ROWS = 1 << 20  # rows found that a task sorts at a time
SLACK = 1e-6  # distances are compared with this margin, so rounding never prunes a neighbour
QUANTUM = 1e9  # distances order by 1e-9 steps, then by id


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``vector`` (doubles) scaled to length 1, with one extra coordinate that holds 1 for a zero vector.

    A zero vector then has similarity 0 to all others. The length is a column of its own: inside the
    lambda it would be computed again for every coordinate.
    """
    measured = df.withColumn("_length", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)))
    length = F.nullif(F.col("_length"), F.lit(0.0))
    scaled = F.concat(
        F.transform(vector, lambda x: F.coalesce(x / length, F.lit(0.0))),
        F.array(F.when(F.col("_length") > 0, F.lit(0.0)).otherwise(F.lit(1.0))))
    return measured.withColumn(vector, scaled).drop("_length")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _dense(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between two sets of rows."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """A fixed pseudo-random choice of distinct vectors; ``count`` bounds what reaches the driver."""
    chosen = rows.select("vec").orderBy(F.xxhash64("rep"), "rep").limit(count).collect()
    return np.array([r.vec for r in chosen], dtype="float64")


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot (cell) and the distance to it."""

    def run(batches):
        for batch in batches:
            if len(batch):
                gaps = _gaps(_dense(batch.column("vec")), pivots)
                nearest = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), pa.array(nearest.astype("int32")), pa.array(gaps[np.arange(len(batch)), nearest])],
                                                 ["rep", "vec", "cell", "gap"])

    return rows.select("rep", "vec").mapInArrow(run, "rep bigint, vec array<double>, cell int, gap double")


def _visits(queries: DataFrame, pivots: np.ndarray, filled: np.ndarray, probes: int) -> DataFrame:
    """The ``probes`` nearest cells of each query (approximate)."""

    def run(batches):
        for pdf in batches:
            gaps = _gaps(_matrix(pdf["vec"]), pivots)
            nearest = np.argsort(gaps, 1, kind="stable")[:, :probes]
            yield pd.DataFrame({"rep": pdf["rep"], "vec": pdf["vec"], "cells": [n[filled[n]].astype("int32") for n in np.sort(nearest, 1)]})

    visits = queries.select("rep", "vec").mapInPandas(run, "rep bigint, vec array<double>, cells array<int>")
    return visits.select("rep", "vec", F.explode("cells").alias("cell"))


def _smallest(steps: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest whole-number distances per row; ties go to the smaller column."""
    columns = steps.shape[1]
    if k >= columns or steps.max() * columns >= 2.0**62:
        return np.argsort(steps, 1, kind="stable")[:, :k]
    keys = steps.astype("int64") * columns + np.arange(columns)
    near = np.argpartition(keys, k - 1, 1)[:, :k]
    order = np.argsort(np.take_along_axis(keys, near, 1), 1)
    return np.take_along_axis(near, order, 1)


def _block_top(k: int, cosine: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "other": [], "distance": []})
        right = right.sort_values("rep")
        ids, data = right["rep"].to_numpy(), _matrix(right["vec"])
        found = []
        for start in range(0, len(left), TILE):
            part = left.iloc[start : start + TILE]
            asked, query = part["rep"].to_numpy(), _matrix(part["vec"])
            if cosine:
                distance = 1.0 - query @ data.T
            else:
                distance = np.maximum((query * query).sum(1)[:, None] + (data * data).sum(1)[None, :] - 2.0 * query @ data.T, 0.0)
            steps = np.floor(distance * QUANTUM + 0.5)
            best = _smallest(steps, k)
            found.append(pd.DataFrame({
                "rep": np.repeat(asked, best.shape[1]), "other": ids[best].ravel(),
                "distance": np.take_along_axis(steps, best, 1).ravel() / QUANTUM}))
        return pd.concat(found)

    return run


def _blocks(rows: list[int], size: int) -> Column:
    """Literal array: number of blocks of each cell."""
    return F.array(*[F.lit(max(1, math.ceil(int(n) / size))) for n in rows])


def _pairs(assigned: DataFrame, visits: DataFrame, rows: list[int], visiting: list[int], k: int, cosine: bool,
           cell_rows: int, query_rows: int) -> DataFrame:
    """Top k of the visited cells, one matrix product for each block of a cell and block of its visitors."""
    data_blocks, query_blocks = _blocks(rows, cell_rows), _blocks(visiting, query_rows)
    here = F.col("cell") + 1
    left = visits.withColumn(
        "qb", F.pmod(F.xxhash64("rep"), F.element_at(query_blocks, here)).cast("int")).withColumn(
        "db", F.explode(F.sequence(F.lit(0), F.element_at(data_blocks, here) - 1)))
    right = assigned.select("rep", "vec", "cell").withColumn(
        "db", F.pmod(F.xxhash64("rep"), F.element_at(data_blocks, here)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.element_at(query_blocks, here) - 1)))
    keys = ["cell", "qb", "db"]
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # own attributes: both sides may be the same table
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _block_top(k, cosine), "rep bigint, other bigint, distance double")
    return _first(partial, ["rep"], [F.col("distance"), F.col("other")], k)


def _direct(data: DataFrame, queries: DataFrame, n: int, asked: int, k: int, cosine: bool) -> DataFrame:
    """All blocks of rows with all blocks of queries."""
    return _pairs(data.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), [n], [asked], k, cosine, CELL_ROWS, CELL_ROWS)


def _order(pivots: np.ndarray) -> np.ndarray:
    """Numbers of the pivots such that near ones mostly have near numbers: halves by the coordinate of the largest spread."""
    def split(own: np.ndarray) -> list[int]:
        if len(own) < 2:
            return own.tolist()
        axis = pivots[own].var(0).argmax()
        own = own[np.argsort(pivots[own, axis], kind="stable")]
        return split(own[: len(own) // 2]) + split(own[len(own) // 2 :])

    return np.array(split(np.arange(len(pivots))))


def _steps(distance: np.ndarray) -> np.ndarray:
    return np.floor(distance * QUANTUM + 0.5)


def _between(queries: np.ndarray, row: np.ndarray, data: np.ndarray, column: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of the pairs queries[row], data[column]."""
    out = np.empty(len(row))
    for start in range(0, len(row), PAIRS):
        own = slice(start, start + PAIRS)
        if cosine:
            out[own] = 1.0 - np.einsum("ij,ij->i", queries[row[own]], data[column[own]])
        else:
            gap = queries[row[own]] - data[column[own]]
            out[own] = np.einsum("ij,ij->i", gap, gap)
    return out


def _axes(vectors: np.ndarray) -> np.ndarray:
    """The directions in which the vectors spread most, as columns."""
    centred = vectors - vectors.mean(0)
    spread = centred.T @ centred
    axes = np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(vectors.shape[1])
    return axes[:, :BOX_SIDES]


def _by_leaves(sides: np.ndarray) -> np.ndarray:
    """An order in which LEAF_ROWS rows that follow each other are near: halves along the side of the largest spread."""
    def split(own: np.ndarray) -> list[np.ndarray]:
        if len(own) <= LEAF_ROWS:
            return [own]
        part = sides[own]
        half = math.ceil(len(own) / LEAF_ROWS) // 2 * LEAF_ROWS
        order = np.argpartition(part[:, part.var(0).argmax()], half - 1)
        return split(own[order[:half]]) + split(own[order[half:]])

    return np.concatenate(split(np.arange(len(sides))))


def _starts(rows: int) -> np.ndarray:
    return np.arange(0, rows, LEAF_ROWS)


def _beside(low: np.ndarray, high: np.ndarray, own_low: np.ndarray, own_high: np.ndarray) -> np.ndarray:
    """Squares of the distances between boxes (side x box), as far as the sides tell: box x own box."""
    square, gap, other = np.zeros((3, low.shape[1], own_low.shape[1]), "float32")  # memory that is new for each side costs more than the sums
    for side in range(len(low)):
        np.subtract(own_low[side], high[side, :, None], out=gap)
        np.subtract(low[side, :, None], own_high[side], out=other)
        np.maximum(gap, other, out=gap)
        np.maximum(gap, np.float32(0), out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(square, gap, out=square)
    return square


def _packed(assigned: DataFrame, axes: np.ndarray, k: int, cosine: bool) -> DataFrame:
    """Rows of a piece of a cell as one row of bytes, by leaves, each with the distance of its k-th row nearby (in steps)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep").combine_chunks()
        vecs = _dense(rows.column("vec").chunk(0))
        order = _by_leaves(vecs @ axes)
        vecs, reps, bound = np.ascontiguousarray(vecs[order]), rows.column("rep").to_numpy()[order], np.full(len(rows), np.inf)
        if len(rows) >= k:
            size, wide = (vecs * vecs).sum(1), max(k, BOUND_ROWS)
            error = _steps(8 * np.finfo(float).eps * (vecs.shape[1] + 8) * (size + size.max()))  # of a difference of large squares
            for start in range(0, len(rows), BOUND_ROWS):
                own, first = slice(start, start + BOUND_ROWS), max(0, min(start, len(rows) - wide))
                near = vecs[first : first + wide]
                distance = 1.0 - vecs[own] @ near.T if cosine else np.maximum(size[own, None] + size[None, first : first + wide] - 2.0 * vecs[own] @ near.T, 0.0)
                bound[own] = _steps(np.partition(distance, k - 1, 1)[:, k - 1]) + 1 + error[own]
        return pa.table({"cell": pa.array([key[0].as_py()], "int32"), "piece": pa.array([key[1].as_py()], "int32"), "radius": pa.array([float(pc.max(rows.column("gap")).as_py())], "float64"),
                         "reps": pa.array([reps.astype("int64").tobytes()], "binary"), "vecs": pa.array([vecs.tobytes()], "binary"), "bounds": pa.array([bound.tobytes()], "binary")})

    return assigned.groupBy("cell", "piece").applyInArrow(run, "cell int, piece int, radius double, reps binary, vecs binary, bounds binary")


class _Block:
    """Queries that lie in a task, their bounds and the best rows found so far."""

    def __init__(self, packs: list, k: int, cosine: bool, axes: np.ndarray | None = None):
        self.reps = np.concatenate([np.frombuffer(p["reps"], "int64") for p in packs])
        self.vecs = np.concatenate([np.frombuffer(p["vecs"]) for p in packs]).reshape(len(self.reps), -1)
        self.bound = np.concatenate([np.frombuffer(p["bounds"]) for p in packs])
        self.size = (self.vecs * self.vecs).sum(1)
        self.single = np.empty((len(self.reps), self.vecs.shape[1] + 1), "float32")
        self.single[:, :-1], self.single[:, -1] = self.vecs, -1.0
        self.k, self.cosine, self.found, self.rows = k, cosine, [], 0
        self.steps, self.ids = np.full((len(self.reps), k), np.inf), np.full((len(self.reps), k), np.iinfo("int64").max)
        self.axes = _axes(self.vecs) if axes is None else axes
        self.origin = self.vecs[0] @ self.axes
        self.sides = self._sides(self.vecs)
        ends = np.cumsum([0, *(len(p["reps"]) // 8 for p in packs)])
        self.first = np.concatenate([a + _starts(b - a) for a, b in zip(ends, ends[1:])])
        self.low, self.high = np.minimum.reduceat(self.sides, self.first, 1), np.maximum.reduceat(self.sides, self.first, 1)
        self.product, self.below = np.empty(TILE * LEAF_ROWS, "float32"), np.empty(TILE * LEAF_ROWS, bool)
        self.most = FOUND_ROWS + len(self.reps) * k // 4  # rows that wait to be sorted
        self.widest, self.longest = float(np.abs(self.sides).max()), math.sqrt(self.size.max())

    def _sides(self, vectors: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray((vectors @ self.axes - self.origin).T, "float32")

    def _reach(self, limit: np.ndarray) -> np.ndarray:
        return np.sqrt(2 * limit) if self.cosine else np.sqrt(limit)  # unit vectors: the square of the gap is twice the distance

    def visit(self, pivot: np.ndarray, pack) -> None:
        """Rows of a piece, whose cell has ``pivot``, that lie within the bounds."""
        ids = np.frombuffer(pack["reps"], "int64")
        data = np.frombuffer(pack["vecs"]).reshape(len(ids), -1)
        size, sides, leaves = (data * data).sum(1), self._sides(data), _starts(len(ids))
        low, high = np.minimum.reduceat(sides, leaves, 1), np.maximum.reduceat(sides, leaves, 1)
        all_low, all_high = low.min(1)[:, None], high.max(1)[:, None]
        # Single precision finds what may lie within the bounds, double precision decides. A distance is base - scale * product.
        half = 0.0 if self.cosine else size / 2
        wide = np.column_stack([data, np.zeros(len(ids)) + half]).astype("float32")
        error = (data.shape[1] + 8) * np.finfo("float32").eps * (np.sqrt(size.max(initial=0.0)) + np.max(half, initial=0.0))
        # Rounding of the sides, as a distance; a box lies beyond a bound only if it does so by more.
        rounding = 8 * math.sqrt(len(sides)) * (np.finfo("float32").eps * (self.widest + float(np.abs(sides).max(initial=0.0)))
                                                    + np.finfo(float).eps * data.shape[1] * (self.longest + math.sqrt(size.max(initial=0.0))))

        def square(reach: np.ndarray) -> np.ndarray:
            return np.nextafter((((reach + rounding) * (1 + 1e-5)) ** 2).astype("float32"), np.float32(np.inf))

        farthest = square(self._reach((np.maximum.reduceat(self.bound, self.first) + 1) / QUANTUM))
        open_ = ~(_beside(all_low, all_high, self.low, self.high)[0] > farthest)
        near = np.flatnonzero(np.repeat(open_, np.diff(np.append(self.first, len(self.reps)))))
        reaching = [[] for _ in leaves]
        for start in range(0, len(near), TESTED):
            own = near[start : start + TESTED]
            reach, at = self._reach((self.bound[own] + 1) / QUANTUM), self.sides[:, own]
            inside = np.flatnonzero(~(_beside(all_low, all_high, at, at)[0] > square(reach)))
            own, reach = own[inside], reach[inside]
            gap = np.sqrt(np.maximum(self.size[own] + pivot @ pivot - 2.0 * self.vecs[own] @ pivot, 0.0))
            slack = 4 * np.sqrt(np.finfo(float).eps * data.shape[1] * (self.size[own] + pivot @ pivot))  # of a gap, also of the radius
            inside = np.flatnonzero(~(gap - pack["radius"] > reach + SLACK * (1 + gap) + slack))
            own, at, reach = own[inside], self.sides[:, own[inside]], reach[inside]
            touched = ~(_beside(low, high, at, at) > square(reach))
            for leaf in np.flatnonzero(touched.any(1)):
                reaching[leaf].append(own[touched[leaf]])
        for leaf, queries in zip(leaves, reaching):
            if queries:
                self._multiply(np.concatenate(queries), slice(leaf, leaf + LEAF_ROWS), ids, data, wide, error)

    def _multiply(self, queries: np.ndarray, rows: slice, ids: np.ndarray, data: np.ndarray, wide: np.ndarray, error: float) -> None:
        """Rows of a leaf that lie within the bounds of the queries that reach it."""
        ids, data, wide = ids[rows], data[rows], wide[rows].T
        for start in range(0, len(queries), TILE):
            own = queries[start : start + TILE]
            limit = (self.bound[own] + 1) / QUANTUM
            least = (1.0 - limit if self.cosine else (self.size[own] - limit) / 2) - error * (1 + np.sqrt(self.size[own]))
            least = np.where(np.isfinite(least), least, -np.inf).astype("float32")
            least = np.nextafter(least, np.float32(-np.inf))
            product, below = self.product[: len(own) * len(ids)].reshape(len(own), -1), self.below[: len(own) * len(ids)].reshape(len(own), -1)
            np.matmul(self.single[own], wide, out=product)
            np.less(product, least[:, None], out=below)
            maybe = np.flatnonzero(np.logical_not(below, out=below))
            row, column = np.divmod(maybe, len(ids))
            distance = _between(self.vecs, own[row], data, column, self.cosine)
            inside = distance <= limit[row]
            row, column, steps = row[inside], column[inside], _steps(distance[inside])
            if len(row):
                self.found.append((own[row], steps, ids[column]))
                self.rows += len(row)
            if self.rows > self.most:
                self.keep()

    def keep(self) -> None:
        """Only the k best rows of each query stay, by distance and id; queries without new rows are not looked at."""
        if not self.found:
            return
        query, steps, ids = (np.concatenate(c) for c in zip(*self.found))
        self.found, self.rows, k = [], 0, self.k
        order = np.argsort(query, kind="stable")
        query, steps, ids = query[order], steps[order], ids[order]
        asked, first = np.unique(query, return_index=True)
        first = np.append(first, len(query))
        some = max(1, FOUND_ROWS // k)
        for start in range(0, len(asked), some):
            own = asked[start : start + some]
            new = slice(first[start], first[start + len(own)])
            number = np.concatenate([np.repeat(np.arange(len(own)), k), np.searchsorted(own, query[new])])
            far, name = np.concatenate([self.steps[own].ravel(), steps[new]]), np.concatenate([self.ids[own].ravel(), ids[new]])
            order = np.lexsort((name, far, number))
            best = order[np.searchsorted(number[order], np.arange(len(own)))[:, None] + np.arange(k)]
            self.steps[own], self.ids[own] = far[best], name[best]
            self.bound[own] = np.minimum(self.bound[own], far[best[:, -1]])

    def result(self, first: int = 0, end: int | None = None) -> pd.DataFrame:
        """The best rows of the queries from number ``first`` to ``end``."""
        self.keep()
        query, place = np.nonzero(np.isfinite(self.steps[first:end]))
        query += first
        return pd.DataFrame({"rep": self.reps[query], "other": self.ids[query, place], "distance": self.steps[query, place] / QUANTUM})


def _streamed(k: int, cosine: bool, pivots: np.ndarray, axes: np.ndarray):
    """Answers the blocks of a partition: the pieces of a block come first, then the rows that stream past it."""

    def run(batches):
        task, packs, block = None, [], None
        for batch in batches:
            for number in range(len(batch)):
                pack = batch.slice(number, 1).to_pylist()[0]  # one piece at a time, not a copy of the whole batch
                if pack["task"] != task:
                    if block:
                        yield from answer(block)
                    task, packs, block = pack["task"], [], None
                if not pack["streams"]:
                    packs.append(pack)
                elif packs:
                    if block is None:
                        block = _Block(packs, k, cosine, axes)
                        packs = [{}]  # the block has its own copy
                    block.visit(pivots[pack["cell"]], pack)
        if block:
            yield from answer(block)

    def answer(block: _Block):
        some = max(1, 100_000 // k)
        for first in range(0, len(block.reps), some):
            yield pa.RecordBatch.from_pandas(block.result(first, first + some), preserve_index=False)

    return run


def _grid(n: int, asked: int, width: int, k: int) -> tuple[int, int]:
    """Numbers of blocks of queries and parts of the rows: tasks enough, of bounded size, and the least bytes shuffled.

    Rows are sent to every block, queries to every part, and each part gives k rows for a query.
    """
    def parts(blocks: int) -> int:
        return max(1, math.ceil(n * width / PART_BYTES), min(math.ceil(SEARCH_TASKS / blocks), math.ceil(n / CELL_ROWS)))

    def sent(blocks: int) -> int:
        return blocks * n * width + parts(blocks) * asked * width + (parts(blocks) > 1) * parts(blocks) * asked * k * FOUND_BYTES

    least = max(1, math.ceil(asked * (width + k * HELD_BYTES) / BLOCK_BYTES))
    blocks = min(range(least, max(least, min(SEARCH_TASKS, math.ceil(asked / CELL_ROWS))) + 1), key=sent)
    return blocks, parts(blocks)


def _searched(data: DataFrame, queries: DataFrame | None, n: int, asked: int, k: int, cosine: bool) -> DataFrame:
    """Top k by blocks of queries that lie still while the rows stream past them; without ``queries`` all rows ask."""
    cells = min(MAX_PIVOTS, max(2, n // (SEARCH_CELLS * CELL_ROWS)))
    pivots = _pivots(data, cells)
    pivots = pivots[_order(pivots)]
    axes, width = _axes(pivots), 8 * pivots.shape[1]

    def packs(rows: DataFrame, label: str, bounded: bool) -> tuple[DataFrame, np.ndarray]:
        assigned = _assign(rows, pivots)
        count = np.zeros(cells, "int64")
        for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per pivot
            count[r.cell] = r.n
        piece = F.pmod(F.xxhash64("rep"), F.element_at(_blocks(count, PIECE_CELLS * CELL_ROWS), F.col("cell") + 1)).cast("int")
        return kept(_packed(assigned.withColumn("piece", piece), axes, k if bounded else n + asked + 1, cosine), f"{label}-packed"), count

    rows, count = packs(data, "data", True)
    asking, asking_count = (rows, count) if queries is None else packs(queries, "queries", False)
    blocks, parts = _grid(n, asked, width, k)
    # A piece belongs to the block at whose share of all queries it begins; cells of near numbers share a block.
    before = np.cumsum(asking_count) - asking_count
    share = [F.array(*[F.lit(float(x)) for x in c]) for c in (before / asked, asking_count / asked / np.maximum(1, np.ceil(asking_count / (PIECE_CELLS * CELL_ROWS))))]
    here = F.col("cell") + 1
    block = F.least(F.floor((F.element_at(share[0], here) + F.col("piece") * F.element_at(share[1], here)) * blocks), F.lit(blocks - 1)).cast("int")
    number, every = F.lit(parts), F.lit(blocks - 1)
    lying = asking.select(F.explode(F.sequence(F.lit(0), number - 1)).alias("part"), (block * parts).alias("first"), F.lit(False).alias("streams"), F.lit(0.0).alias("away"),
                          "cell", "piece", "radius", "reps", "vecs", "bounds")
    passing = rows.select(F.pmod(F.xxhash64("cell", "piece"), number).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), every)).alias("b"), "cell", "piece", "radius",
                          "reps", "vecs").select("part", (F.col("b") * parts).alias("first"), F.lit(True).alias("streams"),
                                                 F.abs(F.col("cell") - (F.col("b") + 0.5) * (cells / blocks)).alias("away"), "cell", "piece", "radius", "reps", "vecs",
                                                 F.lit(None).cast("binary").alias("bounds"))
    dealt = lying.unionByName(passing).withColumn("task", (F.col("first") + F.col("part")).cast("int")).drop("first", "part")
    dealt = dealt.repartitionById(blocks * parts, F.col("task")).sortWithinPartitions("task", "streams", "away", "cell", "piece")
    partial = dealt.mapInArrow(_streamed(k, cosine, pivots, axes), "rep bigint, other bigint, distance double")
    return partial if parts == 1 else _first(partial, ["rep"], [F.col("distance"), F.col("other")], k)


def _distinct_neighbours(data: DataFrame, queries: DataFrame, k: int, cosine: bool, probes: int | None, alike: bool) -> DataFrame:
    """Top k distinct vectors of every distinct query vector: (rep, other, distance).

    If the queries are ``alike``, the rows themselves but for the zero vector, the answer may also hold the zero vector's.
    """
    n = data.count()
    asked = n if alike else queries.count()
    if probes is not None:
        cells = min(MAX_PIVOTS, max(1, math.isqrt(n)))
        if cells == 1:
            return _direct(data, queries, n, asked, k, cosine)
        pivots = _pivots(data, cells)
        assigned = kept(_assign(data, pivots), "cells")
        rows, visiting = [0] * cells, [0] * cells
        for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per pivot
            rows[r.cell] = r.n
        visits = _visits(queries, pivots, np.array(rows) > 0, probes)
        for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per pivot
            visiting[r.cell] = r.n
        most = max(CELL_ROWS, VISIT_BYTES // (8 * pivots.shape[1]))
        return _pairs(assigned, visits, rows, visiting, k, cosine, min(VISIT_ROWS, most), min(VISIT_QUERIES, most))
    if n < PIVOTS_FROM * CELL_ROWS:
        return _direct(data, queries, n, asked, k, cosine)
    # A distance to or from a vector that is not finite is none: such queries, like all of a small table, meet every row.
    odd = F.coalesce(F.exists("vec", lambda x: F.coalesce(~(F.abs(x) < F.lit(float("inf"))), F.lit(True))), F.lit(True))
    sound = data.filter(~odd)
    m = sound.count()
    if m < max(k, PIVOTS_FROM * CELL_ROWS):
        return _direct(data, queries, n, asked, k, cosine)
    strange = queries.filter(odd)
    strangers = strange.count() if m < n or not alike else 0
    found = _searched(sound, None if alike else queries.filter(~odd), m, m if alike else max(1, asked - strangers), k, cosine)
    return found.unionByName(_direct(data, strange, n, strangers, k, cosine)) if strangers else found


def _first(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def nearest(data: DataFrame, k: int, *, id_column: str, vector: str, metric: str = "cosine",
            queries: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """k nearest rows of ``data`` for every query row (default: the data itself, self included).

    Returns (query_id, neighbour_id, distance, rank); ties go to the smaller id. ``metric`` is ``cosine``
    (1 - similarity) or ``l2`` (squared Euclidean). ``probes`` limits a query to its nearest cells, which
    makes the answer approximate.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    if k < 1:
        raise ValueError("k >= 1")
    cosine = metric == "cosine"

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.selectExpr(f"CAST({id_column} AS BIGINT) AS id", f"CAST({vector} AS ARRAY<DOUBLE>) AS vec")
        return unit_vectors(rows, "vec") if cosine else rows

    base = kept(prepared(data), "vectors")
    groups = kept(base.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "distinct-vectors")
    # A vector without copies stands for itself: only the others, mostly few, have to find their rows.
    shared = kept(groups.filter("n > 1").select("vec", "rep"), "shared-vectors")
    several = kept(base.join(shared, "vec").select("rep", "id"), "members")
    if queries is None:
        asked, askers = groups, several.unionByName(groups.filter("n = 1 AND vec IS NOT NULL").select("rep", F.col("rep").alias("id")))
    else:
        raw = prepared(queries)
        asked = raw.groupBy("vec").agg(F.min("id").alias("rep"))
        askers = raw.join(asked, "vec").select("rep", "id")
    if cosine:  # a zero query is equally far from everything: its neighbours are the smallest ids
        is_zero = F.element_at("vec", -1) == 1.0
        zero_asked, asked = asked.filter(is_zero), asked.filter(~is_zero)
    everything = groups.select("rep", "vec")
    wanted = everything if queries is None and not cosine else asked.select("rep", "vec")
    found = _distinct_neighbours(everything, wanted, k, cosine, probes, queries is None)
    if cosine and queries is None:
        found = found.join(F.broadcast(zero_asked.select("rep")), "rep", "left_anti")
    copies = kept(_first(several, ["rep"], [F.col("id")], k).select(F.col("rep").alias("other"), F.col("id").alias("_copy"), F.lit(True).alias("_copied")), "copies")
    spread = found.filter("other IS NOT NULL").join(copies, "other", "left").select(
        "rep", F.when(F.col("_copied"), F.col("_copy")).otherwise(F.col("other")).alias("neighbour_id"), "distance")
    if cosine:
        smallest = base.select("id").orderBy("id").limit(k).agg(F.collect_list("id")).scalar()
        spread = spread.unionByName(zero_asked.select(
            "rep", F.explode(smallest).alias("neighbour_id"), F.lit(1.0).alias("distance")))
    ranked = _first(spread, ["rep"], [F.col("distance"), F.col("neighbour_id")], k, "rank")
    return ranked.join(askers, "rep").select(
        F.col("id").alias("query_id"), "neighbour_id", "distance", F.col("rank").cast("int").alias("rank"))


def _direct_top(asked: np.ndarray, numbers: np.ndarray, k: int):
    """Keeps the k nearest rows of every Arrow batch for every query; squares are added coordinate by coordinate."""

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), CELL_ROWS):
                part = pdf.iloc[start : start + CELL_ROWS].sort_values("id")
                data = np.asfortranarray(_matrix(part["vec"]))
                for first in range(0, len(asked), ASKED_TILE):
                    own, names = asked[first : first + ASKED_TILE], numbers[first : first + ASKED_TILE]
                    total, gap = np.zeros((2, len(own), len(data)))
                    for j in range(data.shape[1]):
                        np.subtract(data[:, j], own[:, j, None], out=gap)
                        total += np.multiply(gap, gap, out=gap)
                    steps = np.floor(total * QUANTUM + 0.5)
                    best = _smallest(steps, k)
                    yield pd.DataFrame({
                        "query_id": np.repeat(names, best.shape[1]), "neighbour_id": part["id"].to_numpy()[best].ravel(),
                        "distance": np.take_along_axis(steps, best, 1).ravel() / QUANTUM})

    return run


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_column: str, vector: str,
                query_id: str, block_rows: int = QUERY_ROWS) -> DataFrame:
    """k nearest vectors (squared L2) for a batch of query vectors; 1 <= k <= 50.

    The queries are a stated set: they travel in blocks of about ``block_rows``, and one scan answers a block. Every
    block uses the same formula, so distances do not depend on the number of queries.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be 1..50")
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    found = None
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number).collect()
        if own:
            scan = rows.mapInPandas(_direct_top(np.array([r.v for r in own], dtype="float64"), np.array([r.q for r in own]), k),
                                    "query_id bigint, neighbour_id bigint, distance double")
            found = scan if found is None else found.unionByName(scan)
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance")).filter("false")
    ranked = _first(found, ["query_id"], [F.col("distance"), F.col("neighbour_id")], k, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))
