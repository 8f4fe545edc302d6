"""A stored vector index: inverted lists of product-quantised codes, with upserts, deletions, filters and exact re-ranking.

Rows are dealt to cells, each the surrounding of a centre, and written by cell with a code of a few bytes. A search reads
the codes of the cells next to its queries, ranks them by the distance of the codes, and computes exact distances only
for the best of them. The model is fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.numbers import half_up
from ..sources.files import read_parted, write_parted
from .neighbours import batch_top_k

TRAIN_ROWS = 20_000  # rows the model is fitted on, those with the smallest hashes
MAX_CELLS, PARTS, CODES = 4096, 16, 256
ROUNDS = 8
BLOCK_ROWS = 4096  # rows compared with the centres at a time
CHUNK_ROWS = 1 << 19  # codes that stream past a block of queries in one task
QUERY_BLOCK, POOL_ROWS = 256, 1 << 21  # queries of a block, at most; rows that a task holds for them
SEARCH_BLOCKS, FEW_QUERIES = 24, 16  # blocks of queries, at least, unless that leaves so few in a block
MARKS = "load INT, base BOOLEAN, records BIGINT"


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between two sets of rows."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _centres(data: np.ndarray, count: int) -> np.ndarray:
    """k-means centres; begins with evenly spaced distinct rows, a centre without rows stays where it is."""
    distinct = np.unique(data, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        nearest = _gaps(data, centres).argmin(1)
        size = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, data)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class Model:
    """Centres of the cells, and for each part of the coordinates the centres of what is left."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.bounds = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, data: np.ndarray, cells: int) -> Model:
        centres = _centres(data, cells)
        rest = data - centres[_gaps(data, centres).argmin(1)]
        parts = [p for p in np.array_split(np.arange(data.shape[1]), PARTS) if len(p)]
        return cls(centres, [_centres(rest[:, p], CODES) for p in parts])

    def cells(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([_gaps(data[i : i + BLOCK_ROWS], self.centres).argmin(1) for i in range(0, len(data), BLOCK_ROWS)] or [np.zeros(0, int)])

    def codes(self, data: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = data - self.centres[cells]
        return np.stack([_gaps(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each part of the queries to each code of that part, in a cell: part, code, query."""
        rest = np.ascontiguousarray((queries - self.centres[cell]).T)
        out, gap = np.zeros((len(self.books), CODES, len(queries))), np.empty((CODES, len(queries)))
        for own, a, book in zip(out, self.bounds, self.books):
            own[len(book) :] = np.inf
            for j in range(book.shape[1]):  # coordinate by coordinate, in memory that is used again
                near = np.subtract(book[:, j, None], rest[a + j], out=gap[: len(book)])
                own[: len(book)] += np.multiply(near, near, out=near)
        return out


class _Nearest:
    """The best rows found so far for the queries of a block, by distance and id; rows beyond a query's bound are not held."""

    def __init__(self, queries: int, ids: np.ndarray, kept: int):
        self.ids, self.kept, self.bound = ids, kept, np.full(queries, np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.rows, self.limit = 0, 2 * queries * kept + BLOCK_ROWS * QUERY_BLOCK

    def add(self, query: np.ndarray, about: np.ndarray, first: int) -> None:
        """Distances (query x row) of the rows from number ``first`` on."""
        row, column = np.nonzero(about <= self.bound[query][:, None])
        self.found.append((query[row], about[row, column], column + first))
        self.rows += len(row)
        if self.rows > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, about, row = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((self.ids[row], about, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = order[place < self.kept]
        self.found = [(query[place < self.kept], about[best], row[best])]
        self.rows, last = len(best), order[place == self.kept - 1]
        self.bound[query[place == self.kept - 1]] = about[last]
        return self.found[0]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, width))


class VectorIndex:
    """An index in a folder that all executors read.

    Tables: ``model``; ``rows/load=N/cell=C`` (id, attributes, code, vector); ``ids/load=N`` (what the load brings or
    removes); ``marks`` (the loads that are complete). A row of an older load holds unless a later load names its id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        found = spark.read.parquet(self._path("model")).collect()  # at most MAX_CELLS centres and CODES codes a part
        found.sort(key=lambda r: (r.part, r.number))
        parts = [np.array([r.centre for r in found if r.part == p]) for p in range(-1, max(r.part for r in found) + 1)]
        self.model = Model(parts[0], parts[1:])

    @staticmethod
    def build(rows: DataFrame, folder: str, id_column: str = "id", vector: str = "embedding", attributes: list[str] | None = None,
              cells: int | None = None) -> VectorIndex:
        """Fit the model, then index every row; ids are unique. ``cells``: the root of the number of rows by default."""
        spark = rows.sparkSession
        cells = cells or min(MAX_CELLS, max(1, math.isqrt(rows.count())))
        sample = rows.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_column), id_column).limit(TRAIN_ROWS)

        def fit(batches):
            data = np.vstack([m for m in (_matrix(b["v"], 0) for b in batches) if len(m)])
            model = Model.fit(data, cells)
            for part, centres in enumerate([model.centres, *model.books], start=-1):
                yield pd.DataFrame({"part": part, "number": np.arange(len(centres)), "centre": list(centres)})

        sample.repartition(1).mapInPandas(fit, "part int, number int, centre array<double>").write.parquet(os.path.join(folder, "model"))
        index = VectorIndex(spark, folder)
        index._write(rows, id_column, vector, attributes or [], True)
        return index

    def upsert(self, rows: DataFrame, id_column: str = "id", vector: str = "embedding", attributes: list[str] | None = None) -> None:
        """Index new rows; they replace those with the same id. The lists written before are neither read nor changed."""
        self._write(rows, id_column, vector, attributes or [], False)

    def delete(self, ids: DataFrame, id_column: str = "id") -> None:
        load = self._next()
        self._ids(ids, id_column, load)
        self._mark(load, False, 0)

    def compact(self) -> None:
        """One new load with all rows that hold."""
        rows = self.rows()
        self._write(rows, "id", "vector", [c for c in rows.columns if c not in ("id", "vector", "code", "cell")], True)

    def _path(self, *names: str) -> str:
        return os.path.join(self.folder, *names)

    def _marks(self) -> list:
        self.spark.range(0).selectExpr(*[f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in MARKS.split(", ")]).write.mode("ignore").parquet(self._path("marks"))
        return sorted(self.spark.read.schema(MARKS).parquet(self._path("marks")).collect())  # one row for each load

    def _next(self) -> int:
        return max((m.load + 1 for m in self._marks()), default=0)

    def _mark(self, load: int, base: bool, records: int) -> None:
        self.spark.range(0, 1, 1, 1).select(F.lit(load).alias("load"), F.lit(base).alias("base"), F.lit(records).cast("bigint").alias("records")).write.mode("append").parquet(self._path("marks"))

    def _ids(self, rows: DataFrame, id_column: str, load: int) -> None:
        rows.select(F.col(id_column).alias("id")).write.mode("overwrite").parquet(self._path("ids", f"load={load}"))

    def _write(self, rows: DataFrame, id_column: str, vector: str, attributes: list[str], base: bool) -> None:
        load, model = self._next(), self.model
        plain = rows.select(F.col(id_column).alias("id"), *attributes, F.col(vector).cast("array<double>").alias("vector"))

        def code(batches):
            for pdf in batches:
                data = _matrix(pdf["vector"], model.centres.shape[1])
                cell = model.cells(data)
                yield pdf.assign(code=[c.tobytes() for c in model.codes(data, cell)], cell=cell.astype("int32"))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        coded = plain.mapInPandas(code, f"{fields}, code binary, cell int")
        path = self._path("rows", f"load={load}")
        # ranges of (cell, id): a cell with very many rows is written by several tasks
        write_parted(coded.repartitionByRange("cell", "id"), path, "cell")
        written = read_parted(self.spark, path)
        if not base:
            self._ids(written, "id", load)
        self._mark(load, base, written.count())

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that hold; with ``cells`` only their folders are read."""
        marks = self._marks()
        first = max(m.load for m in marks if m.base)
        live = [m for m in marks if m.load >= first]
        out = None
        for m in live:
            if m.records:
                part = read_parted(self.spark, self._path("rows", f"load={m.load}"))
                part = part if cells is None else part.filter(F.col("cell").isin(cells))
                if later := [n.load for n in live if n.load > m.load]:
                    part = part.join(self.spark.read.parquet(*[self._path("ids", f"load={n}") for n in later]).select("id"), "id", "left_anti")
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """The ``probes`` nearest cells of each query."""
        centres = self.model.centres

        def run(batches):
            for pdf in batches:
                gaps = _gaps(_matrix(pdf["v"], centres.shape[1]), centres)
                yield pd.DataFrame({"q": pdf["q"], "v": pdf["v"], "cells": [c.astype("int32") for c in np.argsort(gaps, 1, kind="stable")[:, :probes]]})

        return queries.mapInPandas(run, "q bigint, v array<double>, cells array<int>")

    def search(self, queries: DataFrame, k: int, query_id: str = "id", vector: str = "embedding", probes: int = 8, kept: int = 0,
               where: Column | None = None) -> DataFrame:
        """query_id, neighbour_id, distance (squared L2), rank: about the k nearest rows of each query.

        ``probes`` cells are read for a query, and ``kept`` rows (ten times k by default) ranked by exact distance; all
        cells and as many rows as there are give the exact answer. ``where`` filters rows by their attributes before
        they are ranked.

        A block of queries lies still in a task while the codes of their cells stream past it, so that only the best
        rows of a query leave the task, not those of each cell it visits.
        """
        kept = max(kept or 10 * k, k)
        asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
        n = max(1, asked.count())
        blocks = max(min(SEARCH_BLOCKS, math.ceil(n / FEW_QUERIES)), math.ceil(n / max(1, min(QUERY_BLOCK, POOL_ROWS // kept))))
        visits = self._visits(asked, probes).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        visited = visits.select(F.col("block").alias("visitors"), F.explode("cells").alias("cell")).distinct()
        cells = sorted(r.cell for r in visited.select("cell").distinct().collect())  # numbers of cells, at most MAX_CELLS
        rows = self.rows(cells)
        found = rows if where is None else rows.filter(where)
        chunks = max(1, math.ceil(found.count() / CHUNK_ROWS))
        codes = found.select("cell", "id", "code").join(visited, "cell").select(
            F.col("visitors").alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "cell", "id", "code")
        dealt = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        model = self.model

        def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"q": [], "id": [], "cell": [], "about": []})
            right = right.sort_values("cell", kind="stable")
            code = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            ids, cell, vectors = right["id"].to_numpy(), right["cell"].to_numpy(), _matrix(left["v"], model.centres.shape[1])
            names, number = np.unique(left["q"].to_numpy(), return_inverse=True)
            visitor, wanted = np.repeat(np.arange(len(left)), left["cells"].map(len)), np.concatenate(left["cells"].to_numpy())
            best = _Nearest(len(names), ids, kept)
            for c in np.unique(cell):
                own = visitor[wanted == c]
                table = model.tables(vectors[own], c)
                first, end = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
                about, more = np.empty((2, min(BLOCK_ROWS, end - first), len(own)))
                for start in range(first, end, BLOCK_ROWS):
                    part = code[start : min(end, start + BLOCK_ROWS)]
                    np.take(table[0], part[:, 0], axis=0, out=about[: len(part)], mode="clip")
                    for j in range(1, part.shape[1]):
                        about[: len(part)] += np.take(table[j], part[:, j], axis=0, out=more[: len(part)], mode="clip")
                    best.add(number[own], about[: len(part)].T, start)
            query, about, row = best.cut()
            return pd.DataFrame({"q": names[query], "id": ids[row], "cell": cell[row], "about": about})

        # A block is little to read and much to compute: with a number of their own, partitions are not put together by their size.
        dealt, codes = (side.repartition(blocks * chunks, "block", "chunk") for side in (dealt, codes))
        near = dealt.groupBy("block", "chunk").cogroup(codes.groupBy("block", "chunk")).applyInPandas(rank, "q bigint, id bigint, cell int, about double")
        if chunks > 1:
            near = _first(near, [F.col("about"), F.col("id")], kept)
        # only the best rows' vectors leave the scan
        vectors = rows.select("cell", "id", "vector").join(near.select("q", "cell", "id"), ["cell", "id"]).join(asked, "q")
        distance = F.aggregate(F.zip_with("vector", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        exact = vectors.select("q", "id", half_up(distance, 9).alias("distance"))
        return _first(exact, [F.col("distance"), F.col("id")], k).select(
            F.col("q").alias("query_id"), F.col("id").alias("neighbour_id"), "distance", F.col("place").cast("int").alias("rank"))

    def recall(self, queries: DataFrame, k: int, truth: DataFrame, query_id: str = "id", vector: str = "embedding", **options) -> float:
        """Share of the exact neighbours (``truth``: query_id, distance) that a search finds; equal distances count as found."""
        mine = self.search(queries, k, query_id, vector, **options).select("query_id", "distance")
        last = truth.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("wanted"))
        found = mine.join(last, "query_id").filter(F.col("distance") <= F.col("last")).groupBy("query_id").agg(F.count("*").alias("found"))
        share = F.least(F.coalesce("found", F.lit(0)) / F.col("wanted"), F.lit(1.0))
        return last.join(found, "query_id", "left").agg(F.avg(share).alias("r")).first()["r"] or 0.0

    def tuned(self, queries: DataFrame, k: int, target: float, query_id: str = "id", vector: str = "embedding",
              where: Column | None = None) -> tuple[dict[str, int], float]:
        """(probes and kept for ``search``, recall): both are doubled until a stated set of queries reaches the recall.

        Numbers of probes that cannot reach it, as the answers lie in other cells, are passed over without a search.
        """
        rows = self.rows() if where is None else self.rows().filter(where)
        # every round is held against the same answers: they are found once
        truth = session.kept(batch_top_k(rows, queries.select(query_id, F.col(vector).alias("vector")), k, id_column="id", vector="vector", query_id=query_id), "truth")
        options, cells = {"probes": min(4, len(self.model.centres)), "kept": 10 * k}, len(self.model.centres)
        total, rounds = sum(m.records for m in self._marks()), []
        while not rounds or rounds[-1]["probes"] < cells or rounds[-1]["kept"] < total:
            rounds.append(options)
            options = {"probes": min(cells, 2 * options["probes"]), "kept": 2 * options["kept"]}
        within = self._within(queries, truth, rows, sorted({r["probes"] for r in rounds}), query_id, vector)
        # a round whose cells hold too few of the answers need not be searched
        for options in [r for r in rounds[:-1] if within[r["probes"]] >= target] + rounds[-1:]:
            reached = self.recall(queries, k, truth, query_id, vector, where=where, **options)
            if reached >= target:
                break
        return options, reached

    def _within(self, queries: DataFrame, truth: DataFrame, rows: DataFrame, probes: list[int], query_id: str, vector: str) -> dict[int, float]:
        """For each number of probes the recall that no search can exceed: answers in the cells it reads, and equals of the last answer."""
        asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
        visits = self._visits(asked.withColumnRenamed("query_id", "q"), max(probes)).select(F.col("q").alias("query_id"), "cells")
        last = truth.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("wanted"))
        cells = rows.select(F.col("id").alias("neighbour_id"), "cell").join(truth, "neighbour_id").join(visits, "query_id").join(last, "query_id")
        place = F.array_position("cells", F.col("cell"))
        found = cells.groupBy("query_id").agg(*[F.count_if((place > 0) & (place <= p) | (F.col("distance") == F.col("last"))).alias(f"n{p}") for p in probes])
        shares = [F.avg(F.least(F.coalesce(f"n{p}", F.lit(0)) / F.col("wanted"), F.lit(1.0))) for p in probes]
        return dict(zip(probes, [s or 0.0 for s in last.join(found, "query_id", "left").agg(*shares).first()]))


def _first(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("place") <= k)
