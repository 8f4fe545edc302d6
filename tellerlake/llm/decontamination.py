"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, free_of, hash_strings, lower_words, pieces, text_bytes, window_hashes

N = 5
PERCENT = 80
#: Hash functions. A segment that holds an item whole has a Jaccard similarity of 1/4 with it at least, so all of them
#: miss it with a chance below 0.75 ** 64 = 1e-8; one that holds 80 percent of it, below 0.81 ** 64 = 2e-6.
HASHES = 64
#: Text of the items that are searched for, and broadcast, at a time.
ITEM_BYTES = 8 << 20
MULTIPLIERS = (np.random.default_rng(7).integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) + np.uint32(1)


class Lookup:
    """The rows of sorted values that equal a query; a table of bits sends most queries away at once."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], rows[order]
        self.mask = values.dtype.type((1 << min(22, max(10, (64 * len(values)).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        self.bits[self.values & self.mask] = True

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row) of every pair with equal values."""
        maybe = np.flatnonzero(self.bits[queries & self.mask])
        a = np.searchsorted(self.values, queries[maybe], "left")
        hit = a < len(self.values)
        hit[hit] = self.values[a[hit]] == queries[maybe[hit]]
        maybe, a = maybe[hit], a[hit]
        times = np.searchsorted(self.values, queries[maybe], "right") - a
        at = np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(maybe, times), self.rows[at]


@dataclass(frozen=True)
class Items:
    """Test items with their shingles; for each size class and hash function their minima; for each number of words below ``n`` the short items."""

    ids: list
    shingles: list[frozenset[bytes]]
    grams: list[np.ndarray]
    index: dict[int, list[Lookup]]
    short: dict[int, Lookup]


@dataclass(frozen=True)
class Words:
    """The words of some texts; word i of text t is ``words[codes[bounds[t] + i]]``."""

    bounds: np.ndarray
    codes: np.ndarray
    words: list[bytes]
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        _, words, codes, text, _ = lower_words(texts)
        words = words.to_pylist()
        bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int64)
        return cls(bounds, codes, words, hash_strings(words)[codes] if words else np.zeros(0, np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, hashes, first words) of each text's n-grams in the order of the text; texts of fewer than ``n`` words have none."""
        counts = np.diff(self.bounds)
        many = np.maximum(counts - n + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(many)))
        if not bounds[-1]:
            return bounds, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], many)
        return bounds, window_hashes(self.hashes, n)[at], at

    def run(self, at: int, n: int) -> bytes:
        return b" ".join([self.words[c] for c in self.codes[at : at + n].tolist()])


def minima(grams: np.ndarray, starts: np.ndarray, i: int, buffer: np.ndarray) -> np.ndarray:
    """Smallest value of hash function ``i`` in each run of ``grams`` (32 bits) that begins at ``starts``."""
    return np.minimum.reduceat(np.multiply(grams, MULTIPLIERS[i], out=buffer), starts)


def index_items(rows: list[tuple], n: int) -> Items:
    """Index of (id, text) rows that have words. An item of fewer than ``n`` words is one shingle, its whole sequence."""
    found = Words.of(pa.array([t for _, t in rows], pa.large_string()))
    count = np.diff(found.bounds)
    bounds, hashes, first = found.grams(n)
    shingles: list[frozenset[bytes]] = []
    grams, short = [], {k: ([], []) for k in range(1, n)}
    for row, words in enumerate(count.tolist()):
        if words < n:
            shingles.append(frozenset([found.run(int(found.bounds[row]), words)] if words else []))
            grams.append(np.zeros(0, np.uint64))
            if words:
                short[words][0].append(row)
                short[words][1].append(int(found.bounds[row]))
        else:
            own = slice(int(bounds[row]), int(bounds[row + 1]))
            shingles.append(frozenset(found.run(at, n) for at in first[own].tolist()))
            grams.append(np.unique(hashes[own]))
    size = np.array([len(g) for g in grams], np.int64)
    long = np.flatnonzero(size)
    index: dict[int, list[Lookup]] = {}
    if len(long):
        flat = np.concatenate([grams[r] for r in long]).astype(np.uint32)
        starts, buffer = np.cumsum(size[long]) - size[long], np.empty_like(flat)
        kind = np.floor(np.log2(size[long])).astype(int)
        index = {int(k): [] for k in np.unique(kind)}
        for i in range(HASHES):
            low = minima(flat, starts, i, buffer)
            for k, own in index.items():
                own.append(Lookup(low[kind == k], long[kind == k]))
    runs = {k: Lookup(window_hashes(found.hashes, k)[at], np.array(rows_)) for k, (rows_, at) in short.items() if rows_}
    return Items([i for i, _ in rows], shingles, grams, index, runs)


def candidates(bounds: np.ndarray, grams: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (document, item) pairs of which some segment shares a minimum with the item.

    ``bounds`` and ``grams`` hold each document's n-grams in the order of the text. Items of 2^k to 2^(k+1) n-grams
    are looked for in segments of 2^(k+2), which begin every 2^(k+1): any item lies whole in one. Minima of segments
    are put together from those of short blocks.
    """
    length = np.diff(bounds)
    docs = np.flatnonzero(length)
    if not len(docs) or not items.index:
        return np.zeros((0, 2), dtype=np.int64)
    lowest, highest = min(items.index), max(items.index)
    block = 2 << lowest
    counts = -(-length[docs] // block)
    first = np.cumsum(counts) - counts
    starts = np.repeat(bounds[:-1][docs], counts) + block * (np.arange(int(counts.sum())) - np.repeat(first, counts))
    pairs, owners = {}, {lowest: np.repeat(docs, counts)}  # where blocks 0 and 1, 2 and 3, ... of a document begin in the class below
    for k in range(lowest + 1, highest + 1):
        new = (counts + 1) // 2
        begin, first = np.cumsum(counts) - counts, np.cumsum(new) - new
        pairs[k] = np.repeat(begin, new) + 2 * (np.arange(int(new.sum())) - np.repeat(first, new))
        counts, owners[k] = new, np.repeat(docs, new)
    together = {k: np.flatnonzero(owners[k][:-1] == owners[k][1:]) for k in items.index}
    small = grams.astype(np.uint32)
    buffer = np.empty_like(small)
    found = []
    for i in range(HASHES):
        low = minima(small, starts, i, buffer)
        for k in range(lowest, highest + 1):
            if k > lowest:
                low = np.minimum.reduceat(low, pairs[k])
            if k in items.index:
                segment = low.copy()
                segment[together[k]] = np.minimum(low[together[k]], low[together[k] + 1])
                at, item = items.index[k][i](segment)
                if len(at):
                    found.append(np.stack([owners[k][at], item], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def matches(texts: pa.Array, items: Items, n: int, percent: int) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of every pair in which the text holds ``percent`` of the item's shingles."""
    own = Words.of(texts)
    bounds, grams, first = own.grams(n)
    out = []
    for row, item in candidates(bounds, grams, items).tolist():
        wanted = items.grams[item]
        mine = grams[bounds[row] : bounds[row + 1]]
        place = np.searchsorted(wanted, mine)
        hits = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == mine)
        if 100 * len(np.unique(place[hits])) < percent * len(wanted):
            continue
        runs = {own.run(at, n) for at in first[bounds[row] : bounds[row + 1]][hits].tolist()}
        shared = len(items.shingles[item] & runs)  # the words themselves, not their hashes
        if 100 * shared >= percent * len(items.shingles[item]):
            out.append((row, item, shared))
    for k, lookup in items.short.items():
        bounds, grams, first = own.grams(k)
        at, item = lookup(grams)
        row = np.searchsorted(bounds, at, side="right") - 1
        pairs = np.stack([row, item], axis=1)
        _, one = np.unique(pairs, axis=0, return_index=True)
        out += [(int(row[i]), int(item[i]), 1) for i in one.tolist() if own.run(int(first[at[i]]), k) in items.shingles[int(item[i])]]
    return out


def item_blocks(items: DataFrame, item_id: str, text: str):
    """The items in blocks of bounded text: each is fetched, indexed and broadcast by itself."""
    blocks = pieces(text_bytes(items, text), ITEM_BYTES)
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    for b in range(blocks):
        yield rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)


def contaminated(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 n: int = N, percent: int = PERCENT) -> DataFrame:
    """A row for each document and item of which the document holds ``percent`` of the distinct ``n``-word shingles.

    The columns ``keep``, then item_id, n_shared, n_item and containment. Words are compared with A-Z lower-cased.
    An item of fewer than ``n`` words is one shingle, its whole sequence, and is looked for as a run of words in every
    text, short ones too; items without words match nothing, null texts hold nothing. Repeated rows and items give
    repeated pairs. The items are the stated query set: all documents are searched for one block of
    them after the other, and no pair travels before it is verified. Clashing names in ``keep`` are replaced.
    """
    spark = docs.sparkSession
    keep = free_of(keep, ("item_id", "n_shared", "n_item", "containment"))
    rows = docs.select(*keep, F.col(text).alias("_d_text"))
    schema = to_arrow_schema(docs.select(*keep).schema)
    id_type = items.schema[item_id].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema = schema.append(pa.field("item_id", to_arrow_schema(items.select(item_id).schema).field(0).type))
    for name, kind in (("n_shared", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64())):
        schema = schema.append(pa.field(name, kind))
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index_items([tuple(r) for r in block.collect()], n))

        def search(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for chunk in chunks(batch, "_d_text"):
                    found = matches(chunk["_d_text"], items, n, percent)
                    at = pa.array([r for r, _, _ in found], pa.int64())
                    sizes = [len(items.shingles[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [*(chunk[c].take(at) for c in keep), pa.array([items.ids[i] for _, i, _ in found], schema.field("item_id").type),
                         pa.array([s for _, _, s in found], pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array([s / z for (_, _, s), z in zip(found, sizes)], pa.float64())], schema=schema)

        part = rows.mapInArrow(search, f"{fields}, item_id {id_type}, n_shared long, n_item long, containment double")
        out = part if out is None else out.union(part)
    return out


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, that hold less than ``percent`` of the shingles of every item."""
    spark = docs.sparkSession
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index_items([tuple(r) for r in block.collect()], n))

        def keep(batches, shared=shared):
            for batch in batches:
                for chunk in chunks(batch, text):
                    clean = np.ones(chunk.num_rows, dtype=bool)
                    clean[[r for r, _, _ in matches(chunk[text], shared.value, n, percent)]] = False
                    yield chunk.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
