"""Hashed word and character n-grams of texts, and the bounded labelled sample that classifiers learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_strings, split_words, window_hashes

BITS = 16
WORD_SIZES = (1, 2)
CHAR_SIZES = (3, 4)
PATTERN = 4
FAMILIES = len(WORD_SIZES) + len(CHAR_SIZES)
SPREAD, FINISH = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
SAMPLE = pa.schema([("fold", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary())])


def families(texts: pa.Array, patterns: bool = False):
    """For each n-gram size: (bounds, ids); ids[bounds[i]:bounds[i+1]] are the buckets of text i's n-grams.

    Every family has buckets of its own. Words are runs of characters other than white space, unchanged; characters
    are code points. N-grams never cross texts; a null text has none. ``patterns`` adds a family of word n-grams in
    which every word stands for its first place in the n-gram, so that all n-grams that repeat a word alike are one.
    """
    bounds, codes, words = split_words(texts)
    hashed = hash_strings(words, 11)[codes] if len(codes) else np.zeros(0, np.uint64)
    given = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in given]))).astype(np.int64)
    number = 0
    for size in WORD_SIZES:
        grams = window_hashes(hashed, size)
        yield inner(bounds, size, (grams >> np.uint64(64 - BITS)).astype(np.int64), number)
        number += 1
    rolling, have = np.full(len(points), 0x811C9DC5, dtype=np.uint32), 0
    for size in CHAR_SIZES:
        while have < size:
            rolling = rolling[: max(0, len(points) - have)] * SPREAD + points[have:]
            have += 1
        mixed = (rolling ^ (rolling >> np.uint32(15))) * FINISH
        yield inner(ends, size, (mixed >> np.uint32(32 - BITS)).astype(np.int64), number)
        number += 1
    if patterns:
        yield inner(bounds, PATTERN, word_patterns(codes, PATTERN), number)


def word_patterns(codes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words the places at which each of them first stands in it, as one number."""
    count = max(0, len(codes) - size + 1)
    out = np.zeros(count, dtype=np.int64)
    for i in range(1, size):
        first = np.full(count, i)
        for j in range(i - 1, -1, -1):
            first[codes[i : i + count] == codes[j : j + count]] = j
        out = out * size + first
    return out


def inner(bounds: np.ndarray, size: int, ids: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Keeps the n-grams that lie inside one text."""
    length = np.diff(bounds)
    count = np.maximum(length - size + 1, 0)
    if size > 1 and len(ids):
        keep = np.ones(int(bounds[-1]), dtype=bool)
        for back in range(1, size):  # the last places of each text begin n-grams that leave it
            keep[bounds[1:][length >= back] - back] = False
        ids = ids[keep[: len(ids)]]
    return np.concatenate(([0], np.cumsum(count))), ids + (family << BITS)


def means(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mean of each text's values, 0 for none."""
    count = np.diff(bounds)
    out = np.zeros(len(count))
    full = np.flatnonzero(count)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=np.float64) / count[full]
    return out


def linear_scores(texts: pa.Array, table: np.ndarray, patterns: bool = False) -> np.ndarray:
    """Sum over the families of the mean of ``table`` at the text's n-grams."""
    total = np.zeros(len(texts))
    for bounds, ids in families(texts, patterns):
        total += means(bounds, table[ids])
    return total


def sparse_rows(texts: pa.Array, patterns: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, weights) of each text: a bucket's share of its family's n-grams."""
    rows: list[list] = [[] for _ in range(len(texts))]
    for bounds, ids in families(texts, patterns):
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                found, count = np.unique(ids[a:b], return_counts=True)
                rows[i].append((found, count / (b - a)))
    empty = np.zeros(0, np.int64), np.zeros(0)
    return [tuple(np.concatenate(x) for x in zip(*own)) if own else empty for own in rows]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: tuple[int, ...], text: str = "text", patterns: bool = False) -> DataFrame:
    """fold, label and sparse features of at most ``limit`` labelled documents, those of the smallest hashed ids.

    The fold of a document is crc32 of its id, as text, modulo 4; only those in ``folds`` are used. Null ids and null
    labels are left out; an id labelled more than once takes the rounded mean, an id that several documents have
    the smallest of their texts. The limit bounds what is broadcast here and what a model is fitted to.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).cast("long")
    chosen = (
        labels.select("doc_id", F.col(label).alias("_l")).filter("doc_id is not null and _l is not null")
        .groupBy("doc_id").agg(F.when(F.avg("_l") >= 0.5, 1).otherwise(0).cast("long").alias("label"))
        .withColumn("fold", fold).filter(F.col("fold").isin(*folds))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = (docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "fold", "label").agg(F.min("_t").alias("_t")))

    def featurise(batches):
        for batch in batches:
            for chunk in chunks(batch, "_t"):
                made = sparse_rows(chunk["_t"], patterns)
                yield pa.RecordBatch.from_arrays(
                    [chunk["fold"], chunk["label"], pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()),
                     pa.array([w.astype(np.float32).tobytes() for _, w in made], pa.binary())], schema=SAMPLE)

    return rows.mapInArrow(featurise, "fold long, label long, ids binary, weights binary")


def fitted(sample: DataFrame, fit) -> bytes | None:
    """Model of ``fit(fold, label, ids, weights)`` over the whole bounded sample, in one task; None without rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort([[hash_strings([b.hex()])[0] for b in rows["ids"].to_pylist()], rows["label"].to_numpy()])))  # same order in every run
        ids = [np.frombuffer(b, np.int32) for b in rows["ids"].to_pylist()]
        weights = [np.frombuffer(b, np.float32) for b in rows["weights"].to_pylist()]
        return pa.table({"model": pa.array([fit(rows["fold"].to_numpy(), rows["label"].to_numpy(), ids, weights)], pa.binary())})

    found = sample.groupBy().applyInArrow(run, "model binary").collect()
    return found[0]["model"] if found else None
