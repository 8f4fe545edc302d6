"""Helpers of the operators: tables of a folder, work tables, words and their ids."""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

#: Text that a task turns into n-grams at a time.
CHUNK_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_of(keep: list[str], names) -> list[str]:
    """The kept columns without those that the result's own ``names`` replace."""
    return [c for c in keep if c not in names]


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the groups that one task holds."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]


def pieces(total: float, each: float) -> int:
    return max(1, math.ceil(total / each))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64); wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def hash_strings(values: list[str], seed: int = 0) -> np.ndarray:
    """Stable 64-bit hash of each string."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(v, seed) for v in values), dtype=np.uint64, count=len(values))


def split_words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text as (offsets, codes, dictionary); a null text has none.

    Words are runs of characters other than space and U+0009 to U+000D; ``lower`` maps A-Z to a-z. Word ``i``
    of text ``t`` is ``dictionary[codes[offsets[t] + i]]``.
    """
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, type=pa.large_string(), from_pandas=True)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    if "" in words:  # edges of a text give an empty word
        keep = codes != words.index("")
        kept = np.concatenate(([0], np.cumsum(keep)))
        bounds, codes = kept[bounds], codes[keep]
    if lower:  # here and not on the texts: ascii_lower of a sliced array is wrong in some releases
        number: dict[str, int] = {}
        merged = np.array([number.setdefault(w.translate(TO_LOWER), len(number)) for w in words], dtype=np.int64)
        codes, words = merged[codes], list(number)
    return bounds, codes, words


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive strings of the given lengths."""
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; works on slices."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte of a text is: 0 in a word, 1 between words.
BLANKS = np.zeros(256, dtype=np.uint8)
BLANKS[[0x20, *range(0x09, 0x0E)]] = 1


def lower_words(column: pa.Array, kind: np.ndarray = BLANKS) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each byte, dictionary, code, text number and first byte of each word) of a column of texts.

    Words are runs of bytes of kind 0 and end with their text; A-Z are mapped to a-z on the bytes.
    """
    data, bounds = raw(column)
    kind = kind[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[:-1][np.diff(bounds) > 0]  # where a text begins, a word cannot go on
    begins[edges] = inside[1:-1][edges]
    edges = edges[edges > 0]
    ends[edges - 1] = inside[1:-1][edges - 1]
    at = np.flatnonzero(begins)
    coded = strings(_LOWER[data][kind == 0], np.flatnonzero(ends) + 1 - at).dictionary_encode()
    text = np.searchsorted(bounds, at, side="right") - 1
    return kind, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, at


def window_hashes(codes_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, from the words' hashes; runs may cross texts."""
    count = max(0, len(codes_hash) - n + 1)
    h = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes_hash[i : i + count])
    return h


def gram_sets(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct n-gram hashes of each text; A-Z lower-cased.

    A text with fewer than ``n`` words has its whole sequence as one n-gram, one without words has none.
    """
    bounds, codes, words = split_words(texts, lower=True)
    word_hash = hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    grams, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) >= n:
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        grams, own = window_hashes(word_hash, n)[inside], owner[: len(codes) - n + 1][inside]
    for short in range(1, n):
        rows = np.flatnonzero(count == short)
        if len(rows):
            h = np.full(len(rows), short, dtype=np.uint64)
            for i in range(short):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[bounds[rows] + i])
            grams, own = np.concatenate([grams, h]), np.concatenate([own, rows])
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[new], own[new]
    return np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(count))))).astype(np.int64), grams


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop
