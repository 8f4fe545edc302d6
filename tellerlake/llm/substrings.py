"""Removal of word sequences that occur more than once in the corpus, by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, free_of, hash_strings, pieces, split_words, text_bytes, window_hashes

WINDOW = 35
#: Words of a minimiser: long enough that unrelated passages seldom share one.
MINIMISER = 8
#: Text that one task holds at a time.
GROUP_BYTES = 8 << 20
#: Text in which common minimisers are looked for, and words of strings from which on a minimiser is common.
LOOK_BYTES = 64 << 20
COMMON_WORDS = 2 << 20
BLOB = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("minimisers", pa.binary()), ("times", pa.binary()), ("packed", pa.binary())])
HITS = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("hits", pa.binary())])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[: len(out) - have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class Texts:
    """The distinct texts of a group, in sorted order, as one array of words."""

    def __init__(self, texts: pa.ChunkedArray):
        given = [t or "" for t in texts.to_pylist()]
        distinct = sorted(set(given))
        place = {t: i for i, t in enumerate(distinct)}
        self.of_row = np.array([place[t] for t in given], dtype=np.int64)
        self.copies = np.bincount(self.of_row, minlength=len(distinct))
        self.bounds, self.codes, self.words = split_words(distinct)
        encoded = [w.encode("utf-8") for w in self.words]
        lengths = np.array([len(w) for w in encoded], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths[self.codes] + 1))) if len(self.codes) else np.zeros(1, np.int64)
        self.joined = b" ".join([encoded[c] for c in self.codes.tolist()])

    def slice(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (excluded), joined by spaces."""
        return self.joined[self.starts[first] : self.starts[last] - 1] if last > first else b""


def super_kmers(texts: Texts, k: int, m: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, windows, text, key, key occurs again) of each run of windows with one key.

    The key is the window's minimiser among the runs of ``m`` words that are not ``common``; a window without such
    a run is one by itself, keyed by the hash of all its words. Equal windows have equal keys, whatever is common.
    A run stays inside its text. Only a run in which the minimiser occurs twice can hold two equal windows.
    """
    none = np.zeros(0, np.int64)
    n = len(texts.codes) - k + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    word_hash = hash_strings(texts.words)[texts.codes]
    short = window_hashes(word_hash, m)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(common):
        short[common[np.minimum(np.searchsorted(common, short), len(common) - 1)] == short] = last
    least = sliding_min(short, k - m + 1)
    owner = np.repeat(np.arange(len(texts.bounds) - 1), np.diff(texts.bounds))
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    alone = least == last
    if alone.any():
        least[alone] = window_hashes(word_hash, k)[alone]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]) | alone[at[1:]] | alone[at[:-1]]
    run = np.flatnonzero(new)
    first, windows = at[run], np.diff(np.append(run, len(at)))
    span = windows + k - m
    begin = np.concatenate(([0], np.cumsum(span)))[:-1]
    places = np.arange(int(span.sum())) + np.repeat(first - begin, span)
    again = np.add.reduceat((short[places] == np.repeat(least[first], span)).astype(np.int64), begin) > 1
    return first, windows, owner[first], least[first], again & ~alone[first]


def by_bucket(key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, its runs) for each bucket that the keys fall into."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[own[0]]), own) for own in np.split(order, cuts)] if len(order) else []


def numbered(texts: Texts, first: np.ndarray, windows: np.ndarray, k: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of each run's string, and the distinct strings in the order of their numbers."""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(texts.slice(f, f + w + k - 1), len(number)) for f, w in zip(first.tolist(), windows.tolist())]
    return np.array(ids, dtype=np.int64), list(number)


def sender(buckets: int, k: int, m: int, shared):
    """Packs a group's super-k-mers, each distinct string once with its number of occurrences, into one blob for each bucket."""

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        texts = Texts(rows["_ss_text"])
        first, windows, owner, least, again = super_kmers(texts, k, m, shared.value)
        pack = zstandard.ZstdCompressor(level=3)
        out: dict[str, list] = {name: [] for name in BLOB.names}
        for bucket, own in by_bucket(least, buckets):
            ids, strings = numbered(texts, first[own], windows[own], k)
            sample = own[np.unique(ids, return_index=True)[1]]
            times = np.bincount(ids, weights=texts.copies[owner[own]]).astype(np.int64)
            for name, value in zip(BLOB.names, (key[0].as_py(), bucket, least[sample].tobytes() + again[sample].tobytes(), pack.compress(times.tobytes()), pack.compress(b"\n".join(strings)))):
                out[name].append(value)
        return pa.table(out, schema=BLOB)

    return send


def same_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Number of the word sequence of each window of ``k`` codes, equal exactly for equal sequences.

    Sequences of 1, 2, 4 ... codes are sorted and numbered; two overlapping ones give ``k``.
    """
    number, have = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while have < k:
        step = min(have, k - have)
        pair = number[: len(number) - step] * (int(number.max()) + 1) + number[step:]
        number, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
    return number


def counter(k: int):
    """Counts a bucket's windows and returns, for each group, the runs of windows of its strings that occur more than once."""

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        groups = rows["grp"].to_pylist()
        least, again = [], []
        for b in rows["minimisers"].to_pylist():
            n = len(b) // 9
            least.append(np.frombuffer(b, np.uint64, n))
            again.append(np.frombuffer(b, bool, n, 8 * n))
        times = [np.frombuffer(unpack.decompress(b), np.int64) for b in rows["times"].to_pylist()]
        # Windows whose key occurs once in the corpus occur once themselves: their strings are left packed.
        value, place = np.unique(np.concatenate(least), return_inverse=True)
        often = np.bincount(place, weights=np.concatenate(times), minlength=len(value)) > 1
        often = often[place] | np.concatenate(again)
        # equal strings of different groups are counted as one
        number: dict[bytes, int] = {}
        ids, from_blob, string_times = [], [], []
        offset = 0
        for i, blob in enumerate(rows["packed"]):
            own = often[offset : offset + len(least[i])]
            offset += len(own)
            if not own.any():
                continue
            packed = unpack.decompress(blob.as_py()).split(b"\n")
            for j in np.flatnonzero(own).tolist():
                ids.append(number.setdefault(packed[j], len(number)))
                from_blob.append((i, j))
                string_times.append(times[i][j])
        out: dict[str, list] = {name: [] for name in HITS.names}
        if ids:
            weight = np.bincount(ids, weights=string_times).astype(np.int64)
            bounds, codes, _ = split_words(pa.array([s.decode("utf-8") for s in number], type=pa.large_string()))
            windows = np.diff(bounds) - k + 1
            inside = np.concatenate([np.arange(b, b + w) for b, w in zip(bounds[:-1], windows)])
            sequence = same_windows(codes, k)[inside]
            repeated = np.bincount(sequence, weights=np.repeat(weight, windows))[sequence] > 1
            begin = np.concatenate(([0], np.cumsum(windows)))
            found: dict[int, list] = {}
            for (i, j), s in zip(from_blob, ids):
                hits = repeated[begin[s] : begin[s + 1]]
                if hits.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hits.view(np.int8), [0]))))
                    found.setdefault(i, []).append(np.stack([np.full(len(edge) // 2, j), edge[::2], edge[1::2] - 1]))
            for i, hits in found.items():
                out["grp"].append(groups[i])
                out["bucket"].append(key[0].as_py())
                out["hits"].append(zstandard.ZstdCompressor().compress(np.concatenate(hits, axis=1).astype(np.uint32).tobytes()))
        return pa.table(out, schema=HITS)

    return count


def remover(keep: list[str], schema: pa.Schema, buckets: int, k: int, m: int, shared):
    """Takes the words covered by repeated windows out of a group's texts."""

    def remove(rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        texts = Texts(rows["_ss_text"])
        unpack = zstandard.ZstdDecompressor()
        change = np.zeros(len(texts.codes) + 1, dtype=np.int64)
        answers = dict(zip(hits["bucket"].to_pylist(), hits["hits"].to_pylist()))
        if answers:  # strings are numbered again as they were sent
            first, windows, _, least, _ = super_kmers(texts, k, m, shared.value)
            for bucket, own in by_bucket(least, buckets):
                if bucket not in answers:
                    continue
                string, a, b = np.frombuffer(unpack.decompress(answers[bucket]), np.uint32).reshape(3, -1).astype(np.int64)
                ids, _ = numbered(texts, first[own], windows[own], k)
                low, high = np.searchsorted(string, ids, "left"), np.searchsorted(string, ids, "right")
                many = high - low
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                start = np.repeat(first[own], many)
                np.add.at(change, start + a[at], 1)
                np.add.at(change, start + b[at] + k, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = np.concatenate(([0], np.cumsum(gone)))
        kept = []
        for begin, end in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
            if removed[end] == removed[begin]:
                kept.append(texts.slice(begin, end).decode("utf-8"))
            else:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (~gone[begin:end]).view(np.int8), [0])))) + begin
                kept.append(b" ".join([texts.slice(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]).decode("utf-8"))
        own = texts.of_row
        counts, cut = np.diff(texts.bounds), removed[texts.bounds[1:]] - removed[texts.bounds[:-1]]
        return pa.table([*[rows[c] for c in keep], pa.array(counts[own], pa.int64()), pa.array(cut[own], pa.int64()),
                         pa.array(kept, pa.string()).take(pa.array(own))], schema=schema)

    return remove


def common_minimisers(docs: DataFrame, text: str, total: int, k: int, m: int) -> np.ndarray:
    """Sorted hashes of the runs of ``m`` words that would bring more than COMMON_WORDS words to one bucket.

    They are counted in a part of the texts chosen by hash, about LOOK_BYTES, and scaled. The choice decides only
    by which key a window travels; all windows of all texts are counted, with the same result for any choice. Each
    task drops what is rare in its own chunk; of the rest no more than all words / COMMON_WORDS can be common.
    """
    of = pieces(total, LOOK_BYTES)
    limit = max(2.0, COMMON_WORDS / (2 * k - m) / of)
    rare = limit / 4 / max(1, total // of)  # a quarter of the limit, for each byte looked at

    def look(batches):
        for batch in batches:
            for chunk in chunks(batch, "_ss_text"):
                bounds, codes, words = split_words(chunk["_ss_text"])
                grams, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(codes) >= k:
                    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    inside = owner[: len(codes) - m + 1] == owner[m - 1 :]
                    grams, times = np.unique(window_hashes(hash_strings(words)[codes], m)[inside], return_counts=True)
                often = times >= rare * chunk["_ss_text"].nbytes
                yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(times[often], pa.int64())], names=["gram", "times"])

    rows = docs.select(F.col(text).alias("_ss_text")).filter(F.pmod(F.xxhash64("_ss_text"), F.lit(of)) == 0).distinct()
    found = rows.mapInArrow(look, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).filter(F.col("times") > limit)
    return np.sort(np.array([r["gram"] for r in found.select("gram").collect()], dtype=np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """The columns ``keep`` plus n_words, n_removed and kept: the text without every word that a repeated window covers.

    A window is ``k`` consecutive words of one text; it is repeated if its word sequence starts anywhere else, in
    this or another row. Windows are judged on the input. Kept words are joined by one space. A null or empty text
    has no words, a text of fewer than ``k`` words no window; rows with equal texts repeat each other.

    The minimiser of a window is the smallest hash of ``m`` consecutive words in it. Neighbouring windows with the
    same minimiser are sent together, as one string, to the minimiser's bucket, where all equal windows meet. Runs of
    ``m`` words that stand in very many texts (``common_minimisers``) are no minimisers, as each text puts other
    words around them: such windows go by their rarest part, or, if all their parts are common, each by the hash of
    all its words. A group of texts sends each distinct string once with its count and keeps the places, so a passage
    that stands in every text arrives at its bucket once for each group. Buckets answer with the repeated windows of
    the strings. A single text is never split. Clashing names in ``keep`` are replaced.
    """
    keep = free_of(keep, ("n_words", "n_removed", "kept"))
    total = text_bytes(docs, text)
    groups = pieces(total, GROUP_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(common_minimisers(docs, text, total, k, m))
    dealt = docs.select(*keep, F.col(text).alias("_ss_text"))
    dealt = dealt.withColumn("_ss_group", F.pmod(F.xxhash64(*dealt.columns), F.lit(groups)))
    schema = to_arrow_schema(docs.select(*keep).schema)
    for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())):
        schema = schema.append(pa.field(name, kind))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    blobs = dealt.groupBy("_ss_group").applyInArrow(sender(groups, k, m, shared), "grp long, bucket long, minimisers binary, times binary, packed binary")
    hits = blobs.groupBy("bucket").applyInArrow(counter(k), "grp long, bucket long, hits binary")
    return dealt.groupBy("_ss_group").cogroup(hits.groupBy("grp")).applyInArrow(
        remover(keep, schema, groups, k, m, shared), f"{fields}, n_words long, n_removed long, kept string")
