"""URL rules by a cascade of Bloom filters that is exact on every key the corpus can ask for."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_of, hash_strings, stored

#: Largest filter that is collected and broadcast: 2^30 bits, 128 MB.
MAX_FILTER_BITS = 1 << 30
#: Words of 64 bits that travel to the driver as one string.
WORDS = 1 << 15
MAX_LEVELS = 64
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 2)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``hashes`` probes, hash seed ``seed``."""

    words: np.ndarray
    bits: int
    hashes: int
    seed: int

    def __contains__(self, key: str) -> bool:
        return bool(self.test([key])[0])

    def test(self, keys: list[str]) -> np.ndarray:
        hit = np.ones(len(keys), dtype=bool)
        for at in probes(keys, self.bits, self.hashes, self.seed):
            hit &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit


def probes(keys: list[str], bits: int, hashes: int, seed: int):
    """Bit numbers of each key, one array for each probe."""
    first, second = hash_strings(keys, 2 * seed), hash_strings(keys, 2 * seed + 1) | np.uint64(1)
    for i in range(hashes):
        yield ((first + np.uint64(i) * second) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    """Filters of listed keys (even places) and of keys falsely found in the filter before (odd places).

    A key of the universe is listed when the first filter that lacks it stands at an odd place, or when none lacks
    it and the number of filters is odd.
    """

    levels: list[Level] = field(default_factory=list)

    def test(self, keys: list[str]) -> np.ndarray:
        listed = np.zeros(len(keys), dtype=bool)
        open_ = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            found = level.test([keys[i] for i in open_])
            listed[open_[~found]] = depth % 2 == 1
            open_ = open_[found]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Filter of the ``n`` keys with about ``rate`` false positives; tasks set bits, an aggregate joins them."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"a filter of {n} keys needs {bits} bits; split the list, {MAX_FILTER_BITS} are broadcast at most")

    def set_bits(batches):
        for batch in batches:
            own = batch["key"].tolist()
            at = np.concatenate([np.empty(0, np.int64), *probes(own, bits, hashes, seed)])
            yield pd.DataFrame({"word": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    def pack(rows: pa.Table) -> pa.Table:
        """A range of words as bytes."""
        first = rows["word"][0].as_py() // WORDS * WORDS
        own = np.zeros(min(WORDS, bits // 64 - first), dtype=np.int64)
        own[rows["word"].to_numpy() - first] = rows["mask"].to_numpy()
        return pa.table({"first": [first], "words": [own.tobytes()]}, schema=pa.schema([("first", pa.int64()), ("words", pa.binary())]))

    masks = keys.mapInPandas(set_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ranges = masks.groupBy((F.col("word") / WORDS).cast("long")).applyInArrow(pack, "first long, words binary")
    filled = np.zeros(bits // 64, dtype=np.uint64)
    for row in ranges.toLocalIterator():  # one range of words after the other
        own = np.frombuffer(row["words"], dtype=np.uint64)
        filled[row["first"] : row["first"] + len(own)] = own
    return Level(filled, bits, hashes, seed)


def passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that the filter seems to hold."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for batch in batches:
            yield batch[shared.value.test(batch["key"].tolist())]

    return keys.mapInPandas(test, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: key string, not null).

    The first filter's rate is sqrt(1/2) listed / unlisted, so its false positives, and with them all later levels,
    stay below the length of the list whatever the corpus holds. Later filters have the rate 1/2. The keys of a
    level stay in tables; only filters reach the driver, each bounded by MAX_FILTER_BITS. An empty list has no levels.
    """
    listed = stored(listed.distinct(), "cascade-listed")
    n = listed.count()
    if n == 0:
        return Cascade()
    others = max(1, universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"])
    levels = [build_level(listed, n, min(0.5, math.sqrt(0.5) * n / others), 0)]
    inside, outside = listed, stored(passing(universe, levels[0]).distinct().join(listed, "key", "left_anti"), "cascade-false")
    while (n := outside.count()) > 0:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: two keys share all their hashes")
        levels.append(build_level(outside, n, 0.5, len(levels)))
        inside, outside = outside, stored(passing(inside, levels[-1]), "cascade-level")
    return Cascade(levels)


def suffix(host: str, labels: int) -> str | None:
    """The last ``labels`` labels of a host, None if it has fewer."""
    at = len(host)
    for _ in range(labels):
        if at < 0:
            return None
        at = host.rfind(".", 0, at) if at else -1
    return host[at + 1 :]


def candidates(hosts: list[str], paths: list[str], shapes: list[tuple[int, int]]) -> list[list[str | None]]:
    """For each shape (labels of the host, characters of the path): the key that a rule of this shape would have."""
    tails = {labels: [suffix(h, labels) for h in hosts] for labels in {labels for labels, _ in shapes}}
    return [[None if t is None or len(p) < chars else t + p[:chars] for t, p in zip(tails[labels], paths)] for labels, chars in shapes]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The columns ``keep`` plus host, path, rule and verdict for each page.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains when the path starts with the
    rule's. The longest fitting rule (host and path together, then the host) gives the verdict; a url that no list
    holds gets ``default``. For each verdict one cascade encodes its rules over every key that the pages can ask
    for, a key being the tail of a host with as many labels, and the start of a path with as many characters, as
    some rule has. A page asks the cascades once for each such shape, without a join.

    A null url, or one without ://, has an empty host and path, which a rule can only fit with an empty host.
    ``host``, ``path``, ``rule`` and ``verdict`` replace columns of these names.
    """
    spark = pages.sparkSession
    keep = free_of(keep, ("host", "path", "rule", "verdict"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    split = pages.select(*keep, host_of(url).alias("_u_host"), path_of(url).alias("_u_path"))

    def keys(batches):
        for batch in batches:
            found = {k for one in candidates(batch["_u_host"].tolist(), batch["_u_path"].tolist(), shapes) for k in one if k is not None}
            yield pd.DataFrame({"key": sorted(found)}, dtype=object)

    universe = stored(split.select("_u_host", "_u_path").mapInPandas(keys, "key string").distinct(), "url-keys") if rules else None
    cascades = {}
    for verdict in sorted({v for v, _, _ in rules}):
        listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
        cascades[verdict] = build_cascade(listed, universe)
    shared = spark.sparkContext.broadcast(cascades)
    longest_first = sorted(shapes, key=lambda s: -s[0])

    def judge(batches):
        for batch in batches:
            n = len(batch)
            rule, verdict, length = np.full(n, None, dtype=object), np.full(n, default, dtype=object), np.full(n, -1)
            for keys_of in candidates(batch["_u_host"].tolist(), batch["_u_path"].tolist(), longest_first):
                asked = np.array([i for i, k in enumerate(keys_of) if k is not None and len(k) > length[i]], dtype=np.int64)
                distinct = sorted({keys_of[i] for i in asked})
                for name, cascade in shared.value.items():
                    member = dict(zip(distinct, cascade.test(distinct)))
                    for i in asked:
                        if member[keys_of[i]]:
                            rule[i], verdict[i], length[i] = keys_of[i], name, len(keys_of[i])
            yield batch.assign(_u_rule=rule, _u_verdict=verdict)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema.fields)
    judged = split.mapInPandas(judge, f"{fields}, _u_rule string, _u_verdict string")
    return judged.select(*keep, F.col("_u_host").alias("host"),
                         F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"), F.col("_u_verdict").alias("verdict"))
