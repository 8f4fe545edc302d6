"""Exact token counts of every prefix of a text, by dynamic programming over a byte-fallback BPE vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, free_of, mix

SPACE = "▁"  # the vocabulary's mark for a space
#: Units whose tables a worker keeps; beyond that it starts afresh.
CACHE = 400_000
#: Places for the verdicts on pairs of pieces that a worker keeps, as a power of 2.
PAIR_BITS = 21
#: Longer units are counted one by one, shorter ones side by side.
WIDE = 48
BASE = np.uint64(0x9E3779B97F4A7C15)


class PrefixCounter:
    """Token counts of prefixes under a sentencepiece BPE model without character normalisation.

    The encoding of a prefix is found from those of shorter ones: it ends in the one piece that may follow the last
    piece of the encoding before it. A piece may follow another if encoding both together gives just the two.
    Pieces hold the space mark only in front, so a text falls into units (spaces and the characters up to the next
    space) that are encoded on their own; characters outside all longer pieces are units, too. For each character of
    a unit the table holds by how much the count changes there, as one signed byte; a text's table is its units'
    tables put together, and a sum over its first bytes is the exact count of any prefix.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, a leading space and no normalisation is needed")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) or len(piece.strip(SPACE)) and piece.startswith(2 * SPACE) for piece in self.rank):
            raise ValueError("a piece holds a space behind another character")
        self.longest = max(map(len, self.rank))
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece}
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)
        edge = re.escape(self.alone)
        self.units = re.compile(f"{SPACE}+[^{SPACE}{edge}]*|[^{SPACE}{edge}]+|[{edge}]" if edge else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        ends: dict[str, set[int]] = {}
        for piece in self.rank:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of the pieces that end in two given characters, longest first.
        self.lengths = {two: sorted(found, reverse=True) for two, found in ends.items()}
        self.deltas: dict[str, bytes] = {}
        self.pieces = list(self.rank)
        self.number = {piece: i for i, piece in enumerate(self.pieces)}
        self.sizes = sorted({len(piece) for piece in self.pieces})
        self._index_pieces()
        self.pairs, self.verdicts = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.halves = lru_cache(None)(self._halves)
        self.spaces = lru_cache(None)(self._spaces)

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge made ``piece``: best-ranked neighbours merge first, the leftmost of equals."""
        parts = list(piece)
        while len(parts) > 2:
            _, i = min((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay apart when they are encoded together.

        Their merges are undone, the latest first. At each time the two parts that touch at the border must not have
        merged before the merge that was undone last took one of them away.
        """
        rank = self.rank
        taken, taken_right = float("inf"), False
        while True:
            t = rank.get(left + right)
            if t is not None and (t < taken or t == taken and taken_right):
                return False
            of_left = rank[left] if len(left) > 1 else -1
            of_right = rank[right] if len(right) > 1 else -1
            if of_left > of_right:
                taken, taken_right, left = of_left, False, self.halves(left)[1]
            elif of_right >= 0:
                taken, taken_right, right = of_right, True, self.halves(right)[0]
            else:
                return True

    def _spaces(self, n: int) -> int:
        """Tokens of ``n`` space marks; their pieces share a rank, so the library is asked."""
        return len(self.library.encode(" " * (n - 1))) if n > 1 else 1

    def unit_counts(self, unit: str) -> list[int]:
        """Token counts of the prefixes of one unit, of 1, 2, ... characters."""
        run = len(unit) - len(unit.lstrip(SPACE))
        if run > 1:
            return [self.spaces(i) for i in range(1, run + 1)] + self.behind_spaces(run, unit[run:])
        rank, lengths, follow = self.rank, self.lengths, self.may_follow
        counts, last = [0], [""]
        for end in range(1, len(unit) + 1):
            for length in lengths.get(unit[end - 2 : end], ()) if end > 1 else ():
                start = end - length
                if start >= 0 and (piece := unit[start:end]) in rank and (not last[start] or follow(last[start], piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:  # a single character, or its bytes if the vocabulary lacks it
                char = unit[end - 1]
                counts.append(counts[-1] + (1 if char in rank else len(char.encode("utf-8"))))
                last.append(char if char in rank else "")
        return counts[1:]

    def behind_spaces(self, run: int, tail: str) -> list[int]:
        """Counts behind several spaces: the last mark belongs to the tail, if the library says so for the whole and for
        every prefix that a piece could span; otherwise it is asked for each prefix."""
        asked = lambda n: len(self.library.encode(" " * (run - 1) + tail[:n]))
        counts = [self.spaces(run - 1) + c for c in self.unit_counts(SPACE + tail)[1:]]
        if all(asked(n) == counts[n - 1] for n in {*range(1, min(len(tail), self.longest) + 1), len(tail)} - {0}):
            return counts
        return [asked(n) for n in range(1, len(tail) + 1)]

    def _index_pieces(self) -> None:
        """Open-addressed table of the pieces' hashes: place -> number of the piece, -1 where empty."""
        self.power = np.ones(self.longest + 1, dtype=np.uint64)
        for i in range(1, len(self.power)):
            self.power[i : i + 1] = self.power[i - 1 : i] * BASE
        self.hashes = np.zeros(len(self.pieces), dtype=np.uint64)
        for size in self.sizes:
            own = [i for i, piece in enumerate(self.pieces) if len(piece) == size]
            points = np.array([[ord(c) for c in self.pieces[i]] for i in own], dtype=np.uint64) + np.uint64(1)
            total = np.zeros(len(own), dtype=np.uint64)
            for k in range(size):
                total = total * BASE + points[:, k]
            self.hashes[own] = total
        self.shift = np.uint64(64 - max(10, (4 * len(self.pieces)).bit_length()))
        self.places = np.full(1 << int(64 - self.shift), -1, dtype=np.int32)
        for i, at in enumerate((mix(self.hashes) >> self.shift).tolist()):
            while self.places[at] >= 0:
                at = (at + 1) % len(self.places)
            self.places[at] = i

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 for none."""
        at = (mix(hashes) >> self.shift).astype(np.int64)
        found = self.places[at]
        open_ = np.flatnonzero((found >= 0) & (self.hashes[found] != hashes))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.places)
            found[open_] = self.places[at[open_]]
            own = found[open_]
            open_ = open_[(own >= 0) & (self.hashes[own] != hashes[open_])]
        return found

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of numbered pieces; a left piece of -1 takes any."""
        out = np.ones(len(left), dtype=bool)
        asked = np.flatnonzero(left >= 0)
        keys = left[asked] * len(self.pieces) + right[asked]
        place = (mix(keys.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out[asked] = self.verdicts[place]
        new = np.flatnonzero(self.pairs[place] != keys)
        if len(new):
            found, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            n, pieces = len(self.pieces), self.pieces
            verdict = np.array([self.may_follow(pieces[key // n], pieces[key % n]) for key in found.tolist()])
            out[asked[new]] = verdict[back]
            # of pairs that share a place the last one stays
            self.pairs[place[new][where]] = found
            self.verdicts[place[new][where]] = verdict
        return out

    def side_by_side(self, units: list[str]) -> np.ndarray:
        """``unit_counts`` of many units of at most one leading mark: a row each, filled up with its last count."""
        rows, size = len(units), np.array([len(u) for u in units])
        width = int(size.max())
        points = np.zeros((rows, width), dtype=np.uint64)
        inside = np.arange(width)[None, :] < size[:, None]
        points[inside] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((width + 1, rows), dtype=np.uint64)
        counts, last = np.zeros((width + 1, rows), dtype=np.int64), np.full((width + 1, rows), -1, dtype=np.int64)
        for end in range(1, width + 1):
            prefix[end] = prefix[end - 1] * BASE + points[:, end - 1]
            live = np.flatnonzero(size >= end)
            counts[end] = counts[end - 1]
            unit, start, piece = [], [], []
            for length in self.sizes:
                if length > end:
                    break
                found = self._find(prefix[end][live] - prefix[end - length][live] * self.power[length])
                hit = np.flatnonzero(found >= 0)
                unit.append(live[hit])
                start.append(np.full(len(hit), end - length))
                piece.append(found[hit])
            unit, start, piece = np.concatenate(unit), np.concatenate(start), np.concatenate(piece)
            fits = self._follow(last[start, unit], piece)
            unit, start, piece = unit[fits], start[fits], piece[fits]
            counts[end, unit] = counts[start, unit] + 1
            last[end, unit] = piece
            bare = live[last[end][live] < 0]  # no piece: the character's bytes
            point = points[bare, end - 1].astype(np.int64) - 1
            counts[end, bare] = counts[end - 1, bare] + 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        return counts[1:].T

    def learn(self, units: set[str]) -> None:
        """Put the tables of units into the cache."""
        deltas = self.deltas
        narrow = sorted((u for u in units if len(u) <= WIDE and not u.startswith(2 * SPACE)), key=len)
        for first in range(0, len(narrow), 8192):
            own = narrow[first : first + 8192]
            change = np.diff(self.side_by_side(own), axis=1, prepend=0).astype(np.int8)
            for unit, row in zip(own, change):
                deltas[unit] = row[: len(unit)].tobytes()
        for unit in units:
            if unit not in deltas:
                counts = self.unit_counts(unit)
                deltas[unit] = bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def tables(self, texts: list[str]) -> list[bytes]:
        """For each text the change of the count at each of its characters, as signed bytes."""
        split = [self.units.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.deltas)
        if len(self.deltas) + len(new) > CACHE:
            self.deltas, new = {}, wanted
        self.learn(new)
        # the leading mark is not a character of the text: its token counts with the first one
        joined = (b"".join(map(self.deltas.__getitem__, units)) for units in split)
        return [bytes([(j[0] + j[1]) % 256]) + j[2:] if j else j for j in joined]

    def table(self, text: str) -> bytes:
        return self.tables([text])[0]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file; built once in each worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def count_tokens(docs: DataFrame, keep: list[str], path: str, budget: int, text: str = "text", tables: bool = False) -> DataFrame:
    """The columns ``keep`` plus n_bytes, n_tokens, over_limit, fit_chars and, with ``tables``, prefix_table.

    ``path`` names a sentencepiece model that every executor can read. n_tokens counts the whole text without begin,
    end or other added tokens; over_limit says that it is more than ``budget``; fit_chars is the length of the longest
    prefix within the budget. prefix_table (zstandard) answers both for any prefix: ``prefix_counts``. A null or empty
    text has no bytes and no tokens.
    """
    keep = free_of(keep, ("n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_table"))
    kept = docs.select(*keep).schema
    given = docs.select(*keep, F.col(text).alias("_t_text"))
    schema = to_arrow_schema(kept)
    for name in ("n_bytes", "n_tokens", "fit_chars"):
        schema = schema.append(pa.field(name, pa.int64()))
    if tables:
        schema = schema.append(pa.field("prefix_table", pa.binary()))

    def count(batches):
        counter, pack = counter_of(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk in chunks(batch, "_t_text"):
                texts = chunk["_t_text"]
                made = counter.tables([t or "" for t in texts.to_pylist()])
                total = [int(np.frombuffer(m, np.int8).sum(dtype=np.int64)) for m in made]
                fit = [len(m) if n <= budget else longest_prefix(m, budget) for m, n in zip(made, total)]
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                packed = [pa.array([pack.compress(m) for m in made], pa.binary())] if tables else []
                yield pa.RecordBatch.from_arrays([*(chunk[c] for c in keep), size, pa.array(total, pa.int64()), pa.array(fit, pa.int64()), *packed], schema=schema)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.fields)
    counted = given.mapInArrow(count, f"{fields}n_bytes long, n_tokens long, fit_chars long" + (", prefix_table binary" if tables else ""))
    return counted.withColumn("over_limit", F.col("n_tokens") > budget)
