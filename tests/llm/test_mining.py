"""Collocations, licence scan and hard negatives against plain versions in Python."""

import math
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from documents import nasty, nothing  # noqa: F401
from tellerlake.llm import collocations, hard_negatives, licences, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        often = {g: v for g, v in f.items() if len(g) > 1 and v >= least}
        inside = Counter()
        for g, v in often.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], v)
        scored = []
        for g, a in often.items():
            if 100 * inside[g] < 50 * a or len(g) == 3:
                score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, hot", [(2, 2000, None), (2, 7, 1), (1, 500, 3)])
def test_collocations(nasty, least, top, hot):
    got = collocations.collocations(nasty, least=least, top=top, hot=hot)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r.lang, r.text) for r in nasty.collect()], least, top)


def test_one_pair_of_words_in_most_pieces(spark):
    rows = [("en", "of the " + " ".join(f"w{(i * j) % 41}" for j in range(i % 5)) + ". of the, the of of the") for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = plain_collocations(rows, 10, 2000)
    for hot in (None, 1):
        assert sorted(map(tuple, collocations.collocations(docs, hot=hot).collect())) == expected


def test_a_partition_is_a_chunk(spark):
    """What one node may bring to its bucket stays bounded however many small partitions there are; results do not change."""
    rows = [("en", f"the common pair w{i % 40} x, the common pair y{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(64)
    assert collocations.Graph(docs, "text", "lang", 10).hot * 64 <= collocations.NODE_EDGES
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_collocations(rows, 10, 2000)


def test_paths_are_unary(spark):
    """A sentence that only stands whole is one path, whatever stands around it."""
    line = "one two three four five six seven"
    rows = [("en", f"x{i} y{i}. {line}! z{i}") for i in range(12)] + [("en", "one two zero")]
    graph = collocations.Graph(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang", 10)
    assert [tuple(r) for r in graph.paths().collect()] == [("en", line, 7, 12)]


def test_the_graph_of_a_chunk_is_small_beside_an_executor(monkeypatch):
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(w) for w in words[np.random.default_rng(1).integers(0, 5000, (80, 20_000))]]
    batch = pa.RecordBatch.from_pydict({"_c_text": texts, "_c_lang": ["en"] * len(texts)})
    tracemalloc.start()
    sent = sum(m.num_rows for m in collocations.sender(8, 10)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent >= 8 and peak < 100e6, peak


def test_no_collocations_without_rows(nothing):
    out = collocations.collocations(nothing)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def plain_scan(texts, notices):
    words = [re.findall(licences.WORD, (t or "").translate(LOWER)) for t in texts]
    seen = Counter(w for ws in words for w in set(ws))
    idf = {w: (len(texts) + 1) // (seen[w] + 1) for n in notices for w in n.words}
    out = []
    for ws in words:
        fits = []
        for n in notices:
            keys = [n.places(k) for k in n.keys]
            word, place = min((-idf[w], w, q + i) for q, k in keys for i, w in enumerate(k))[1:]
            rare = sorted((-idf[w], w, q) for q, w in enumerate(n.words))[: licences.INDEX_WORDS]
            shifts = range(-n.slack, n.slack + 1)
            for start in (p - place for p, w in enumerate(ws) if w == word):
                if all(any(start + q + s >= 0 and ws[start + q + s :][: len(k)] == k for s in shifts) for q, k in keys):
                    share = sum(-r[0] for r in rare if any(0 <= start + r[2] + s < len(ws) and ws[start + r[2] + s] == r[1] for s in shifts)) / sum(-r[0] for r in rare)
                    if share >= licences.LEAST_SHARE:
                        fits.append((start, n.label, n.base, share))
        base = [f for f in fits if f[2]]
        out.append((len(ws), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None),
                    ",".join(sorted({f[1] for f in base})), ",".join(sorted({f[1] for f in fits})), max((f[3] for f in fits), default=0.0)))
    return out


def licence_texts():
    texts = [n.text for n in licences.NOTICES] + [n.text.upper() + "." for n in licences.NOTICES]
    texts += ["Licensed under CC BY-NC 4.0.", "cc by cc by cc", "cc_by", "CC BY", "gnu general public", "GNU  General\nPublic-License, version 3", "mit license",
              "the MIT License (mit license) MIT", "Kapache license", "apache licenses", "license apache", "", None, " \t", "all rights, reserved"]
    mpl = "This Source Code Form (file) is subject to the terms of the Mozilla Public License, v. 2.0."
    texts += [mpl, mpl.replace("Form", "Shape"), mpl.replace("terms", "the words the words the"), mpl.replace("This ", "").replace("Mozilla", "Other"), "public domain " * 300,
              "x " * 5000 + "apache license " * 700 + "gnu general public license version 2"]
    return texts


def test_licences(spark):
    texts = licence_texts()
    docs = spark.createDataFrame([(i, t, "old", 5) for i, t in enumerate([*texts, *texts[:3]])], "doc_id int, text string, labels string, n_words int").repartition(3)
    out = licences.scan(docs, ["doc_id", "labels", "n_words"])
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    expected = plain_scan([*texts, *texts[:3]], [*licences.BASE, *licences.NOTICES])
    for r in out.collect():
        assert tuple(r)[1:8] == expected[r.doc_id], r
    for n, r in zip(licences.NOTICES, sorted(out.collect())):
        assert n.label in r.labels.split(","), n


def test_licences_of_odd_rows(nasty, nothing):
    out = licences.scan(nasty, ["doc_id", "n_chars"]).collect()
    assert len(out) == nasty.count() and all(r.score == 0 and r.labels == "" and r.first_word is None for r in out)
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((r.doc_id, len(re.findall(licences.WORD, (r.text or "").translate(LOWER)))) for r in nasty.collect())
    assert licences.scan(nothing, ["doc_id"]).count() == 0


def plain_negatives(rows, every, positives, negatives, band):
    fine = [(i, v, x, [math.floor(256 * y) for y in e]) for i, (v, x, e) in enumerate(rows)
            if x is not None and e is not None and all(y is not None and math.isfinite(y) for y in e)]
    out = []
    for i, v, x, q in fine:
        if v is None or v % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, r)), w is None, w or 0, y) for j, w, y, r in fine if j != i)
        for s, none, p, _ in [n for n in near if n[3] == x][:positives]:
            fit = [n for n in near if n[3] != x and band[0] * -s <= 100 * -n[0] <= band[1] * -s][:negatives]
            out += [(v, None if none else p, k, None if m[1] else m[2], -s, -m[0]) for k, m in enumerate(fit, 1)]
    return sorted(out, key=repr)


def vectors():
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 3), [rnd.choice([-1.0, 1.0]) * rnd.random() ** 3 for _ in range(19)]) for i in range(700)]
    rows += [(i + 1000, 7, [0.5] * 19) for i in range(4)]  # ties, alone with their label
    rows += [rows[50], rows[50], rows[100], (None, 1, rows[7][2]), (200, None, rows[7][2]), (300, 2, None), (400, 2, [math.nan] * 19), (450, 2, [None, 1.0]),
             (500, 1, [math.inf]), (550, 1, [0.25, 0.5]), (600, 3, []), (650, 2, [0.0] * 19), (-50, 1, rows[3][2]), (2000, 9, [1.0] * 19)]
    return rows


@pytest.mark.parametrize("band, block", [((30, 90), 4096), ((30, 90), 32), ((95, 100), 64)])
def test_hard_negatives(spark, monkeypatch, band, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 6)
    rows = vectors()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, block int").repartition(3)
    packer = hard_negatives.packer

    def small(*args):
        pack = packer(*args)

        def run(batches):
            hard_negatives.BLOCK_ROWS = block  # in the worker
            yield from pack(batches)

        return run

    monkeypatch.setattr(hard_negatives, "packer", small)
    got = hard_negatives.hard_negatives(table, every=50, positives=3, negatives=4, band=band)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_negatives(rows, 50, 3, 4, band)


def test_large_components_are_exact(spark):
    rows = [(0, 1, [1e9, 1.0, 0.5]), (1, 1, [1e5, 3.0, -2.0]), (2, 2, [5e4, -1.0, 1.0]), (3, 2, [5e4 + 1 / 256, 1.0, 1.0]), (4, 2, [5e4 + 1 / 128, 0.0, 0.0])]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_negatives(rows, 100, 5, 10, (30, 90))


def test_no_negatives_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(alone).count() == 0


@pytest.mark.parametrize("key", ["op11_collocations", "op12_licences", "op13_hard_negatives"])
def test_sql(spark, key):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    import check

    folder = "/root/testdata/sf0.001"
    out = queries.QUERIES[key](spark, folder)
    cursor = check.connect(folder).execute(queries.ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(out.columns)
    assert check.canonical(cursor.fetchall(), names) == check.canonical([tuple(r) for r in out.collect()], out.columns)
