"""Mixing, sharding, token counts and quality rules against plain versions in Python."""

import math
import re
import zlib
from collections import Counter

import pytest

from documents import nasty, nothing  # noqa: F401
from tellerlake.llm import mixing, quality_rules, sharding, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_shards_are_cut_at_equal_bytes(nasty):
    rows = sharding.shard_documents(nasty, 24, ["doc_id", "source"]).collect()
    assert len(rows) == nasty.count() and rows[0].__fields__[:2] == ["doc_id", "source"]
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in nasty.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    total, run = sum(r.size for r in rows), 0
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min(23, (2 * run + r.size) * 24 // (2 * total)) and r.law == "bytes" and r.grown_shard is None
        run += r.size
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_of_even_rows_differ_by_a_row(spark):
    rows = sharding.shard_by_bytes(spark.range(1000).selectExpr("id", "10 AS bytes"), 7, "bytes", ["id"]).collect()
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count.values()) <= 1


def water_level(sizes: dict, weights: dict) -> dict:
    """Targets by the stated repetition: share, stop the ones above, share the excess again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixture_takes_the_targets(nasty):
    rows = mixing.mixture(nasty).collect()
    assert len(rows) == nasty.count()
    sizes = Counter()
    for r in nasty.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = water_level(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size * sum(x.doc_id == r.doc_id for x in rows))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and len(r.positions) == r.copies
        assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)
    again = mixing.mixture(nasty).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_repeated_rows_are_cut_singly(spark, monkeypatch):
    """A source of one row that stands very often is read as long as its target, a whole row more or less."""
    monkeypatch.setattr(mixing, "ROWS_AT_ONCE", 64)
    rows = [(7, "w " * 50, "b")] * 1000 + [(None, f"x{i} y z", "a") for i in range(500)] + [(i, "one two", "c") for i in range(300)] + [(1, "", "b"), (2, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mixture(docs).collect()
    assert len(out) == len(rows)
    for source, size in (("a", 3), ("b", 50), ("c", 2)):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= size
        assert len({r.copies for r in own if r.size}) <= 2
    copies = Counter()
    for r in out:
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.training_documents(docs).collect()) == +copies


def test_another_schedule_gives_other_rows(spark, nasty, tmp_path, monkeypatch):
    """Schedules of the same areas move the times, which the query returns."""
    from tellerlake.llm import queries

    nasty.write.parquet(str(tmp_path / "documents.parquet"))
    first = sorted(map(str, queries.op1_mixture(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(mixing, "mixture", lambda docs, run=mixing.mixture: run(docs, [[(0.0, float(w)), (1.0, float(w))] for w in (5, 2, 1)]))
    assert sorted(map(str, queries.op1_mixture(spark, str(tmp_path)).collect())) != first


def test_training_time_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        rows = spark.range(101).select((F.col("id") / 100).alias("share"), mixing.training_time(knots, F.col("id") / 100).alias("t")).collect()
        for r in rows:
            spent = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                x = min(max(r.t - t0, 0), t1 - t0)
                spent += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert spent / mixing.area(knots) == pytest.approx(r.share, abs=1e-9)
    assert [mixing.area(k) for k in mixing.SCHEDULES] == [5, 2, 1]


def test_training_documents_are_the_copies(nasty):
    copies = Counter()
    for r in mixing.mixture(nasty).collect():
        copies[r.doc_id, r.source] += r.copies
    rows = mixing.training_documents(nasty)
    assert rows.columns == nasty.columns
    assert Counter((r.doc_id, r.source) for r in rows.collect()) == +copies


def test_the_manifest_follows_the_training_order(spark, nasty, tmp_path):
    """The last stage gives each reading its place in time, so another curriculum gives another manifest."""
    import corpus_pipeline

    flat = [[(0.0, float(w)), (1.0, float(w))] for w in (5, 2, 1)]  # the same areas
    orders = []
    for name, schedules in (("curve", mixing.SCHEDULES), ("flat", flat)):
        path = str(tmp_path / name)
        # several files for each task
        mixing.training_documents(nasty, schedules).write.option("maxRecordsPerFile", 5).parquet(path)
        times = [(t, (r.doc_id is not None, r.doc_id or 0)) for r in mixing.mixture(nasty, schedules).collect() for t in r.positions]
        rows = sorted(corpus_pipeline.sharded(spark, spark.read.parquet(path), "").collect(), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(times)))
        assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [d for _, d in sorted(times)]
        assert [(r.shard, r.slot) for r in rows] == sorted((r.shard, r.slot) for r in rows)
        orders.append([r.doc_id for r in rows])
    assert sorted(map(str, orders[0])) == sorted(map(str, orders[1])) and orders[0] != orders[1]
    ready = spark.range(40).selectExpr("40 - id AS doc_id", "'t' AS text").coalesce(1)
    with pytest.raises(ValueError):  # rows of no file have no stored order
        sharding.shard_in_order(ready, 3, ["doc_id"])
    ready.write.parquet(str(tmp_path / "ready"))
    stored = spark.read.parquet(str(tmp_path / "ready"))
    assert [r.doc_id for r in sharding.shard_in_order(stored, 3, ["doc_id"]).orderBy("position").collect()] == list(range(40, 0, -1))
    file = next((tmp_path / "ready").glob("part-*.parquet"))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "rows.parquet").write_bytes(file.read_bytes())
    with pytest.raises(Exception, match="no numbered file"):
        sharding.shard_in_order(spark.read.parquet(str(tmp_path / "other")), 3, ["doc_id"]).collect()


def test_token_counts_are_the_librarys(nasty):
    counter = token_counts.PrefixCounter(MODEL)
    rows = token_counts.count_tokens(nasty, ["doc_id", "text"], MODEL, 50, tables=True).collect()
    import zstandard

    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(counter.library.encode(text)) and r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 50)
        counts = token_counts.prefix_counts(zstandard.ZstdDecompressor().decompress(r.prefix_table))
        assert len(counts) == len(text) + 1
        for n in {min(len(text), x) for x in (0, 1, 2, 3, 7, 20, 55, 111, len(text))}:
            assert counts[n] == len(counter.library.encode(text[:n]))
        if r.over_limit:
            assert len(counter.library.encode(text[: r.fit_chars])) <= 50


def test_prefixes_of_odd_strings():
    import random

    counter, rnd = token_counts.PrefixCounter(MODEL), random.Random(2)
    parts = ["a", "the", " ", "  ", "   ", "\n", "\t", "\r\n", "\u00e9", "\u6f22", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>", "\u2581", "\u2581\u2581", "\u200b", "ing", " the", "!!", "23"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        wanted = [len(x) for x in counter.library.encode([text[:i] for i in range(len(text) + 1)])]
        assert token_counts.prefix_counts(counter.table(text)).tolist() == wanted, text


def plain_counts(text) -> tuple:
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    runs = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if runs[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_without_a_model(nasty):
    rows = quality_rules.judge(nasty, None, ["doc_id", "text", "kept", "n_words"]).collect()
    assert len(rows) == nasty.count()
    for r in rows:
        found = plain_counts(r.text)
        assert tuple(r[c] for c in quality_rules.COUNTS) == found, r.text
        assert r.base_failed == (found[0] < 10 or 100 * found[4] > 20 * found[0]) and r.kept == (not r.base_failed)
    kept = quality_rules.kept_documents(nasty, None)
    assert kept.schema.names == nasty.schema.names and kept.count() == sum(r.kept for r in rows)


def test_empty_tables(nothing):
    assert sharding.shard_documents(nothing, 24, ["doc_id"]).count() == 0
    assert mixing.mixture(nothing).count() == 0 and mixing.training_documents(nothing).count() == 0
    assert token_counts.count_tokens(nothing, ["doc_id"], MODEL, 9).count() == 0
    assert quality_rules.judge(nothing, None, ["doc_id"]).count() == 0


def test_platt_keeps_order():
    import numpy as np

    x = np.linspace(-3, 3, 50)
    slope, offset = quality_rules.platt(x, (x > 0.5).astype(int))
    assert slope > 0 and math.isfinite(offset)
