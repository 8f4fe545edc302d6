"""Classifiers by held-out accuracy, chat repair by search over all repairs, and the pipeline by a plain version."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tellerlake.llm import chat_repair, mixing, ngram_features, quality_embeddings, quality_rules, queries
from tellerlake.llm.common import table

from documents import nasty, nothing  # noqa: F401

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").collect()}


def test_quality_scores_on_held_out_rows(spark, labels):
    rows = queries.op2_quality_scores(spark, MIDDLE).collect()
    assert len(rows) == table(spark, MIDDLE, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_rules_on_held_out_rows(spark, labels):
    rows = [r for r in queries.op5_quality_rules(spark, MIDDLE).collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in rows if not r.base_failed]) > 0.9


def test_models_of_nasty_documents(spark, nasty, nothing):
    labels = spark.createDataFrame([(-3, 1), (4, 0), (4, 1), (4, 0), (60, 1), (67, 0), (None, 1), (74, None), (9999, 1), (81, 1), (88, 0), (95, 1)], "doc_id long, quality int")
    for rows, marks in ((nasty, labels), (nasty, labels.limit(0)), (nothing, labels)):
        model = quality_embeddings.train(rows, marks)
        scored = quality_embeddings.score(nasty, model, ["doc_id", "shard"]).collect()
        assert len(scored) == nasty.count() and all(0 <= r.score <= 1 for r in scored)
        judged = quality_rules.judge(nasty, quality_rules.train(rows, marks), ["doc_id"])
        assert judged.count() == nasty.count()
    first, second = (quality_embeddings.train(nasty, labels) for _ in range(2))
    assert np.array_equal(first, second)


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["some words here", None, "", "a", "x" * 5000, "some words here", "\U0001f600 \u00e9t\u00e9 #tag"]
    table_ = np.random.default_rng(0).normal(size=ngram_features.FAMILIES << ngram_features.BITS).astype(np.float32)
    together = ngram_features.linear_scores(pa.array(texts), table_)
    alone = [ngram_features.linear_scores(pa.array([t], pa.string()), table_)[0] for t in texts]
    assert np.allclose(together, alone) and together[1] == together[2] == 0
    one, other = (ngram_features.word_patterns(np.array(c), 4).tolist() for c in ([7, 7, 7, 7, 8], [5, 5, 5, 5, 1]))
    assert one == other and one[0] != one[1] and ngram_features.word_patterns(np.array([1, 2, 1]), 4).size == 0
    ids, weights = ngram_features.sparse_rows(pa.array(["abcd"]))[0]
    assert weights.sum() == pytest.approx(3)  # one word, no pair of words, two families of characters


def plain_cost(roles: list[int], costs=chat_repair.Costs()) -> int:
    """Cheapest repair by search over the roles of an output conversation and how inputs map to it."""
    best = {chat_repair.START: 0}

    def with_inserts(states):
        out = dict(states)
        for _ in range(4):
            for state, cost in list(out.items()):
                for role, after in chat_repair.LEGAL[state].items():
                    if role != 0 and cost + costs.insert < out.get(after, 1 << 30):
                        out[after] = cost + costs.insert
        return out

    for given in roles:
        new = {}
        for state, cost in best.items():
            if state in chat_repair.SPOKEN:
                role = chat_repair.SPOKEN[state]
                new[state] = min(new.get(state, 1 << 30), cost + costs.merge + costs.relabel * (role != given))
        for state, cost in with_inserts(best).items():
            for role, after in chat_repair.LEGAL[state].items():
                new[after] = min(new.get(after, 1 << 30), cost + costs.relabel * (role != given))
        best = new
    return with_inserts(best)[chat_repair.ASSISTANT]


def test_repair_is_cheapest_and_legal():
    table_, steps, close = chat_repair.matrices(chat_repair.Costs()), chat_repair.turn_steps(chat_repair.Costs()), chat_repair.endings(chat_repair.Costs())
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            path, total = chat_repair.best_path(np.array(roles), np.arange(n), chat_repair.START, None, table_, close)
            assert total == plain_cost(list(roles)), roles
            spoken, state = [], chat_repair.START
            for role, after in zip(roles, path):
                step = steps[role][state, after]
                spoken += list(step.inserted) + ([] if step.merged else [step.role])
                state = after
            spoken += close[state][1]
            body = spoken[1:] if spoken[0] == 0 else spoken
            assert body == [1, 2] * (len(body) // 2) and len(body) >= 2


def test_a_long_conversation_is_cut_and_joined(spark, monkeypatch):
    """The same repair whether one task or many hold a conversation, and rendered pieces that add up."""
    rnd = random.Random(6)
    names = ["user", "assistant", "system", " USER ", None, "tool"]
    rows = [(1, i, rnd.choice(names), f"t{i}") for i in range(300)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, None, "system", None), (2, 1, "assistant", ""), (None, 5, "user", "lost"), (3, 0, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def run(parts):
        monkeypatch.setattr(chat_repair, "PART_ROWS", parts)
        return sorted((tuple(r) for r in chat_repair.repair(turns).collect()), key=str)

    cut, whole = run(7), run(10_000)
    assert cut == whole and len(whole) == len(set(rows))
    conversations = defaultdict(list)
    for r in whole:
        conversations[r[0]].append(r)
    for conv, own in conversations.items():
        own.sort(key=lambda r: r[4])
        assert [r[4] for r in own] == list(range(len(own))) and sum(r[8] for r in own) == own[0][9]
        text = "".join(r[10] for r in own)
        spoken = [part.split("|>")[0] for part in text.split("<|")[1:] if not part.startswith("end|>")]
        body = spoken[1:] if spoken[0] == "system" else spoken
        assert body == ["user", "assistant"] * (len(body) // 2)
    assert [r[3] for r in conversations[2]] == [1, 2, 1]  # a repeated turn counts once
    long = [chat_repair.role_number(r) for _, _, r, _ in rows[:300]]
    assert conversations[1][0][9] == plain_cost(long)
    assert chat_repair.repair(turns.limit(0)).count() == 0


def test_pipeline_equals_a_plain_version(spark):
    """Every stage of run() by brute force; the verdicts of the trained model are taken from the model itself."""
    from test_counting import plain_counts, water_level, words
    from test_matching import gram_set, plain_components

    docs = table(spark, SMALL, "documents")
    model = quality_rules.train(docs, table(spark, SMALL, "labels"))
    good = {r.doc_id for r in quality_rules.judge(docs, model, ["doc_id"]).filter("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    for r in rows:
        n, _, _, _, repeated = plain_counts(r.text)
        assert n >= 10 and 100 * repeated <= 20 * n
    first = {d for d, _, c in plain_components([(r.doc_id, r.text) for r in rows]) if d == c}
    items = [gram_set(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    left = [r for r in rows if r.doc_id in first and not any(100 * len(i & gram_set(r.text)) >= 80 * len(i) for i in items)]
    by_source = defaultdict(list)
    for r in left:
        by_source[r.source].append((hashlib.md5(f"{r.doc_id}/{r.text}".encode()).hexdigest(), r.doc_id, len(words(r.text))))
    sizes = {s: sum(n for *_, n in own) for s, own in by_source.items()}
    target = water_level(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(sorted(sizes))})
    wanted = defaultdict(int)
    for s, own in by_source.items():
        run = 0
        for _, doc, n in sorted(own):
            whole = int(target[s] // sizes[s])
            wanted[doc] = whole + (run + n / 2 < target[s] - whole * sizes[s])
            run += n
    out = corpus_pipeline.run(spark, SMALL).collect()
    found = defaultdict(int)
    for r in out:
        found[r.doc_id] += 1
    assert dict(found) == {d: n for d, n in wanted.items() if n}
    size = {r.doc_id: len(r.text.encode()) + 8 for r in left}
    total, run = sum(size[r.doc_id] for r in out), 0
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        assert r["size"] == size[r.doc_id] and r.shard == min(23, (2 * run + r["size"]) * 24 // (2 * total))
        run += r["size"]


def test_stages_keep_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and mixing.MAX_REPEATS == 3
