"""Training of both classifiers, and the verdicts they give, against plain versions that go document by document."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tellerlake.llm import ngram_features, quality_embeddings, quality_rules

from documents import nasty  # noqa: F401


@pytest.fixture(scope="module")
def sample():
    """fold, label, ids and weights of 30 short documents; one has no features."""
    rnd = np.random.default_rng(12)
    texts = ["" if i == 7 else " ".join(rnd.choice(["good", "fine", "plain", "text"] if i % 3 else ["junk", "spam", "plain", "buy"], 6)) for i in range(30)]
    rows = ngram_features.sparse_rows(pa.array(texts), patterns=True)
    return np.arange(30) % 4 % 3 + (np.arange(30) % 4 == 2), np.array([int(i % 3 > 0) for i in range(30)]), [i for i, _ in rows], [w for _, w in rows]


def test_softmax_descent(sample):
    fold, label, ids, weights = sample
    settings = quality_embeddings.Settings(dimensions=3, epochs=2, batch=4)
    model = np.frombuffer(quality_embeddings.fit(settings)(fold, label, ids, weights), np.float32)
    random, d, kinds = np.random.default_rng(settings.seed), settings.dimensions, quality_embeddings.KINDS
    vectors = random.uniform(-1 / d, 1 / d, (kinds << ngram_features.BITS, d))
    output = random.uniform(-1, 1, (2, d))
    bias = np.log([(label == 0).sum() + 1.0, (label == 1).sum() + 1.0])
    bias -= bias.mean()
    steps, step = settings.epochs * math.ceil(len(label) / settings.batch), 0
    for _ in range(settings.epochs):
        order = random.permutation(len(label))
        for start in range(0, len(label), settings.batch):
            batch, rate = order[start : start + settings.batch], settings.rate * (1 - step / steps)
            step += 1
            of_vectors, of_output, of_bias = defaultdict(lambda: np.zeros(d)), np.zeros((2, d)), np.zeros(2)
            for doc in batch:
                mean = sum((w / kinds * vectors[i] for i, w in zip(ids[doc], weights[doc])), np.zeros(d))
                chance = np.exp(output @ mean + bias)
                error = (chance / chance.sum() - np.eye(2)[label[doc]]) / len(batch)
                of_output += np.outer(error, mean)
                of_bias += error
                for i, w in zip(ids[doc], weights[doc]):
                    of_vectors[i] += w / kinds * (error @ output)
            output -= rate / 40 * of_output
            bias -= rate / 40 * of_bias
            for i, slope in of_vectors.items():
                vectors[i] -= rate * slope
    assert np.allclose(model[:-1], vectors @ (output[1] - output[0]) / kinds, atol=1e-4)
    assert model[-1] == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_logistic_descent_and_calibration(sample):
    fold, label, ids, weights = sample
    keep = [i < ngram_features.FAMILIES << ngram_features.BITS for i in ids]
    ids, weights = [i[k] for i, k in zip(ids, keep)], [w[k] for w, k in zip(weights, keep)]
    rules = quality_rules.Rules(epochs=3, batch=4)
    model = np.frombuffer(quality_rules.fit(rules)(fold, label, ids, weights), np.float32).astype(float)
    learn, check = [i for i in range(30) if fold[i] != 3], [i for i in range(30) if fold[i] == 3]
    assert learn and check
    table, squares, random = defaultdict(float), defaultdict(lambda: 1e-8), np.random.default_rng(rules.seed)
    ones = sum(label[i] for i in learn)
    bias = math.log((ones + 1) / (len(learn) - ones + 1))

    def logit(doc):
        return sum(w * table[i] for i, w in zip(ids[doc], weights[doc])) + bias

    for _ in range(rules.epochs):
        order = random.permutation(np.array(learn))
        for start in range(0, len(order), rules.batch):
            batch, slopes = order[start : start + rules.batch], defaultdict(float)
            errors = {doc: (1 / (1 + math.exp(-logit(doc))) - label[doc]) / len(batch) for doc in batch}
            for doc, error in errors.items():
                for i, w in zip(ids[doc], weights[doc]):
                    slopes[i] += w * error
            for i, slope in slopes.items():
                squares[i] += slope * slope
                table[i] -= rules.rate * slope / math.sqrt(squares[i])
            bias -= 0.1 * sum(errors.values())
    largest = max(table, key=lambda i: abs(table[i]))
    scale = model[largest] / table[largest]
    assert scale > 0
    plain = np.zeros(len(model) - 1)
    plain[list(table)] = [scale * v for v in table.values()]
    assert np.allclose(model[:-1], plain, atol=1e-4 * np.abs(plain).max())
    # The calibration is where the slope of the loss on the smoothed labels of fold 3 vanishes.
    offset, good = model[-1] - scale * bias, sum(label[i] for i in check)
    wanted = {i: (good + 1) / (good + 2) if label[i] else 1 / (len(check) - good + 2) for i in check}
    error = {i: 1 / (1 + math.exp(-(scale * logit(i) + offset))) - wanted[i] for i in check}
    assert abs(sum(error.values())) < 1e-3 and abs(sum(e * logit(i) for i, e in error.items())) < 1e-3 * max(1, max(abs(logit(i)) for i in check))


@pytest.mark.parametrize("seed", range(6))
def test_calibration_of_well_parted_labels(seed):
    """The slope of the loss vanishes, however far the logits lie apart and however unlike the labels' shares are."""
    rnd = np.random.default_rng(seed)
    label = (rnd.random(200) < (0.5, 0.9, 0.97)[seed % 3]).astype(int)
    logit = rnd.normal(scale=1 + seed, size=200) + label * (2 + 3 * seed) + 4 * (seed % 2)
    slope, offset = quality_rules.platt(logit, label)
    ones = label.sum()
    wanted = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (200 - ones + 2))
    error = 1 / (1 + np.exp(-(slope * logit + offset))) - wanted
    assert slope > 0 and abs(error.sum()) < 1e-3 and abs(error @ logit) < 1e-2


def test_verdicts_document_by_document(spark, nasty):
    """Scores and verdicts of any table are those of each text alone, added up feature by feature."""
    rnd = np.random.default_rng(8)
    table = rnd.normal(scale=2, size=(quality_embeddings.KINDS << ngram_features.BITS) + 1).astype(np.float32)
    short = np.concatenate((table[: ngram_features.FAMILIES << ngram_features.BITS], [np.float32(0.3)])).astype(np.float32)

    def chance(text, model, patterns):
        ids, weights = ngram_features.sparse_rows(pa.array([text], pa.string()), patterns)[0]
        return 1 / (1 + math.exp(-(sum(float(w) * float(model[i]) for i, w in zip(ids, weights)) + float(model[-1]))))

    scored = quality_embeddings.score(nasty, table, ["doc_id", "text"]).collect()
    assert all(r.score == pytest.approx(chance(r.text, table, True), abs=1e-4) for r in scored)
    judged = quality_rules.judge(nasty, short, ["doc_id", "text"]).collect()
    for r in judged:
        p = chance(r.text, short, False)
        assert r.probability == pytest.approx(p, abs=1e-4)
        assert abs(p - 0.5) < 1e-3 or r.kept == (not r.base_failed and p >= 0.5)
    assert len({r.kept for r in judged}) == 2
