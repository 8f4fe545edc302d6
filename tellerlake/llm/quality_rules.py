"""Quality rules: counts of every text, and a calibrated n-gram logistic regression against a fixed threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, free_of, hash_strings, mix, split_words, window_hashes
from .ngram_features import BITS, FAMILIES, fitted, labelled_sample, linear_scores

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Text that is judged at a time.
CHUNK = 2 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds, and ``documents``, the bound of the labelled rows that are learnt from."""

    min_words: int = 10
    repeat_percent: int = 20
    keep_at: float = 0.5
    documents: int = 4000
    epochs: int = 8
    batch: int = 32
    rate: float = 2.0
    seed: int = 3


def repeated_words(bounds: np.ndarray, codes: np.ndarray, words: list[str], size: int = WINDOW) -> np.ndarray:
    """Words of each text inside runs of ``size`` words that the text holds twice or more."""
    texts = len(bounds) - 1
    if len(codes) < size:
        return np.zeros(texts, dtype=np.int64)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    at = np.flatnonzero(owner[: len(codes) - size + 1] == owner[size - 1 :])
    run = window_hashes(hash_strings(words)[codes], size)[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(run)
    same = run[order][1:] == run[order][:-1]
    twice = np.zeros(len(run), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of whole texts; a null text has none of anything."""
    given = [t or "" for t in texts.to_pylist()]
    bounds, codes, words = split_words(texts)
    size = np.array([len(w) for w in words], dtype=np.int64)
    chars = np.concatenate(([0], np.cumsum(size[codes]))) if len(codes) else np.zeros(1, np.int64)
    joined = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol = np.concatenate(([0], np.cumsum(np.isin(joined, [ord(c) for c in SYMBOLS]))))
    ends = np.concatenate(([0], np.cumsum([len(t) for t in given]))).astype(np.int64)
    return {"n_words": np.diff(bounds), "word_chars": chars[bounds[1:]] - chars[bounds[:-1]], "n_symbols": symbol[ends[1:]] - symbol[ends[:-1]],
            "n_dup_lines": np.array([repeated_lines(t) for t in given], dtype=np.int64), "n_repeat_words": repeated_words(bounds, codes, words)}


def platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``sigmoid(slope * logit + offset)`` a probability: Newton steps on smoothed labels.

    A step is halved until the loss falls; whole steps swing to and fro where the logits part the labels well.
    """
    ones = label.sum()
    wanted = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x, theta = np.stack([logit, np.ones(len(logit))], axis=1), np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ at) - wanted * (x @ at)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        slope = x.T @ (p - wanted)
        step, now = np.linalg.solve(hessian, slope), loss(theta)
        while np.abs(step).max() >= 1e-9 and loss(theta - step) > now - 1e-4 * (slope @ step):
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        theta = theta - step
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit(rules: Rules):
    """Logistic regression by adaptive gradient steps on folds 0 and 1, calibrated on fold 3."""

    def run(fold: np.ndarray, label: np.ndarray, ids: list[np.ndarray], weights: list[np.ndarray]) -> bytes:
        random = np.random.default_rng(rules.seed)
        learn, check = np.flatnonzero(fold != 3), np.flatnonzero(fold == 3)
        learn, check = (learn, check) if len(learn) and len(check) else (np.arange(len(label)), np.arange(len(label)))
        ones = label[learn].sum()
        table, squares = np.zeros(FAMILIES << BITS), np.full(FAMILIES << BITS, 1e-8)
        bias = float(np.log((ones + 1) / (len(learn) - ones + 1)))
        for _ in range(rules.epochs):
            order = random.permutation(learn)
            for start in range(0, len(order), rules.batch):
                own = order[start : start + rules.batch]
                row = np.repeat(np.arange(len(own)), [len(ids[i]) for i in own])
                at, share = np.concatenate([ids[i] for i in own]), np.concatenate([weights[i] for i in own])
                logit = np.bincount(row, share * table[at], minlength=len(own)) + bias
                error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - label[own]) / len(own)
                touched, place = np.unique(at, return_inverse=True)
                slope = np.bincount(place, share * error[row], minlength=len(touched))
                squares[touched] += slope * slope
                table[touched] -= rules.rate * slope / np.sqrt(squares[touched])
                bias -= 0.1 * error.sum()
        logit = np.array([weights[i] @ table[ids[i]] for i in check]) + bias
        slope, offset = platt(logit, label[check])
        return np.concatenate((slope * table, [slope * bias + offset])).astype(np.float32).tobytes()

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rules: Rules = Rules(), text: str = "text") -> np.ndarray | None:
    """Calibrated weights and, last, the bias; None without labelled rows."""
    model = fitted(labelled_sample(docs, labels, label, rules.documents, (0, 1, 3), text), fit(rules))
    return None if model is None else np.frombuffer(model, np.float32)


def probabilities(texts: pa.Array, model: np.ndarray | None) -> np.ndarray:
    """Calibrated probability of good quality; 1 without a model."""
    if model is None:
        return np.ones(len(texts))
    return 1 / (1 + np.exp(-np.clip(linear_scores(texts, model[:-1]) + float(model[-1]), -500, 500)))


def judge(docs: DataFrame, model: np.ndarray | None, keep: list[str], rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The columns ``keep`` plus the base counts, base_failed, probability and kept, over whole texts.

    A text fails the base rules with fewer than ``min_words`` words, or if more than ``repeat_percent`` percent of
    its words stand in repeated runs; null and empty texts fail. Otherwise it is kept if the calibrated probability
    of good quality reaches ``keep_at``. Without a model only the base rules decide. Clashing names are replaced.
    """
    keep = free_of(keep, (*COUNTS, "base_failed", "probability", "kept"))
    rows = docs.select(*keep, F.col(text).alias("_r_text"))
    kept = docs.select(*keep).schema
    schema = to_arrow_schema(kept)
    for name in COUNTS:
        schema = schema.append(pa.field(name, pa.int64()))
    schema = schema.append(pa.field("probability", pa.float64()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch, "_r_text"):
                found = counts(chunk["_r_text"])
                yield pa.RecordBatch.from_arrays([*(chunk[c] for c in keep), *(pa.array(found[c], pa.int64()) for c in COUNTS),
                                                  pa.array(probabilities(chunk["_r_text"], shared.value))], schema=schema)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.fields)
    judged = rows.mapInArrow(run, fields + ", ".join(f"{c} long" for c in COUNTS) + ", probability double")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= rules.keep_at))


def kept_documents(docs: DataFrame, model: np.ndarray | None, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch, text):
                found = counts(chunk[text])
                good = (found["n_words"] >= rules.min_words) & (100 * found["n_repeat_words"] <= rules.repeat_percent * found["n_words"])
                yield chunk.filter(pa.array(good & (probabilities(chunk[text], shared.value) >= rules.keep_at)))

    return docs.mapInArrow(run, docs.schema)
