"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, numpy gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, free_of
from .ngram_features import BITS, FAMILIES, fitted, labelled_sample, linear_scores

KINDS = FAMILIES + 1  # word and character n-grams, and patterns of repeated words


@dataclass(frozen=True)
class Settings:
    """``documents`` bounds the labelled rows that are learnt from; all rows are scored."""

    documents: int = 4000
    dimensions: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 40.0
    seed: int = 5


def fit(settings: Settings):
    """Learns a vector for each bucket and a vector and bias for each of the two labels."""

    def run(fold: np.ndarray, label: np.ndarray, ids: list[np.ndarray], weights: list[np.ndarray]) -> bytes:
        random = np.random.default_rng(settings.seed)
        d, rows = settings.dimensions, len(label)
        vectors = random.uniform(-1 / d, 1 / d, (KINDS << BITS, d)).astype(np.float32)
        output, bias = random.uniform(-1, 1, (2, d)).astype(np.float32), np.log(np.bincount(label, minlength=2) + 1.0).astype(np.float32)
        bias -= bias.mean()
        steps, step = settings.epochs * max(1, -(-rows // settings.batch)), 0
        for _ in range(settings.epochs):
            order = random.permutation(rows)
            for start in range(0, rows, settings.batch):
                rate = settings.rate * (1 - step / steps)
                step += 1
                own = order[start : start + settings.batch]
                size = np.array([len(ids[i]) for i in own])
                at, share = np.concatenate([ids[i] for i in own]), np.concatenate([weights[i] for i in own]) / KINDS
                row = np.repeat(np.arange(len(own)), size)
                mean = np.stack([np.bincount(row, share * vectors[at, k], minlength=len(own)) for k in range(d)], axis=1)
                logits = mean @ output.T + bias
                chance = np.exp(logits - logits.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                chance[np.arange(len(own)), label[own]] -= 1
                error = chance / len(own)
                back = error @ output
                output -= (rate / 40 * error.T @ mean).astype(np.float32)
                bias -= (rate / 40 * error.sum(axis=0)).astype(np.float32)
                touched, place = np.unique(at, return_inverse=True)
                for k in range(d):
                    vectors[touched, k] -= rate * np.bincount(place, share * back[row, k], minlength=len(touched)).astype(np.float32)
        # A score needs the difference of the two logits only, which is linear in the vectors.
        table = (vectors @ (output[1] - output[0]) / KINDS).astype(np.float32)
        return np.concatenate((table, [bias[1] - bias[0]])).astype(np.float32).tobytes()

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings(), text: str = "text") -> np.ndarray | None:
    """Bucket table and, last, the bias; None without labelled rows. Documents of fold 2 are never learnt from."""
    model = fitted(labelled_sample(docs, labels, label, settings.documents, (0, 1, 3), text, patterns=True), fit(settings))
    return None if model is None else np.frombuffer(model, np.float32)


def score(docs: DataFrame, model: np.ndarray | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` plus score, the chance of label 1 from the whole text.

    A null or empty text, or one shorter than every n-gram, gets the chance that the biases alone give; without a
    model every score is 0.5. The model has a fixed size, whatever the corpus.
    """
    keep = free_of(keep, ("score",))
    rows = docs.select(*keep, F.col(text).alias("_q_text"))
    kept = docs.select(*keep).schema
    schema = to_arrow_schema(kept).append(pa.field("score", pa.float64()))
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros((KINDS << BITS) + 1, np.float32) if model is None else model)

    def run(batches):
        table, bias = shared.value[:-1], float(shared.value[-1])
        for batch in batches:
            for chunk in chunks(batch, "_q_text"):
                chance = 1 / (1 + np.exp(-np.clip(linear_scores(chunk["_q_text"], table, patterns=True) + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(chunk[c] for c in keep), pa.array(chance)], schema=schema)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return rows.mapInArrow(run, f"{fields}, score double")
