"""Quality by a byte-level convolutional network in numpy.

Bytes have vectors; learned filters run over every position of a document. Chunks of CHUNK positions overlap by half
and cover the whole document; each filter's largest response in a chunk feeds two dense layers, which say how bad the
chunk is. The worst chunk decides the document, by one calibrated probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_fold, table, text_udf, tune
from .toxicity import _calibrated, training_rows

WIDTH, DIM, FILTERS, HIDDEN = 8, 4, 16, 12
HALF = 128
CHUNK = 2 * HALF
#: Positions that are filtered at a time: it bounds memory for very long texts.
SLICE = 64 * HALF
#: Labelled rows that training takes of each class, at most, and the longest text among them.
TRAIN_ROWS, TRAIN_CHARS = 700, 12_000
STEPS, BATCH = 700, 48


def _bytes(text: str | None) -> np.ndarray:
    """The UTF-8 bytes, followed by zeros up to whole half chunks, one chunk at least, and a filter's width."""
    raw = (text or "").encode("utf-8", "replace")
    positions = max(2, -(-len(raw) // HALF)) * HALF
    return np.frombuffer(raw + bytes(positions + WIDTH - 1 - len(raw)), dtype=np.uint8)


@dataclass
class Model:
    vectors: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    dense: np.ndarray
    dense_offset: np.ndarray
    out: np.ndarray
    out_offset: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    PARTS = ("vectors", "filters", "offset", "dense", "dense_offset", "out", "out_offset")

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Each filter at each position: (positions, FILTERS), before the offset and rectifier, which keep the order."""
        flat = np.take(self.vectors, data, axis=0).reshape(-1)
        n = len(data) - WIDTH + 1
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (flat.strides[0] * DIM, flat.strides[0])) @ self.filters

    def chunk_logits(self, text: str | None) -> np.ndarray:
        """How bad each chunk is."""
        data = _bytes(text)
        n = len(data) - WIDTH + 1
        tops = []
        for a in range(0, n, SLICE):
            response = self.responses(data[a : min(a + SLICE, n) + WIDTH - 1])
            tops.append(np.maximum.reduceat(response, np.arange(0, len(response), HALF), axis=0))
        top = np.concatenate(tops)
        return self.judge(np.maximum(top[:-1], top[1:]))

    def judge(self, pooled: np.ndarray) -> np.ndarray:
        features = np.maximum(pooled + self.offset, 0)
        return np.maximum(features @ self.dense + self.dense_offset, 0) @ self.out + self.out_offset[0]

    def score(self, text: str | None) -> float:
        """The probability that quality is 1."""
        z = self.scale * float(self.chunk_logits(text).max()) + self.shift
        return float(1 / (1 + np.exp(np.clip(z, -40, 40))))


def _fresh(rng: np.random.Generator) -> Model:
    draw = lambda fan, *shape: (rng.normal(0, np.sqrt(2 / fan), shape)).astype(np.float32)
    return Model(draw(2 * DIM, 256, DIM), draw(WIDTH * DIM, WIDTH * DIM, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, HIDDEN), np.zeros(1, np.float32))


def _gradients(m: Model, chunks: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """chunks: (n, CHUNK + WIDTH - 1) bytes. The gradient runs through each filter's best position only."""
    n = len(chunks)
    windows = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)
    columns = m.vectors[windows].reshape(n, CHUNK, WIDTH * DIM)
    response = columns @ m.filters
    best = response.argmax(1)
    pooled = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
    features = np.maximum(pooled + m.offset, 0)
    hidden = np.maximum(features @ m.dense + m.dense_offset, 0)
    z = hidden @ m.out + m.out_offset[0]
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) * weight / n
    dh = np.outer(dz, m.out) * (hidden > 0)
    df = (dh @ m.dense.T) * (features > 0)
    at_best = columns[np.arange(n)[:, None], best]  # (n, FILTERS, WIDTH * DIM)
    d_vectors = np.zeros_like(m.vectors)
    back = (df[:, :, None] * m.filters.T[None]).reshape(-1, DIM)
    np.add.at(d_vectors, windows[np.arange(n)[:, None], best].reshape(-1), back)
    return {"vectors": d_vectors, "filters": np.einsum("nfk,nf->kf", at_best, df), "offset": df.sum(0), "dense": features.T @ dh, "dense_offset": dh.sum(0), "out": hidden.T @ dz, "out_offset": np.array([dz.sum()])}


def train(texts: list[str], labels: list[int], seed: int = 11, steps: int = STEPS) -> Model:
    """Learns from whole labelled texts; labels: 1 for good. With one class only, or none, the score is constant.

    A chunk first carries its document's label; in the second half of the steps a bad document is its worst chunks.
    """
    bad = 1 - np.array(labels, dtype=int)
    rng = np.random.default_rng(seed)
    model = _fresh(rng)
    if len(set(labels)) < 2:
        model.scale, model.shift = 0.0, 4.0 if len(bad) and bad[0] else -4.0
        return model
    data = [_bytes(t) for t in texts]
    spots = [np.arange(0, len(d) - CHUNK - WIDTH + 2, HALF) for d in data]
    moment = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in Model.PARTS}
    groups = [np.flatnonzero(bad == v) for v in (0, 1)]
    for step in range(steps):
        if step >= steps // 2 and step % (steps // 5) == 0:
            for i in groups[1]:
                z = model.chunk_logits(texts[i])
                spots[i] = np.argsort(-z)[:2] * HALF
        pick = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        chunks = np.stack([data[i][a : a + CHUNK + WIDTH - 1] for i in pick for a in (rng.choice(spots[i]),)])
        for i in np.flatnonzero(rng.random(len(chunks)) < 0.3):  # short texts are chunks that end in zeros
            chunks[i, int(rng.integers(64 if bad[pick[i]] else 16, CHUNK)) :] = 0
        rate = 0.004 * (1 - step / steps) + 0.0002
        for k, g in _gradients(model, chunks, bad[pick], np.ones(len(pick), np.float32)).items():
            first, second = moment[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            setattr(model, k, (getattr(model, k) - rate * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32))
    z = np.array([model.chunk_logits(t).max() for t in texts], dtype=float)
    model.scale, model.shift = _calibrated(z, bad)
    return model


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Trains on a sample with as many good as bad rows, then gives the classes the weight that all learnable labels have."""
    texts, marks = training_rows(documents, labels, "quality", rows=TRAIN_ROWS, longest=TRAIN_CHARS)
    model = train(texts, marks)
    counts = dict(labels.where(~in_fold(F.col("doc_id"), 5, 0) & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*")).collect())
    if len(counts) == 2 == len(set(marks)):
        model.shift += float(np.log(counts[0] / counts[1]) - np.log(marks.count(0) / marks.count(1)))
    return model


def scorer(model: Model):
    """Column function: text to the probability of good quality. A null text scores as an empty one."""
    return text_udf(lambda: lambda texts: [model.score(t) for t in texts], "double", pa.float64())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; only doc_id and text are read, so other columns may have any name.

    Null and empty texts score as a chunk of zero bytes; repeated rows score alike, each in its own row; a null doc_id
    stays null and is not held out; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least least."""
    tune(docs.sparkSession)
    return docs.where(scorer(model)(F.col("text")) >= least)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
