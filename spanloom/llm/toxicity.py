"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, trained jointly in numpy.

A misspelled word that was never seen still shares most of its n-grams, and so its vectors, with words that were.
One insult in a long document would vanish in the document's average; so the average is taken over windows of
WINDOW characters that overlap by half and cover the whole text, and the document takes its worst window. A word that
is repeated over and over stands once, else its few n-grams alone would make a window's average.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded_sample, in_fold, table, text_udf, tune

BITS, SIZES, DIM = 18, (3, 4, 5), 8
BLOCK = 48
WINDOW = 2 * BLOCK
#: A window with fewer n-grams is averaged as if it had so many.
LEAST = 100
#: Blocks that are hashed at a time: it bounds memory for very long texts.
SLICE = 4096 * BLOCK
#: Labelled rows that training takes of each class, at most, and the longest text among them.
TRAIN_ROWS, TRAIN_CHARS = 1000, 20_000
#: Windows that training draws anew from a clean text in each pass, at most.
CLEAN_WINDOWS = 12

_STEP, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _characters(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    words = [w for w, before in zip(words, [None, *words], strict=False) if w != before]
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), dtype="<u4")


def _buckets(chars: np.ndarray, count: int):
    """For each n-gram size: buckets of the n-grams that begin at the first count characters, and which of them exist.

    An n-gram may begin or end with a space, the mark of a word's edge, but has none inside.
    """
    padded = np.append(chars[: count + SIZES[-1]], np.zeros(max(0, count + SIZES[-1] - len(chars)), dtype=np.uint32))
    h = padded[:count] * _STEP
    inner = np.ones(count, dtype=bool)
    for n in range(2, SIZES[-1] + 1):
        last = padded[n - 1 : n - 1 + count]
        h = (h ^ last) * _MIX
        h ^= h >> np.uint32(15)
        if n in SIZES:
            yield (h * _STEP) >> np.uint32(32 - BITS), inner & (last != 0)
        inner = inner & (last != 32)


def _block_sums(text: str | None, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per block of BLOCK characters: the sum of the weights of its n-grams, and how many there are."""
    chars = _characters(text)
    sums, counts = [], []
    for a in range(0, len(chars), SLICE):
        count = min(SLICE, len(chars) - a)
        blocks = -(-count // BLOCK)
        total, number = np.zeros(blocks * BLOCK, dtype=np.float32), np.zeros(blocks * BLOCK, dtype=np.float32)
        for bucket, real in _buckets(chars[a:], count):
            total[:count] += weight[bucket] * real
            number[:count] += real
        sums.append(total.reshape(blocks, BLOCK).sum(1))
        counts.append(number.reshape(blocks, BLOCK).sum(1))
    return np.concatenate(sums), np.concatenate(counts)


def _window_bags(text: str) -> list[np.ndarray]:
    """The buckets in each half-overlapping window."""
    chars = _characters(text)
    per_size = [np.where(real, bucket.astype(np.int64), -1) for bucket, real in _buckets(chars, len(chars))]
    out = []
    for a in range(0, max(1, len(chars) - BLOCK), BLOCK):
        bag = np.concatenate([x[a : a + WINDOW] for x in per_size])
        out.append(bag[bag >= 0])
    return out


@dataclass
class Model:
    """weight: per bucket, its vector times the difference of the two softmax rows. scale and shift calibrate the worst window."""

    weight: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = -2.0

    def window_logits(self, text: str | None) -> np.ndarray:
        sums, counts = _block_sums(text, self.weight)
        if len(sums) > 1:
            sums, counts = sums[:-1] + sums[1:], counts[:-1] + counts[1:]
        return sums / np.maximum(counts, LEAST) + self.bias

    def score(self, text: str | None) -> float:
        z = self.scale * float(self.window_logits(text).max()) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _train_bags(vectors, rows, grad_vectors, grad_rows, bags, labels, weights, rate, order) -> None:
    """One pass of mini-batches: averaged vectors, softmax, and Adagrad on both layers together."""
    for a in range(0, len(order), 64):
        pick = [i for i in order[a : a + 64] if len(bags[i])]
        if not pick:
            continue
        sizes = np.array([len(bags[i]) for i in pick])
        flat = np.concatenate([bags[i] for i in pick])
        mean = np.add.reduceat(vectors[flat], np.append(0, np.cumsum(sizes)[:-1]), axis=0) / np.maximum(sizes, LEAST)[:, None]
        logits = mean @ rows[:-1] + rows[-1]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = labels[pick]
        delta = p.copy()
        delta[np.arange(len(pick)), y] -= 1
        delta *= weights[y][:, None] / len(pick)
        g_rows = np.vstack([mean.T @ delta, delta.sum(0)])
        back = delta @ rows[:-1].T
        unique, where = np.unique(flat, return_inverse=True)
        each = back / np.maximum(sizes, LEAST)[:, None]
        g = np.column_stack([np.bincount(where, np.repeat(each[:, k], sizes), len(unique)) for k in range(each.shape[1])]).astype(np.float32)
        grad_rows += g_rows**2
        rows -= rate * g_rows / np.sqrt(grad_rows + 1e-10)
        grad_vectors[unique] += g**2
        vectors[unique] -= rate * g / np.sqrt(grad_vectors[unique] + 1e-12)


def _worst(bags: list[np.ndarray], weight: np.ndarray, count: int = 2) -> list[np.ndarray]:
    full = [b for b in bags if len(b)]
    sizes = np.array([len(b) for b in full])
    if not full:
        return []
    means = np.add.reduceat(weight[np.concatenate(full)], np.append(0, np.cumsum(sizes)[:-1])) / np.maximum(sizes, LEAST)
    return [full[i] for i in np.argsort(-means, kind="stable")[:count]]


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the documents' worst windows, by Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones_like(z)])
    w = np.zeros(2)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Learns from whole labelled texts.

    First each window carries its document's label; after that a toxic document is its worst windows. A clean document
    is CLEAN_WINDOWS windows, drawn anew in each pass, and from the third pass on its worst ones too.
    With one class only, or none, the score is constant.
    """
    y = np.array(labels, dtype=int)
    model = Model(np.zeros(1 << BITS, dtype=np.float32))
    if len(set(labels)) < 2:
        model.scale, model.shift = 0.0, 4.0 if len(y) and y[0] else -4.0
        return model
    rng = np.random.default_rng(seed)
    docs = [_window_bags(t) for t in texts]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    rows = np.zeros((DIM + 1, 2), dtype=np.float32)
    grad_vectors, grad_rows = np.zeros_like(vectors), np.zeros_like(rows)
    for epoch in range(6):
        bags, marks = [], []
        for d, label in zip(docs, y, strict=True):
            if epoch < 2 or not label:
                keep = d if label else [d[i] for i in rng.permutation(len(d))[:CLEAN_WINDOWS]]
            else:
                keep = _worst(d, model.weight)
            if epoch >= 2 and not label:
                keep = keep + _worst(d, model.weight)
            bags += keep
            marks += [label] * len(keep)
        marks = np.array(marks)
        share = np.bincount(marks, minlength=2) / len(marks)
        _train_bags(vectors, rows, grad_vectors, grad_rows, bags, marks, (0.5 / np.maximum(share, 0.02)).astype(np.float32), 0.2, rng.permutation(len(bags)))
        model.weight = (vectors @ (rows[:-1, 1] - rows[:-1, 0])).astype(np.float32)
        model.bias = float(rows[-1, 1] - rows[-1, 0])
    # buckets that no text of the sample has keep no random weight
    seen = grad_vectors.any(axis=1)
    model.weight[~seen] = 0
    z = np.array([model.window_logits(t).max() for t in texts], dtype=float)
    model.scale, model.shift = _calibrated(z, y)
    return model


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int = 5, rows: int = TRAIN_ROWS, longest: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """At most rows labelled texts of each class, none from fold 0 and none longer than longest characters.

    Of rows with one doc_id the least label and the least text count.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    known = marked.join(texts.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = [bounded_sample(known.where(F.col("label") == v), "doc_id", rows) for v in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * rows rows of two numbers
    found = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id").collect()
    return [r["text"] for r in found], [r["label"] for r in found]


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    return train(*training_rows(documents, labels, "toxic"))


def scorer(model: Model):
    """Column function: text to the probability of toxicity. A null text scores as an empty one."""
    return text_udf(lambda: lambda texts: [model.score(t) for t in texts], "double", pa.float64())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; only doc_id and text are read, so other columns may have any name.

    Null and empty texts score as a text without n-grams; repeated rows score alike, each in its own row; a null
    doc_id stays null and is not held out; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
