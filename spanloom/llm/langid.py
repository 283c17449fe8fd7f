"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed; a text's frequencies sum to one for each size, times the n-gram's
inverse document frequency. Follow-the-regularised-leader with an elastic net keeps few weights; a temperature
fitted on texts set aside makes the probabilities honest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded_sample, in_fold, table, text_udf, tune

BITS, SIZES = 16, (1, 2, 3)
#: Characters that are hashed at a time: it bounds memory for very long texts.
SLICE = 1 << 18
#: Texts of a language that training expects to take, texts in all at most, and the longest among them.
TRAIN_PER_LANG, TRAIN_ROWS, TRAIN_CHARS = 400, 8000, 8000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _slices(text: str):
    """Buckets of the n-grams that begin in each slice, for each size."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    for a in range(0, len(chars), SLICE):
        part = chars[a : a + SLICE + SIZES[-1] - 1]
        out = []
        for n in SIZES:
            count = min(SLICE, len(part) - n + 1)
            h = np.full(max(0, count), n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + max(0, count)]) * _B
                h ^= h >> np.uint32(13)
            out.append((h * _A) >> np.uint32(32 - BITS))
        yield out


def _frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares; the shares of each n-gram size sum to one."""
    per_size = [np.concatenate(x) for x in zip(*_slices(text), strict=True)]
    flat = np.concatenate(per_size)
    share = np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in per_size])
    unique, where = np.unique(flat, return_inverse=True)
    return unique, np.bincount(where, weights=share)


@dataclass
class Model:
    """weight: per bucket and language, the learned weight times the bucket's inverse document frequency."""

    langs: list[str]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, number = np.zeros((len(SIZES), len(self.langs))), np.zeros(len(SIZES))
        for part in _slices(text):
            for k, buckets in enumerate(part):
                total[k] += self.weight[buckets].sum(0, dtype=np.float64)
                number[k] += len(buckets)
        return (total / np.maximum(number, 1)[:, None]).sum(0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and two passages of it, so that short texts are learned as well."""
    out = [text]
    for size in (30, 150):
        if len(text) > 2 * size:
            a = int(rng.integers(0, len(text) - size))
            out.append(text[a : a + size])
    return out


def train(texts: list[str], labels: list[str], seed: int = 3, epochs: int = 2, alpha: float = 4.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4) -> Model:
    """Learns from texts and their languages; one text in five is set aside for the temperature. No texts: all is unknown."""
    langs = sorted(set(labels))
    size, c = 1 << BITS, len(langs)
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [(*_frequencies(p), langs.index(label), i % 5 == 4) for i, (t, label) in enumerate(zip(texts, labels, strict=True)) for p in _pieces(t, rng)]
    seen = np.zeros(size)
    for buckets, _, _, _ in rows:
        seen[buckets] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    fit = [r for r in rows if not r[3]] or rows
    z, n = np.zeros((size + 1, c)), np.zeros((size + 1, c))

    def weights(at: np.ndarray) -> np.ndarray:
        """What the leader is: sparse where the sums of gradients stay below l1."""
        return np.where(np.abs(z[at]) <= l1, 0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            buckets, share, y, _ = fit[k]
            at, x = np.append(buckets, size), np.append(share * idf[buckets], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    model = Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1])
    held = [r for r in rows if r[3]] or rows
    scores = np.array([(share * idf[buckets]) @ w[buckets] + w[-1] for buckets, share, _, _ in held])
    y = np.array([r[2] for r in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.2, 10, 60), key=loss))
    return model


def fit(documents: DataFrame) -> Model:
    """Learns from the texts with a language whose crc32(doc_id) mod 4 isn't 2.

    Bounds: TRAIN_PER_LANG texts of a language are expected, chosen by a hash against the language's count; TRAIN_ROWS
    in all at most; texts of over TRAIN_CHARS characters aren't taken. Of rows with one doc_id the least (lang, text) counts.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2) & (F.length("text") <= TRAIN_CHARS))
    names = known.select("doc_id", "lang")  # texts stay where they are until the rows are chosen
    counts = names.groupBy("lang").agg(F.count("*").alias("texts"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20))
    drawn = names.join(counts, "lang").where(draw * F.col("texts") < F.lit(TRAIN_PER_LANG << 20)).select("doc_id")
    chosen = F.broadcast(bounded_sample(drawn, "doc_id", TRAIN_ROWS).distinct())  # at most TRAIN_ROWS numbers
    found = known.select("doc_id", "lang", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("least"))
    rows = sorted(found.select("doc_id", "least.*").collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predictor(model: Model):
    """Column function: text to struct<lang_pred, score>."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    return text_udf(lambda: lambda texts: [dict(zip(("lang_pred", "score"), model.predict(t), strict=True)) for t in texts], "struct<lang_pred: string, score: double>", kind)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; only doc_id and text are read, so other columns may have any name.

    Null texts and texts without a letter: und with score 0. Repeated rows are predicted alike, each in its own row;
    a null doc_id stays null and is not held out; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    said = docs.select("doc_id", predictor(model)(F.col("text")).alias("said"))
    return said.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "said.lang_pred", "said.score")


def keep_known(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with a probability of at least least."""
    tune(docs.sparkSession)
    said = predictor(model)(F.col("text"))
    return docs.where((said["lang_pred"] != UNKNOWN) & (said["score"] >= least))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    return predict(docs, fit(docs))
