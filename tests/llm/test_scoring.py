"""Scores of the three classifiers against plain loops over n-grams, windows and chunks, for odd texts and random models."""

import math

import numpy as np
import pytest

from spanloom.llm import langid, quality, toxicity

ODD = [
    None, "", " ", "a", "a a a b", "  lead and trail \n", "The THE the cat", "x" * 700, "ab " * 400, "日本語 テキスト é", "word\x00word", "İstanbul ΣΑΣ", "👍🏽 ok", "end", "퟿",
    " ".join(f"w{k}" for k in range(300)), "one two　three", "A" * 255 + " " + "b" * 257,
]
M = (1 << 32) - 1


def plain_toxicity(model, text):
    words, kept = (text or "").lower().split(), []
    for w in words:
        if not kept or kept[-1] != w:
            kept.append(w)
    # an adjacent repetition is dropped however often it comes
    chars = [ord(c) for c in f" {' '.join(kept)} "]
    blocks = -(-len(chars) // toxicity.BLOCK)
    sums, counts = [0.0] * blocks, [0] * blocks
    for i in range(len(chars)):
        h = chars[i] * int(toxicity._STEP) & M
        for n in range(2, toxicity.SIZES[-1] + 1):
            c = chars[i + n - 1] if i + n - 1 < len(chars) else 0
            h = (h ^ c) * int(toxicity._MIX) & M
            h ^= h >> 15
            if n in toxicity.SIZES and c and 32 not in chars[i + 1 : i + n - 1] and i + n <= len(chars):
                sums[i // toxicity.BLOCK] += float(model.weight[(h * int(toxicity._STEP) & M) >> (32 - toxicity.BITS)])
                counts[i // toxicity.BLOCK] += 1
    windows = [(sums[k] + sums[k + 1], counts[k] + counts[k + 1]) for k in range(blocks - 1)] or [(sums[0], counts[0])]
    z = model.scale * max(s / max(n, toxicity.LEAST) + model.bias for s, n in windows) + model.shift
    return 1 / (1 + math.exp(-z))


def test_toxicity_is_a_mean_over_windows():
    model = toxicity.Model(np.random.default_rng(5).normal(size=1 << toxicity.BITS).astype(np.float32), bias=0.2, scale=1.3, shift=-0.4)
    for text in ODD:
        assert model.score(text) == pytest.approx(plain_toxicity(model, text), abs=1e-5), text


def plain_quality(model, text):
    raw = (text or "").encode()
    halves = max(2, -(-len(raw) // quality.HALF))
    data = raw + bytes(halves * quality.HALF + quality.WIDTH - 1 - len(raw))
    worst = -math.inf
    for chunk in range(halves - 1):
        top = [-math.inf] * quality.FILTERS
        for p in range(chunk * quality.HALF, (chunk + 2) * quality.HALF):
            seen = [float(x) for b in data[p : p + quality.WIDTH] for x in model.vectors[b]]
            for f in range(quality.FILTERS):
                top[f] = max(top[f], sum(a * float(b) for a, b in zip(seen, model.filters[:, f], strict=True)))
        on = [max(0.0, t + float(o)) for t, o in zip(top, model.offset, strict=True)]
        hidden = [max(0.0, sum(a * float(w) for a, w in zip(on, model.dense[:, h], strict=True)) + float(model.dense_offset[h])) for h in range(quality.HIDDEN)]
        worst = max(worst, sum(a * float(w) for a, w in zip(hidden, model.out, strict=True)) + float(model.out_offset[0]))
    return 1 / (1 + math.exp(model.scale * worst + model.shift))


def test_quality_is_the_worst_chunk(monkeypatch):
    """With fewer filters and shorter chunks, so that loops over all bytes end."""
    for name, value in (("FILTERS", 5), ("HALF", 16), ("HIDDEN", 3)):
        monkeypatch.setattr(quality, name, value)
    monkeypatch.setattr(quality, "SLICE", 4 * 16)
    rng = np.random.default_rng(6)
    model = quality._fresh(rng)
    model.offset, model.dense_offset, model.out_offset = (rng.normal(size=n).astype(np.float32) for n in (5, 3, 1))
    model.scale, model.shift = 0.7, 0.1
    for text in ODD:
        assert model.score(text) == pytest.approx(plain_quality(model, text), abs=1e-5), text


def plain_language(model, text):
    if text is None or not any(c.isalpha() for c in text):
        return langid.UNKNOWN, 0.0
    chars = [ord(c) for c in f" {text.lower()} "]
    z = [float(b) for b in model.bias]
    for n in langid.SIZES:
        buckets = []
        for i in range(len(chars) - n + 1):
            h = n
            for c in chars[i : i + n]:
                h = (h ^ c) * int(langid._B) & M
                h ^= h >> 13
            buckets.append((h * int(langid._A) & M) >> (32 - langid.BITS))
        for k in range(len(z)):
            z[k] += sum(float(model.weight[b][k]) for b in buckets) / max(1, len(buckets))
    z = [x / model.temperature for x in z]
    p = [math.exp(x - max(z)) for x in z]
    return model.langs[p.index(max(p))], max(p) / sum(p)


def test_language_is_a_sum_of_means():
    rng = np.random.default_rng(7)
    model = langid.Model(["aa", "bb", "cc"], rng.normal(size=(1 << langid.BITS, 3)), rng.normal(size=3), temperature=0.8)
    for text in ODD:
        lang, score = model.predict(text)
        want, p = plain_language(model, text)
        assert lang == want and score == pytest.approx(p, abs=1e-6), text
