"""Many phrases at once against plain loops; redaction within JSON; projection over an aligned copy."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import phrases
from spanloom.functions import text as T


def plain_matches(texts, text, fold, words):
    """The longest phrase at each place from left to right, by trying all of them."""
    out, at = [], 0
    edge = lambda k: not (0 <= k < len(text) and (text[k].isalnum() or text[k] == "_"))
    while at < len(text):
        ends = [b for b in range(at + 1, len(text) + 1) if (text[at:b].casefold() if fold else text[at:b]) in texts and (not words or edge(at - 1) and edge(b))]
        if ends:
            out.append((at, max(ends)))
            at = max(ends)
        else:
            at += 1
    return out


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("words", [False, True])
def test_matches_equal_a_loop(fold, words):
    rng = random.Random(fold * 2 + words)
    letters = "aAbß sSé_"
    for _ in range(400):
        known = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 8))]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        keys = {p.casefold() if fold else p for p in known} - {""}
        found = phrases.Phrases(known, fold, words).found(text)
        assert [(a, b) for a, b, _ in found] == plain_matches(keys, text, fold, words)
        assert all((p.casefold() == text[a:b].casefold()) if fold else p == text[a:b] for a, b, p in found)


def test_a_hundred_thousand_phrases_in_one_pass(spark):
    sent = phrases.Sent(spark.range(100_000).select(F.format_string("w%06d", "id").alias("w")), "w")
    rng = random.Random(1)
    texts = [(k, " ".join(f"w{rng.randrange(120_000):06d}x" for _ in range(40))) for k in range(50)] + [(98, None), (99, "")]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(texts, "k int, x string").select("k", phrases.matches(F.col("x"), sent).alias("m")).collect()}
    for k, text in texts:
        want = [(m * 9, m * 9 + 7) for m, w in enumerate((text or "").split()) if int(w[1:7]) < 100_000]
        assert [(r["start"], r["end"]) for r in got[k]] == want


def test_too_many_phrases_are_refused(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RESIDENT", 9)
    with pytest.raises(ValueError, match="more than a task may hold"):
        phrases.Sent(spark.createDataFrame([("0123456789",)], "w string"), "w")
    assert phrases.Sent(spark.createDataFrame([], "w string"), "w").get().found("x") == []


def test_secrets_within_json(spark):
    """A secret inside another goes with it, whatever the order; keys stay."""
    sent = phrases.Sent(spark.createDataFrame([("key",), ("key-123",), ("123",), ("",), (None,)], "w string"), "w")
    value = {"key": ["a key-123 b", {"x": "key", "n": 123, "none": None}], "t": "é123"}
    rows = spark.createDataFrame([(json.dumps(value),), ("no json key-1234",), (None,)], "x string")
    got = [r[0] for r in rows.select(phrases.redacted_json(F.col("x"), sent)).collect()]
    assert json.loads(got[0]) == {"key": ["a <redacted> b", {"x": "<redacted>", "n": 123, "none": None}], "t": "é<redacted>"}
    assert got[1:] == ["no json <redacted>4", None]
    assert [r[0] for r in rows.select(phrases.redacted(F.col("x"), sent)).collect()][1:] == ["no json <redacted>4", None]


@pytest.mark.parametrize("content,error", [("{", "json"), ('{"trfs": 1}', "type"), ('{"trfs": [1]}', "type"), ('{"trfs": ["  "]}', "blank"), ('{"trfs": [], "x": 1}', "keys"), ("[]", "keys"), (None, "json")])
def test_bad_lists_of_features(content, error):
    assert phrases.listed_features(content, "x", frozenset(), frozenset()) == (None, error)


def test_flags_of_features():
    found, error = phrases.listed_features('{"trfs": ["ﬁne", " fine", "STRASSE", "Straße"]}', "die Straße", frozenset({"fine", "straße"}), frozenset({"fine", "strasse"}))
    assert error is None and [(f["raw"], f["text"], f["place"]) for f in found] == [("ﬁne", "fine", 1), ("STRASSE", "STRASSE", 2), ("Straße", "Straße", 3)]
    assert [tuple(f[k] for k in ("in_bank", "in_bank_folded", "in_text", "in_text_folded")) for f in found] == [(True, True, False, False), (False, True, False, True), (False, True, True, True)]


@pytest.mark.parametrize("sentence,copy,reason", [
    ("a\u0092b \u0085", "a’b …", None), ("a\u0092b", "a\u0092b", "unchanged"), ("", None, "unchanged"), ("ab", "abc", "length_changed"), ("a’b", "a\u0092b", "character_changed"), ("a\u0092b", "a‘b", "character_changed"),
    ("a\u0092b\u0085", "a’b\u0085", None), ("A\u0092b", "a’b", "character_changed"),
])
def test_projection(spark, sentence, copy, reason):
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")))
    r = spark.createDataFrame([(sentence, copy)], "s string, c string").select(T.projection(F.col("s"), F.col("c"), span).alias("p")).first()["p"]
    assert r["reason"] == reason
    if reason is None:
        assert [tuple(x) for x in r["spans"]] == [(sentence[:2], 0, 2)]
        assert [tuple(x) for x in r["substitutions"]] == [(k, a, b) for k, (a, b) in enumerate(zip(sentence, copy, strict=True)) if a != b]
