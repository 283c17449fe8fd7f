"""Calibration of proposals against plain rules, replay of attempt chains, and values of a configuration."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from spanloom.functions import config
from spanloom.functions import text as T
from spanloom.operators import interaction
from spanloom.sources import model

CODES = ("TRF_ALIGNED", "BOUNDARY_TRANSFERABLE", "NEGATIVE_CONTRAST", "TASK_MISMATCH", "REDUNDANT", "SEMANTIC_ONLY")
FEATURES = ("alpha", "beta", "gamma")
SPANS = ("Alpha work", "beta", "delta")


def judged(rng):
    some = lambda values, least=0: rng.sample(values, rng.randrange(least, len(values) + 1))
    active = some(FEATURES)
    accepted = rng.random() < 0.5
    return {
        "status": "accepted" if accepted else "negative", "score": rng.randrange(1, 6), "role": rng.choice(["supporting" if accepted else "contrastive", "irrelevant"]),
        "previous": rng.randrange(1, 6), "previous_role": rng.choice(["supporting" if accepted else "contrastive", "irrelevant"]), "previous_codes": some(CODES), "similarity": rng.choice([0.5, 0.55, 0.57, 0.58, 0.9]),
        "relations": [(f, rng.choice(["supports", "contrasts", "unrelated"])) for f in some(active)], "codes": some(CODES, 1), "active": active, "spans": some(SPANS), "sentence": rng.choice(["delta is here", "nothing", "Beta, too"]),
    }


def accepted_by_rules(r):
    score, role, codes, did = r["score"], r["role"], list(r["codes"]), []
    spans = [s.lower() for s in r["spans"]]
    held = [f for f in r["active"] if any(f in s for s in spans)]
    claimed = [f for f, kind in r["relations"] if kind == "supports"]
    wrong, new = [f for f in claimed if f not in held], [f for f in held if f not in claimed]
    relations = [x for x in r["relations"] if x[0] not in wrong] + [(f, "supports") for f in new]
    did += ["unsupported_trf_support_removed"] * bool(wrong) + ["skill_span_trf_support_added"] * bool(new)
    if held:
        did += ["accepted_trf_support_floor_applied"] * (score < 4)
        score, role = max(4, score), "supporting"
    elif wrong:
        score, role = min(3, score), "irrelevant"
        did.append("unsupported_trf_promotion_rejected")
    words = r["sentence"].lower().replace(",", " ").split()
    if held or any(s in words for s in spans) or r["similarity"] >= 0.58:
        did += ["accepted_target_alignment_floor_applied"] * (score < 4)
        score, role = max(4, score), "supporting"
        codes += ["BOUNDARY_TRANSFERABLE"] * ("BOUNDARY_TRANSFERABLE" not in codes)
    elif r["previous"] == 4 and score > 3:
        score, role = 3, "irrelevant"
        codes = [c for c in codes if c not in CODES[:2]] or ["SEMANTIC_ONLY"]
        did.append("unsubstantiated_hard_gate_score_rejected")
    return score, role, codes, relations, did


def negative_by_rules(r):
    score, role, codes, did = r["score"], r["role"], list(r["codes"]), []
    free = "BOUNDARY_TRANSFERABLE" in codes or any(kind != "unrelated" for _, kind in r["relations"])
    if r["previous"] > 3 and not free:
        if r["previous_role"] == "contrastive" and "NEGATIVE_CONTRAST" in r["previous_codes"] and r["similarity"] >= 0.55:
            score, role = max(score, r["previous"]), "contrastive"
            codes += [c for c in ("NEGATIVE_CONTRAST", "BOUNDARY_TRANSFERABLE") if c not in codes]
            did.append("strong_negative_boundary_retained")
        else:
            score, role = min(3, score), "irrelevant"
            codes = [c for c in codes if c != "NEGATIVE_CONTRAST"] or ["SEMANTIC_ONLY"]
            did.append("generic_high_negative_penalized")
    if r["previous"] < 4 and r["previous_role"] == "contrastive" and not {"TASK_MISMATCH", "REDUNDANT"} & set(codes):
        codes += ["NEGATIVE_CONTRAST"] * ("NEGATIVE_CONTRAST" not in codes)
        did.append("low_negative_contrast_preserved")
    return score, "contrastive" if "NEGATIVE_CONTRAST" in codes else role, codes, list(r["relations"]), did


def by_rules(r):
    good = r["status"] == "accepted"
    score, role, codes, relations, did = (accepted_by_rules if good else negative_by_rules)(r)
    if "TRF_ALIGNED" in codes and not relations:
        codes = [c for c in codes if c != "TRF_ALIGNED"] or ["TYPE_ALIGNED" if good else "SEMANTIC_ONLY"]
        did.append("unsubstantiated_trf_aligned_removed")
    change = score - r["previous"]
    return score, role, codes, relations, did, change, "boost" if change > 0 else "penalize" if change < 0 else "none"


def test_judgments(spark):
    rng = random.Random(8)
    rows = [judged(rng) for _ in range(1500)]
    schema = "status string, score int, role string, previous int, previous_role string, previous_codes array<string>, similarity double, relations array<struct<text:string,relation:string>>, codes array<string>, active array<string>, spans array<string>, sentence string, id int"
    df = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], schema)
    got = {r["id"]: r for r in interaction.calibrated_judgments(df).collect()}
    seen = set()
    for i, r in enumerate(rows):
        score, role, codes, relations, did, change, effect = by_rules(r)
        g = got[i]
        assert (g["score"], g["role"], g["codes"], [tuple(x) for x in g["relations"]], g["actions"], g["adjustment"], g["effect"]) == (score, role, codes, relations, did, change, effect), r
        seen |= set(did)
    assert len(seen) == 10
    assert interaction.calibrated_judgments(df.where("false")).count() == 0


def test_decisions(spark):
    cues, positive = ["skills", "ability"], ["TARGET_EXPLICIT_SUPPORT", "EXEMPLAR_SUPPORT"]
    rows = [
        ("Skills", "We want skills", True, "drop", ["TOO_GENERIC"], ["EXEMPLARS"]), ("skills", "We want skills", False, "keep", ["TOO_GENERIC"], ["EXEMPLARS"]), ("ability", "no such word", True, "keep", ["EXEMPLAR_SUPPORT"], ["EXEMPLARS"]),
        ("quickly", "act quickly", True, "keep", ["EXEMPLAR_SUPPORT"], ["EXEMPLARS"]), ("quickly", "slow", True, "keep", ["EXEMPLAR_SUPPORT"], ["EXEMPLARS"]), ("Java", "Java", True, "drop", ["TYPE_MISMATCH"], ["TARGET_TEXT"]),
    ]
    df = spark.createDataFrame(rows, "f string, t string, h boolean, d string, c array<string>, s array<string>")
    got = df.select(interaction.calibrated_decision(*map(F.col, "fthdcs"), cues, positive).alias("x")).select("x.*").collect()
    assert [(r["decision"], r["gate"], r["codes"], r["sources"], r["ok"]) for r in got] == [
        ("keep", "forced_keep_explicit_skill_type_cue", ["TOO_GENERIC", "TARGET_EXPLICIT_SUPPORT"], ["EXEMPLARS", "TARGET_TEXT"], True),
        ("keep", "none", ["TOO_GENERIC"], ["EXEMPLARS"], False),
        ("drop", "forced_drop_missing_skill_type_cue", ["MISSING_SKILL_CUE"], ["EXEMPLARS"], True),
        ("drop", "forced_drop_descriptive_modifier", ["TYPE_MISMATCH"], ["EXEMPLARS"], True),
        ("keep", "none", ["EXEMPLAR_SUPPORT"], ["EXEMPLARS"], True),
        ("drop", "none", ["TYPE_MISMATCH"], ["TARGET_TEXT"], True),
    ]


def test_attempt_chains(spark):
    parse = lambda c: None if c.startswith("{") else "no object"
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, prompt string")
    schema = {"type": "object"}
    raw = model.converse(prompts, lambda: model.FakeClient(fail_first=1), parse, schema=schema)
    assert model.replay_errors(raw, prompts, parse, schema=schema).count() == 0
    assert {r["reason"] for r in model.replay_errors(raw, prompts, parse).collect()} == {"request"}  # the schema is part of the request
    good = raw.first().asDict()
    check = lambda **changed: model.chain_error("p0", good | changed, parse, schema=schema)
    assert check() is None
    assert check(status="failed") == check(content="{}") == check(error="x") == "final state"
    assert check(errors=["other", None]) == "parse"
    assert check(answers=good["answers"][:1], errors=good["errors"][:1]) == "final state"
    assert check(n_attempts=3) == check(request_sha256=[]) == check(request_sha256=good["request_sha256"] * 3, n_attempts=6) == "attempts"
    assert check(request_sha256=[good["request_sha256"][0]] * 2) == "request"
    assert check(answers=["no", "{"], errors=["no object", None]) == "request"  # the second request holds the first answer

    class Down(model.FakeClient):
        def chat(self, messages):
            raise ValueError("down")

    for client in (Down, lambda: model.FakeClient(fail_first=9)):
        failed = model.converse(prompts, client, parse)
        assert {r["status"] for r in failed.collect()} == {"failed"}
        assert model.replay_errors(failed, prompts, parse).count() == 0
        assert {r["reason"] for r in model.replay_errors(failed, prompts, parse, allow_failed=False).collect()} == {"failed"}
    short = failed.select(*(F.slice(c, 1, 2).alias(c) if c in ("answers", "errors", "request_sha256") else F.lit(2).alias(c) if c == "n_attempts" else c for c in failed.columns))
    assert {r["reason"] for r in model.replay_errors(short, prompts, parse).collect()} == {"final state"}  # it gave up too early
    other = spark.createDataFrame([(7, "x"), (0, "p0")], "id long, prompt string")
    assert sorted(map(tuple, model.replay_errors(raw, other, parse, schema=schema).collect())) == [(1, "no prompt"), (2, "no prompt"), (7, "no answer")]


def test_edit_histogram():
    assert T.edit_histogram("abc", "axc") == {"insert": 0, "delete": 0, "replace": 1}
    assert T.edit_histogram("abcdef", "bcXdef!") == {"insert": 2, "delete": 1, "replace": 0}
    assert T.edit_histogram(None, None) == {"insert": 0, "delete": 0, "replace": 0}


def test_configuration():
    names = {"X": "1", "Y": "2", "EMPTY": ""}
    assert config.resolve({"a": ["${X}", "x ${X}", 1, {"deep": "${Y}"}], "b": "${Y}", "c": "${1}"}, names) == {"a": ["1", "x ${X}", 1, {"deep": "2"}], "b": "2", "c": "${1}"}
    broken = {"a": "${X}", "b": ["${EMPTY}", {"c": "${NONE}"}]}
    with pytest.raises(config.Missing) as error:
        config.resolve(broken, names)
    assert error.value.places == [("$.b[0]", "EMPTY"), ("$.b[1].c", "NONE")] and broken["a"] == "${X}"
    clock = config.Clock(lambda: datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=timezone.utc))
    assert clock.stamp() == "2024-01-02T03:04:05+00:00" and clock.run_id("r-%Y%m%d-%H%M%S") == "r-20240102-030405"
    assert config.mode("EvidenceOnly") == config.mode("evidence_only") == "evidence_only"
    with pytest.raises(ValueError, match="unknown mode"):
        config.mode("other")
