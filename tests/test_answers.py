"""Answers with one fault each: the fault is named with its place, and nothing else is."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import answers, interaction

CITE = {"confidence": 4, "evidence_sources": ["TARGET_TEXT"], "evidence_demo_ids": [], "reason_codes": ["TARGET_EXPLICIT_SUPPORT"], "reason": "it says so"}
PROPOSAL = {
    "schema_version": "trf-interaction-proposal-v1", "revised_entity_types": ["Skill"], "overall_reason": "fine", "unresolved_issues": [],
    "known_trf_decisions": [{"normalized_text": "Python", "action": "keep", **CITE}, {"normalized_text": "teamwork", "action": "drop", **CITE | {"reason_codes": ["TOO_GENERIC"]}}],
    "added_trfs": [{"text": "cloud", "semantic_class": "domain_feature", **CITE}],
}
JUDGED = {"helpfulness_score": 4, "role": "supporting", "trf_relations": [{"normalized_text": "python", "relation": "supports"}], "reason_codes": ["TYPE_ALIGNED"], "reason": "near"}
REVIEW = {"revised_judgments": [{"demo_idx": 7, **JUDGED}, {"demo_idx": 3, **JUDGED | {"role": "contrastive", "trf_relations": []}}], "overall_reason": "fine", "unresolved_issues": ["CONFLICTING_TRF_EVIDENCE"]}


def put(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(out)


D, A, J = "known_trf_decisions", "added_trfs", "revised_judgments"
PROPOSALS = [
    (json.dumps(PROPOSAL), set()),
    (put(PROPOSAL, ["schema_version"], "v0"), {("$.schema_version", "value")}),
    (put(PROPOSAL, [D, 0, "evidence_sources"], ["EXEMPLARS"]), {(f"$.{D}[0]", "source_without_ids"), (f"$.{D}[0]", "code_without_text")}),
    (put(PROPOSAL, [D, 0, "reason_codes"], ["TARGET_EXPLICIT_SUPPORT", "EXEMPLAR_CONTRADICTION"]), {(f"$.{D}[0]", "code_without_exemplars")}),
    (put(PROPOSAL, [D, 0, "reason_codes"], ["BOUNDARY_EVIDENCE"]), {(f"$.{D}[0]", "kept_without_support")}),
    (put(PROPOSAL, [A, 0, "reason_codes"], ["BOUNDARY_EVIDENCE"]), {(f"$.{A}[0]", "added_without_support")}),
    (put(PROPOSAL, [A, 0, "text"], "y" * 161), {(f"$.{A}[0]", "not_a_feature")}),
    (put(PROPOSAL, [A, 0, "text"], " Knows PYTHON and its abilities "), {(f"$.{A}[0]", "not_a_feature")}),
    (put(PROPOSAL, [A, 0, "text"], "PYTHON"), {(f"$.{A}[0]", "repeated_feature")}),
    (put(PROPOSAL, [A], [PROPOSAL[A][0], PROPOSAL[A][0] | {"text": "Cloud"}]), {(f"$.{A}[1]", "repeated_feature")}),
    (put(PROPOSAL, [A, 0, "semantic_class"], "skill_type_cue"), {(f"$.{A}[0]", "cue_not_in_text")}),
    (put(PROPOSAL, ["revised_entity_types"], []), {(f"$.{D}", "active_without_type"), ("$.added_trfs", "added_without_type")}),
    (put(PROPOSAL, [D], PROPOSAL[D][::-1]), {(f"$.{D}", "order")}),
    (put(PROPOSAL, [D], PROPOSAL[D][:1]), {(f"$.{D}", "size")}),
    (put(PROPOSAL, [D, 0, "evidence_demo_ids"], [3, 99]), {(f"$.{D}[0]", "unknown_demo"), (f"$.{D}[0]", "ids_without_source")}),
    (put(PROPOSAL, [D, 0, "confidence"], 2.0), {(f"$.{D}[0].confidence", "type")}),
    (put(PROPOSAL, [D, 1], 5), {(f"$.{D}[1]", "type")}),
    (put(PROPOSAL, [A], None), {("$.added_trfs", "type")}),
    ("", {("$", "json")}), (None, {("$", "json")}), ("[]", {("$", "type")}), ("{", {("$", "json")}),
]
REVIEWS = [
    (json.dumps(REVIEW), set()),
    (put(REVIEW, [J, 0, "demo_idx"], 8), {(f"$.{J}[0]", "unknown_demo"), (f"$.{J}", "order")}),
    (put(REVIEW, [J, 1, "demo_idx"], 7), {(f"$.{J}[1]", "repeated_demo"), (f"$.{J}[1]", "role_of_status"), (f"$.{J}", "order")}),
    (put(REVIEW, [J], REVIEW[J][::-1]), {(f"$.{J}", "order")}),
    (put(REVIEW, [J, 0, "role"], "contrastive"), {(f"$.{J}[0]", "role_of_status")}),
    (put(REVIEW, [J, 1, "role"], "supporting"), {(f"$.{J}[1]", "role_of_status")}),
    (put(REVIEW, [J, 0, "helpfulness_score"], 0), {(f"$.{J}[0].helpfulness_score", "range")}),
    (put(REVIEW, [J, 0, "trf_relations", 0, "normalized_text"], "java"), {(f"$.{J}[0]", "unknown_feature")}),
    (put(REVIEW, [J, 0, "trf_relations"], JUDGED["trf_relations"] * 2), {(f"$.{J}[0]", "repeated_relation")}),
    (put(REVIEW, [J, 0, "trf_relations", 0], {"relation": "supports"}), {(f"$.{J}[0].trf_relations[0].normalized_text", "missing")}),
    (put(REVIEW, ["unresolved_issues"], ["?"]), {("$.unresolved_issues[0]", "value")}),
]


def errors_of(spark, cases, column):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, content string")
    found = df.select("k", column.alias("errors"))
    got = {k: set() for k in range(len(cases))}
    for r in answers.violations(found, "k").collect():
        got[r["k"]].add((r["at"], r["rule"]))
    return got


def test_proposals_on_features(spark):
    demos = F.array(*(F.lit(x).cast("long") for x in (7, 3)))
    column = answers.feature_errors(F.col("content"), F.lit("Knows Python and its abilities"), demos, F.array(F.lit("python"), F.lit("teamwork")), {}, proposal=True)
    got = errors_of(spark, PROPOSALS, column)
    for k, (content, want) in enumerate(PROPOSALS):
        assert got[k] == want, content


def test_reviews_of_candidates(spark):
    candidates = F.array(*(F.struct(F.lit(d).alias("demo"), F.lit(s).alias("status")) for d, s in ((7, "accepted"), (3, "negative"))))
    got = errors_of(spark, REVIEWS, answers.judgment_errors(F.col("content"), candidates, F.array(F.lit("Python"))))
    for k, (content, want) in enumerate(REVIEWS):
        assert got[k] == want, content


def test_types_alone(spark):
    cases = [('{"entity_types": []}', set()), ('{"entity_types": ["Skill"]}', set()), ('{"entity_types": ["Skill", "Skill"]}', {("$.entity_types", "size")}), ('{"entity_types": ["skill"]}', {("$.entity_types[0]", "value")}), ('{"entity_types": null}', {("$.entity_types", "type")}), ("{}", {("$.entity_types", "missing")})]
    got = errors_of(spark, cases, answers.type_errors(F.col("content")))
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_decisions_are_read(spark):
    df = spark.createDataFrame([(json.dumps(PROPOSAL), json.dumps(REVIEW))], "p string, r string")
    r = df.select(answers.feature_decisions(F.col("p"), D).alias("f"), answers.judgment_decisions(F.col("r")).alias("j")).first()
    assert r["f"].asDict(True) == {"has_type": True, "decided": [{"text": "Python", "action": "keep", "demos": []}, {"text": "teamwork", "action": "drop", "demos": []}], "added": [{"text": "cloud", "class": "domain_feature", "demos": []}]}
    assert [x.asDict() for x in r["j"]] == [{"demo": 7, "score": 4, "role": "supporting", "supports": ["python"]}, {"demo": 3, "score": 4, "role": "contrastive", "supports": []}]


def test_the_schema_for_a_client():
    schema = answers.json_schema(answers.judgment_answer(2))
    one = schema["properties"]["revised_judgments"]
    assert schema["additionalProperties"] is False and one["minItems"] == one["maxItems"] == 2
    assert one["items"]["properties"]["helpfulness_score"] == {"type": "integer", "minimum": 1, "maximum": 5}
    assert one["items"]["properties"]["reason"] == {"type": "string", "minLength": 1, "maxLength": 240} and one["items"]["properties"]["role"]["enum"] == list(answers.ROLES)


@pytest.mark.parametrize("text,phrase,found", [("große Straße", "STRASSE", True), ("Die STRASSE hier", "straße", True), ("x", "", None), ("x", "  ", None), ("a  c++\nb", "C++ B", True), ("ac++", "c++", False)])
def test_phrases_fold_case_and_empty_ones_have_no_answer(spark, text, phrase, found):
    assert spark.range(1).select(interaction.contains_phrase(F.lit(text), F.lit(phrase))).first()[0] is found
