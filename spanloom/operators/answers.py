"""Answers of a model, held against a schema and the rules between its fields, as columns.

A schema is a tree of specifications. It is compiled once to an expression over VARIANT: types are told strictly (true is
no number, "1" neither), and every violation is an element (at, rule) of an array, so a bad answer is a row and never an
exception. The same tree gives the JSON Schema that a client may enforce. No shuffle and no Python is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rows import exploded

from .checks import one_value
from .interaction import calibrated_decision, contains_phrase, folded

# Fixed values of the contract.
EVIDENCE_SOURCES = ("TARGET_TEXT", "EXEMPLARS")
FEATURE_CODES = ("TARGET_EXPLICIT_SUPPORT", "TARGET_IMPLICIT_SUPPORT", "EXEMPLAR_SUPPORT", "EXEMPLAR_CONTRADICTION", "TOO_GENERIC", "TYPE_MISMATCH", "MISSING_SKILL_CUE", "BOUNDARY_EVIDENCE", "OPEN_VOCABULARY_INFERENCE")
POSITIVE_CODES = ("TARGET_EXPLICIT_SUPPORT", "TARGET_IMPLICIT_SUPPORT", "EXEMPLAR_SUPPORT", "OPEN_VOCABULARY_INFERENCE")
JUDGMENT_CODES = ("TYPE_ALIGNED", "TRF_ALIGNED", "BOUNDARY_TRANSFERABLE", "NEGATIVE_CONTRAST", "SEMANTIC_ONLY", "LABEL_UNCERTAIN", "TASK_MISMATCH", "REDUNDANT")
FEATURE_ISSUES = ("TYPE_TRF_CONFLICT", "INSUFFICIENT_EVIDENCE", "CONFLICTING_EXEMPLARS", "POTENTIAL_SKILL_SPAN")
JUDGMENT_ISSUES = ("INSUFFICIENT_TRF_EVIDENCE", "CONFLICTING_TRF_EVIDENCE")
ADDITION_CLASSES = ("domain_feature", "skill_type_cue")
RELATIONS = ("supports", "contrasts", "unrelated")
ROLES = ("supporting", "contrastive", "irrelevant")
TYPE_CUES = ("skill", "skills", "ability", "abilities", "proficiency", "competence", "experience")


# --- schemas


@dataclass(frozen=True)
class Text:
    """A string that isn't blank, of at most so many characters, or one of a few."""

    most: int | None = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    """A whole number; true and 1.0 aren't."""

    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Items:
    """An array; most may be a column, for schemas whose sizes come from the row."""

    of: object
    least: int | Column = 0
    most: int | Column | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Fields:
    """An object with just these keys."""

    of: Mapping[str, object] = field(default_factory=dict)


def _problem(bad: Column, at: Column, rule: str) -> Column:
    none = F.array().cast("array<struct<at:string,rule:string>>")
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("at"), F.lit(rule).alias("rule")))).otherwise(none)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use has it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def part(v: Column, path: str, kind: str = "variant") -> Column:
    """What lies at a path of a VARIANT; null if nothing does or it has another type."""
    return F.try_variant_get(v, path, kind)


def problems(spec: object, v: Column, at: Column) -> Column:
    """The array of (at, rule) by which a VARIANT departs from a specification: type, blank, length, value, range, size, repeated, missing, unknown."""
    return let(F.coalesce(F.schema_of_variant(v), F.lit("MISSING")), lambda kind: _problems(spec, v, at, kind))


def _problems(spec: object, v: Column, at: Column, kind: Column) -> Column:
    mistyped = _problem(F.lit(True), at, "type")
    if isinstance(spec, Text):
        value = part(v, "$", "string")
        if spec.among:
            return F.when(kind == "STRING", _problem(~value.isin(*spec.among), at, "value")).otherwise(mistyped)
        long = F.lit(False) if spec.most is None else F.length(value) > spec.most
        return F.when(kind != "STRING", mistyped).when(F.trim(value) == "", _problem(F.lit(True), at, "blank")).otherwise(_problem(long, at, "length"))
    if isinstance(spec, Whole):
        value = part(v, "$", "bigint")
        low, high = (F.lit(False) if x is None else bad for x, bad in ((spec.low, value < (spec.low or 0)), (spec.high, value > (spec.high or 0))))
        return F.when(kind == "BIGINT", _problem(low | high, at, "range")).otherwise(mistyped)
    if isinstance(spec, Items):

        def held(items: Column) -> Column:
            inner = F.flatten(F.transform(items, lambda x, i: problems(spec.of, x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            long = F.lit(False) if spec.most is None else F.size(items) > spec.most
            parts = [_problem((F.size(items) < spec.least) | long, at, "size"), inner]
            if spec.distinct:
                parts.append(_problem(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), at, "repeated"))
            return F.concat(*parts)

        return F.when(kind.startswith("ARRAY"), let(part(v, "$", "array<variant>"), held)).otherwise(mistyped)
    want = F.array(*map(F.lit, spec.of))

    def own(fields: Column) -> Column:
        keys = F.map_keys(fields)
        missing = F.transform(F.array_except(want, keys), lambda k: F.struct(F.concat(at, F.lit("."), k).alias("at"), F.lit("missing").alias("rule")))
        unknown = F.transform(F.array_except(keys, want), lambda k: F.struct(F.concat(at, F.lit("."), k).alias("at"), F.lit("unknown").alias("rule")))
        inner = [F.when(F.map_contains_key(fields, k), let(F.element_at(fields, k), _below(s, F.concat(at, F.lit(f".{k}"))))).otherwise(_problem(F.lit(False), at, "")) for k, s in spec.of.items()]
        return F.concat(missing, unknown, *inner)

    return F.when(kind.startswith("OBJECT"), let(part(v, "$", "map<string,variant>"), own)).otherwise(mistyped)


def _below(spec: object, at: Column) -> Callable[[Column], Column]:
    return lambda x: problems(spec, x, at)


def json_schema(spec: object) -> dict:
    """The specification as a JSON Schema; sizes that are columns are the row's own and left out."""
    if isinstance(spec, Text):
        return {"type": "string", "enum": list(spec.among)} if spec.among else {"type": "string", "minLength": 1} | ({} if spec.most is None else {"maxLength": spec.most})
    if isinstance(spec, Whole):
        return {"type": "integer"} | ({} if spec.low is None else {"minimum": spec.low}) | ({} if spec.high is None else {"maximum": spec.high})
    if isinstance(spec, Items):
        sizes = {k: n for k, n in (("minItems", spec.least), ("maxItems", spec.most)) if isinstance(n, int) and n}
        return {"type": "array", "items": json_schema(spec.of)} | sizes | ({"uniqueItems": True} if spec.distinct else {})
    return {"type": "object", "additionalProperties": False, "required": sorted(spec.of), "properties": {k: json_schema(s) for k, s in spec.of.items()}}


def checked(content: Column, spec: object, rules: Callable[[Column], list[tuple[Column, str]]]) -> Column:
    """Problems of a text: that it is no single JSON value, or of its schema, or, where that holds, of the rules: (where, name) pairs, where an array of places."""

    def held(v: Column) -> Column:
        # rules are only asked of what has its form
        ruled = lambda shape: F.when(F.size(shape) > 0, shape).otherwise(F.concat(_problem(F.lit(False), F.lit("$"), ""), *(_named(where, rule) for where, rule in rules(v))))
        return let(problems(spec, v, F.lit("$")), ruled)

    return F.when(~F.coalesce(one_value(content), F.lit(False)), _problem(F.lit(True), F.lit("$"), "json")).otherwise(let(F.try_parse_json(content), held))


def _named(where: Column, rule: str) -> Column:
    return F.transform(where, lambda at: F.struct(at.alias("at"), F.lit(rule).alias("rule")))


def violations(rows: DataFrame, *keys: str, errors: str = "errors") -> DataFrame:
    """keys, at, rule: a row for each problem."""
    return exploded(rows, F.col(errors), "__e", *keys).select(*keys, "__e.at", "__e.rule")


def _places(items: Column, path: str, bad: Callable[[Column, Column], Column]) -> Column:
    """Where bad holds among the items of an array."""
    each = F.transform(items, lambda x, i: F.when(F.coalesce(bad(x, i), F.lit(False)), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))))
    return F.array_compact(each)


def _once(bad: Column, at: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(at))).otherwise(F.array().cast("array<string>"))


def key(text: Column) -> Column:
    """By which features are the same: without blanks around it, folded."""
    return folded(F.trim(text))


def type_errors(content: Column) -> Column:
    """Problems of an answer that names the types alone: none, or just the one there is."""
    return checked(content, Fields({"entity_types": Items(Text(among=("Skill",)), most=1)}), lambda v: [])


# --- features


def _evidence(most: int) -> dict:
    codes = Items(Text(among=FEATURE_CODES), least=1, distinct=True)
    return {"confidence": Whole(1, 5), "evidence_sources": Items(Text(among=EVIDENCE_SOURCES), least=1, distinct=True), "evidence_demo_ids": Items(Whole(), distinct=True), "reason_codes": codes, "reason": Text(most)}


def feature_answer(n_known: Column, decisions: str = "original_trf_decisions", version: str | None = None, most: int = 240) -> Fields:
    """The schema of an answer on features: a decision for each known one, additions, and the type."""
    head = {"schema_version": Text(among=(version,))} if version else {}
    decided = Fields({"normalized_text": Text(), "action": Text(among=("keep", "drop")), **_evidence(most)})
    added = Fields({"text": Text(), "semantic_class": Text(among=ADDITION_CLASSES), **_evidence(most)})
    rest = {"overall_reason": Text(most), "unresolved_issues": Items(Text(among=FEATURE_ISSUES), distinct=True)}
    return Fields({**head, "revised_entity_types": Items(Text(among=("Skill",)), most=1), decisions: Items(decided, n_known, n_known), "added_trfs": Items(added), **rest})


def _cites(x: Column) -> tuple[Column, Column, Column]:
    return part(x, "$.evidence_demo_ids", "array<bigint>"), part(x, "$.evidence_sources", "array<string>"), part(x, "$.reason_codes", "array<string>")


def _cited(k: int) -> Callable[[Column], Column]:
    return lambda x: _cites(x)[k]


def feature_errors(
    content: Column, sentence: Column, demos: Column, known: Column, labelled: Mapping[str, tuple[bool, str]], cues: tuple[str, ...] = TYPE_CUES, proposal: bool = False, most: int = 240
) -> Column:
    """Problems of an answer on features: (at, rule), none if it may be applied.

    demos: ids of the candidates; known: the features in order; labelled: by key, whether people count it as a feature,
    and its class. A review may not keep what they exclude. A proposal has a version, ties codes to their sources, and
    keeps nothing without positive support, after the gates of calibrated_decision().
    """
    name = "known_trf_decisions" if proposal else "original_trf_decisions"
    spec = feature_answer(F.size(known), name, "trf-interaction-proposal-v1" if proposal else None, most)
    excluded = F.array(*(F.lit(k) for k, (is_feature, _) in sorted(labelled.items()) if not is_feature)).cast("array<string>")
    classes = F.create_map(*(F.lit(x) for k, (is_feature, c) in sorted(labelled.items()) if is_feature for x in (k, c))) if any(f for f, _ in labelled.values()) else F.lit(None).cast("map<string,string>")

    def rules(v: Column) -> list[tuple[Column, str]]:
        decided, added = part(v, f"$.{name}", "array<variant>"), part(v, "$.added_trfs", "array<variant>")
        has_type = F.size(part(v, "$.revised_entity_types", "array<string>")) > 0
        text, action = (lambda x: part(x, "$.normalized_text", "string")), (lambda x: part(x, "$.action", "string"))
        new = lambda x: part(x, "$.text", "string")
        before = F.transform(known, key)
        out = []
        for items, path in ((decided, f"$.{name}"), (added, "$.added_trfs")):
            ids, sources, codes = (_cited(k) for k in range(3))
            out += [
                (_places(items, path, lambda x, i: F.size(F.array_except(ids(x), demos)) > 0), "unknown_demo"),
                (_places(items, path, lambda x, i: (F.size(ids(x)) > 0) & ~F.array_contains(sources(x), "EXEMPLARS")), "ids_without_source"),
                (_places(items, path, lambda x, i: (F.size(ids(x)) == 0) & F.array_contains(sources(x), "EXEMPLARS")), "source_without_ids"),
            ]
            if proposal:
                of = lambda x, *c: F.arrays_overlap(codes(x), F.array(*map(F.lit, c)))
                out += [
                    (_places(items, path, lambda x, i: of(x, "TARGET_EXPLICIT_SUPPORT", "TARGET_IMPLICIT_SUPPORT") & ~F.array_contains(sources(x), "TARGET_TEXT")), "code_without_text"),
                    (_places(items, path, lambda x, i: of(x, "EXEMPLAR_SUPPORT", "EXEMPLAR_CONTRADICTION") & ~F.array_contains(sources(x), "EXEMPLARS")), "code_without_exemplars"),
                ]
        out += [
            (_once(F.transform(decided, lambda x: key(text(x))) != before, f"$.{name}"), "order"),
            (_places(added, "$.added_trfs", lambda x, i: F.array_contains(before, key(new(x))) | F.exists(F.slice(added, F.lit(1), i), lambda y: key(new(y)) == key(new(x)))), "repeated_feature"),
        ]
        if not proposal:
            return [
                *out,
                (_places(decided, f"$.{name}", lambda x, i: F.array_contains(excluded, key(text(x))) & (action(x) != "drop")), "must_be_dropped"),
                (_places(added, "$.added_trfs", lambda x, i: F.array_contains(excluded, key(new(x)))), "excluded"),
                (_places(added, "$.added_trfs", lambda x, i: F.element_at(classes, key(new(x))) != part(x, "$.semantic_class", "string")), "labelled_class"),
            ]
        gate = lambda x: calibrated_decision(text(x), sentence, has_type, action(x), _cites(x)[2], _cites(x)[1], cues, POSITIVE_CODES)
        kept = F.exists(decided, lambda x: gate(x)["decision"] == "keep")
        support = lambda x: F.arrays_overlap(_cites(x)[2], F.array(*map(F.lit, POSITIVE_CODES)))
        return [
            *out,
            (_places(decided, f"$.{name}", lambda x, i: ~gate(x)["ok"]), "kept_without_support"),
            (_places(added, "$.added_trfs", lambda x, i: ~support(x)), "added_without_support"),
            (_places(added, "$.added_trfs", lambda x, i: (F.length(new(x)) > 160) | (key(new(x)) == key(sentence))), "not_a_feature"),
            (_places(added, "$.added_trfs", lambda x, i: (part(x, "$.semantic_class", "string") == "skill_type_cue") & ~contains_phrase(sentence, new(x))), "cue_not_in_text"),
            (_once(~has_type & kept, f"$.{name}"), "active_without_type"),
            (_once(~has_type & (F.size(added) > 0), "$.added_trfs"), "added_without_type"),
        ]

    return checked(content, spec, rules)


def feature_decisions(content: Column, decisions: str = "original_trf_decisions") -> Column:
    """What a valid answer decides: struct of has_type, decided (text, action, demos) in order, added (text, class, demos)."""
    v = F.try_parse_json(content)
    ids = lambda x: part(x, "$.evidence_demo_ids", "array<bigint>").alias("demos")
    decided = F.transform(part(v, f"$.{decisions}", "array<variant>"), lambda x: F.struct(part(x, "$.normalized_text", "string").alias("text"), part(x, "$.action", "string").alias("action"), ids(x)))
    added = F.transform(part(v, "$.added_trfs", "array<variant>"), lambda x: F.struct(part(x, "$.text", "string").alias("text"), part(x, "$.semantic_class", "string").alias("class"), ids(x)))
    return F.struct((F.size(part(v, "$.revised_entity_types", "array<string>")) > 0).alias("has_type"), decided.alias("decided"), added.alias("added"))


# --- judgments


def judgment_answer(n: Column, version: str | None = None, most: int = 240) -> Fields:
    """The schema of an answer that judges each candidate."""
    head = {"schema_version": Text(among=(version,))} if version else {}
    relation = Fields({"normalized_text": Text(), "relation": Text(among=RELATIONS)})
    one = {"demo_idx": Whole(), "helpfulness_score": Whole(1, 5), "role": Text(among=ROLES), "trf_relations": Items(relation), "reason_codes": Items(Text(among=JUDGMENT_CODES), least=1, distinct=True), "reason": Text(most)}
    rest = {"overall_reason": Text(most), "unresolved_issues": Items(Text(among=JUDGMENT_ISSUES), distinct=True)}
    return Fields({**head, "revised_judgments": Items(Fields(one), n, n), **rest})


def judgment_errors(content: Column, candidates: Column, features: Column, proposal: bool = False, most: int = 240) -> Column:
    """Problems of an answer that judges candidates (array of demo, status): (at, rule), none if it may be applied.

    features: those that a relation may name. A review keeps the order of candidates; a proposal may not, and has a version.
    """
    spec = judgment_answer(F.size(candidates), "exemplar-interaction-proposal-v1" if proposal else None, most)

    def rules(v: Column) -> list[tuple[Column, str]]:
        items, path = part(v, "$.revised_judgments", "array<variant>"), "$.revised_judgments"
        demo, role = (lambda x: part(x, "$.demo_idx", "bigint")), (lambda x: part(x, "$.role", "string"))
        ids = F.transform(candidates, lambda c: c["demo"].cast("long"))
        status = lambda x: F.get(F.filter(candidates, lambda c: c["demo"] == demo(x)), F.lit(0))["status"]
        relations = lambda x: F.transform(part(x, "$.trf_relations", "array<variant>"), lambda r: key(part(r, "$.normalized_text", "string")))
        known = F.transform(features, key)
        misfit = lambda x: F.when(status(x) == "accepted", role(x) == "contrastive").when(status(x) == "negative", role(x) == "supporting")
        out = [
            (_places(items, path, lambda x, i: ~F.array_contains(ids, demo(x))), "unknown_demo"),
            (_places(items, path, lambda x, i: F.exists(F.slice(items, F.lit(1), i), lambda y: demo(y) == demo(x))), "repeated_demo"),
            (_places(items, path, lambda x, i: misfit(x)), "role_of_status"),
            (_places(items, path, lambda x, i: F.size(F.array_except(relations(x), known)) > 0), "unknown_feature"),
            (_places(items, path, lambda x, i: F.size(F.array_distinct(relations(x))) < F.size(relations(x))), "repeated_relation"),
        ]
        return out if proposal else [*out, (_once(F.transform(items, demo) != ids, path), "order")]

    return checked(content, spec, rules)


def judgment_decisions(content: Column) -> Column:
    """What a valid answer judges: an array of demo, score, role, supports (the features that it says the demo supports)."""
    items = part(F.try_parse_json(content), "$.revised_judgments", "array<variant>")

    def supported(x: Column) -> Column:
        chosen = F.filter(part(x, "$.trf_relations", "array<variant>"), lambda r: part(r, "$.relation", "string") == "supports")
        return F.transform(chosen, lambda r: part(r, "$.normalized_text", "string"))

    return F.transform(items, lambda x: F.struct(part(x, "$.demo_idx", "bigint").alias("demo"), part(x, "$.helpfulness_score", "int").alias("score"), part(x, "$.role", "string").alias("role"), supported(x).alias("supports")))
