"""What goes to a model and what comes back: prompts without leakage, response schemas, strict parsers, repairs, replay.

Prompts are built as column expressions from public columns only. Parsers are plain functions that return a value or the
reason why there is none; they run over Arrow batches and give rows, so a bad answer never fails a job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"accepted": ("supporting", "irrelevant"), "negative": ("contrastive", "irrelevant")}


class Invalid(ValueError):
    """An answer that the contract doesn't allow."""


# --- prompts


def prompt(instructions: str, maximum: int, **public: Column) -> Column:
    """Struct of text, sha256 and fits: the instructions and a JSON object of the public columns, under a size limit."""
    body = F.concat(F.lit(instructions + "\n"), F.to_json(F.struct(*(c.alias(n) for n, c in sorted(public.items())))))
    return F.struct(body.alias("text"), F.sha2(body, 256).alias("sha256"), (F.length(body) <= maximum).alias("fits"))


def public_examples(candidates: Column) -> Column:
    """Candidates for a judging prompt: no similarity, rank, score or reliability, which would give the answer away."""
    return F.transform(candidates, lambda c: F.struct(c["demo"].alias("demo"), c["sentence"].alias("sentence"), c["status"].alias("status"), c["spans"].alias("spans")))


def public_features(features: Column) -> Column:
    return F.transform(features, lambda f: F.struct(f["text"].alias("text"), f["active"].alias("active")))


def repair_messages(messages: list[dict], answer: str, error: str, contract: str) -> list[dict]:
    """The conversation with the bad answer, the error (800 characters) and the contract again."""
    return [*messages, {"role": "assistant", "content": answer}, {"role": "user", "content": f"{error[:800]}\n{contract}"}]


# --- schemas


def _object(properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": sorted(properties), "properties": properties}


def judgment_schema(demos: Iterable[int], max_reason: int = 300) -> dict:
    """A strict JSON Schema whose enums and sizes come from the row: each demo once, in order."""
    demos = list(demos)
    item = _object({"demo": {"type": "integer", "enum": demos}, "score": {"type": "integer", "minimum": 1, "maximum": 5}, "role": {"type": "string", "enum": sorted({r for v in ROLES.values() for r in v})}, "reason": {"type": "string", "maxLength": max_reason}})
    return _object({"judgments": {"type": "array", "minItems": len(demos), "maxItems": len(demos), "items": item}})


def feature_schema(known: Iterable[str], max_reason: int = 300) -> dict:
    known = list(known)
    decision = _object({"feature": {"type": "string", "enum": known}, "decision": {"type": "string", "enum": ["drop", "keep"]}, "reason": {"type": "string", "maxLength": max_reason}})
    return _object({"decisions": {"type": "array", "minItems": len(known), "maxItems": len(known), "items": decision}, "added": {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": 160}}})


# --- strict parsers


def strict_object(content: str, keys: set[str]) -> dict:
    """Just one JSON object, nothing around it, no repeated keys, exactly these keys, no NaN."""

    def pairs(items: list) -> dict:
        if len(dict(items)) != len(items):
            raise Invalid("repeated key")
        return dict(items)

    def constant(x: str) -> None:
        raise Invalid(f"{x} isn't JSON")

    try:
        value = json.loads(content, object_pairs_hook=pairs, parse_constant=constant)
    except Invalid:
        raise
    except ValueError as e:
        raise Invalid(f"not JSON: {e}") from e
    except RecursionError as e:
        raise Invalid("not JSON: nested too deeply") from e
    if not isinstance(value, dict) or set(value) != keys:
        raise Invalid(f"keys must be {sorted(keys)}")
    return value


def whole_number(value: object, low: int, high: int, label: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise Invalid(f"{label} must be {low}..{high}")
    return value


def tagged_spans(content: str, sentence: str | None) -> list[tuple[int, int, str]]:
    """Spans of {"annotated_sentence": …}; with a sentence, its text without tags must be just that."""
    text = strict_object(content, {"annotated_sentence"})["annotated_sentence"]
    if not isinstance(text, str):
        raise Invalid("annotated_sentence must be a string")
    plain, spans, start = [], [], None
    size = 0
    for k, part in enumerate(text.split("<skill>")):
        inside, closed, rest = part.partition("</skill>")
        if k and (start is not None or not closed or not inside):
            raise Invalid("nested, unclosed or empty tag")
        if k == 0 and closed or "</skill>" in rest:
            raise Invalid("unmatched closing tag")
        if k:
            spans.append((size, size + len(inside), inside))
        plain += [inside, rest]
        size += len(inside) + len(rest)
    if sentence is not None and "".join(plain) != sentence:
        raise Invalid("the text differs from its source")
    return spans


def judgments(content: str, candidates: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(demo, score, role) in candidate order: every candidate once, a role that its status allows."""
    found = {}
    rows = strict_object(content, {"judgments"})["judgments"]
    if not isinstance(rows, list):
        raise Invalid("judgments must be an array")
    status = dict(candidates)
    for r in rows:
        if not isinstance(r, dict) or set(r) != {"demo", "score", "role", "reason"}:
            raise Invalid("a judgment has demo, score, role and reason")
        if r["demo"] in found or r["demo"] not in status:
            raise Invalid(f"demo {r['demo']} is repeated or unknown")
        if r["role"] not in ROLES[status[r["demo"]]]:
            raise Invalid(f"role {r['role']} doesn't fit a {status[r['demo']]} demo")
        found[r["demo"]] = (r["demo"], whole_number(r["score"], 1, 5, "score"), r["role"])
    if set(found) != set(status):
        raise Invalid("candidates are missing")
    return [found[d] for d, _ in candidates]


def feature_proposal(content: str, known: list[str], sentence: str, has_type: bool) -> tuple[list[str], list[str]]:
    """(kept, added): a decision for each known feature in order; additions are short, new, not the sentence, and need the type."""
    value = strict_object(content, {"decisions", "added"})
    if [d.get("feature") if isinstance(d, dict) else None for d in value["decisions"]] != known:
        raise Invalid("decisions must follow the known features")
    if any(set(d) != {"feature", "decision", "reason"} or d["decision"] not in ("keep", "drop") for d in value["decisions"]):
        raise Invalid("a decision has feature, decision and reason")
    seen, added = {k.casefold() for k in known}, []
    for a in value["added"]:
        if not isinstance(a, str) or not a.strip() or len(a) > 160 or a == sentence or a.casefold() in seen or not has_type:
            raise Invalid(f"can't add {a!r}")
        seen.add(a.casefold())
        added.append(a)
    kept = [d["feature"] for d in value["decisions"] if d["decision"] == "keep"]
    if not has_type and kept:
        raise Invalid("no type, so no active feature")
    return kept, added


def parsed(raw: DataFrame, parse: Callable[..., object], *columns: str) -> DataFrame:
    """id, value (JSON), error for raw (id, content, columns): one of the two is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids, *args = (b.column(k).to_pylist() for k in range(b.num_columns))
            values, errors = [], []
            for row in zip(*args, strict=True):
                try:
                    values.append(json.dumps(parse(*row), ensure_ascii=False))
                    errors.append(None)
                except Invalid as e:
                    values.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["id", "value", "error"])

    return raw.select("id", "content", *columns).mapInArrow(run, "id long, value string, error string")
