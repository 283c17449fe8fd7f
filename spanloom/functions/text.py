"""Text functions; those that SQL can't tell are Arrow functions over batches."""

from __future__ import annotations

import difflib
import json
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Words with inner marks, as technical terms have them: C++, C#, CI/CD, Node.js, .NET.
TECHNICAL = r"[^\W_][\w+#./&'-]*|\.[^\W_][\w+#-]*"
#: C1 control characters and the punctuation that they stand for in Windows-1252 text. Fixed values.
C1_FROM, C1_TO = "\u0085\u0091\u0092\u0093\u0094\u0096\u0097", "…‘’“”–—"
PLACEHOLDER = r"<[A-Z][A-Z_]*>"

_CJK = re.compile("[㐀-䶿一-鿿぀-ヿ가-힯]+")


def normalized(text: str | None) -> str | None:
    """NFKC, lower case, single spaces."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).lower().split())


def word_units(text: str | None) -> int:
    """Technical words outside CJK runs and half the CJK characters, rounded up; 1 at least."""
    text = text or ""
    runs = sum(len(r) for r in _CJK.findall(text))
    return max(1, len(re.findall(TECHNICAL, _CJK.sub(" ", text))) + math.ceil(runs / 2))


def _clean(token: str) -> str:
    return token.strip("-/").rstrip(".")


def unigrams(text: str | None, stopwords: frozenset[str] = frozenset(), placeholder: str = PLACEHOLDER, exclude_digits: bool = True) -> list[str]:
    """NFKC tokens in their own case, without placeholders, stopwords and, on demand, tokens with digits."""
    blank = re.sub(placeholder, lambda m: " " * len(m[0]), unicodedata.normalize("NFKC", text or ""))
    tokens = map(_clean, re.findall(TECHNICAL, blank))
    return [t for t in tokens if any(c.isalnum() for c in t) and not (exclude_digits and any(c.isdigit() for c in t)) and t.lower() not in stopwords]


def tokens_with_offsets(text: str | None, placeholder: str = PLACEHOLDER) -> list[dict]:
    """Tokens as they stand, with offsets; those that overlap a placeholder are left out."""
    text = text or ""
    blocked = [m.span() for m in re.finditer(placeholder, text)]
    out = []
    for m in re.finditer(TECHNICAL, text):
        token = _clean(m[0])
        start = m.start() + m[0].find(token)
        if token and any(c.isalnum() for c in token) and not any(max(a, start) < min(b, start + len(token)) for a, b in blocked):
            out.append({"text": token, "start": start, "end": start + len(token)})
    return out


def _edit_operations(source: str | None, other: str | None) -> list[tuple]:
    """The contract's operations: from 200 characters on, those that make up over a hundredth of the other text begin no match."""
    return [o for o in difflib.SequenceMatcher(None, source or "", other or "").get_opcodes() if o[0] != "equal"]


def edit_histogram(source: str | None, other: str | None) -> dict:
    """Number of edit operations of each kind."""
    kinds = [o[0] for o in _edit_operations(source, other)]
    return {k: kinds.count(k) for k in ("insert", "delete", "replace")}


def edit_summary(source: str | None, other: str | None) -> dict:
    """Number of edit operations and of changed characters on both sides."""
    ops = _edit_operations(source, other)
    return {"n_ops": len(ops), "source_chars": sum(o[2] - o[1] for o in ops), "other_chars": sum(o[4] - o[3] for o in ops)}


def balanced_objects(text: str) -> list[str]:
    """The outermost brace-balanced parts of a text, with regard to strings."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def lenient_object(content: str | None) -> tuple[str | None, str]:
    """A JSON object and how it was found: direct, fenced, embedded; or None and the reason."""

    def load(x: str) -> dict | None:
        try:
            value = json.loads(x)
        except (ValueError, RecursionError):  # the latter where it is nested too deeply
            return None
        return value if isinstance(value, dict) else None

    content = content or ""
    fences = re.findall(r"```(?:json)?\s*\n?(.*?)```", content, re.DOTALL)
    for found, method in (([content], "direct"), (fences, "fenced"), (balanced_objects(content), "embedded")):
        objects = [o for o in map(load, found) if o is not None]
        if len(objects) == 1 and len(found) == 1:
            return json.dumps(objects[0], sort_keys=True, ensure_ascii=False), method
    return None, "no_single_object"


def unique_assignment(sentence: str, payloads: list[str]) -> list[tuple[int, int]] | None:
    """The one way to place payloads in order, without overlap; None if there is none or more than one.

    Every placement lies between the one where each payload comes as early as it can and the one where each comes as
    late as it can, so it is the only one if these two are the same.
    """
    if not payloads or not all(payloads):
        return None
    early, at = [], 0
    for p in payloads:
        at = sentence.find(p, at)
        if at < 0:
            return None
        early.append((at, at + len(p)))
        at += len(p)
    at = len(sentence)
    for p, place in zip(reversed(payloads), reversed(early), strict=True):
        at = sentence.rfind(p, 0, at)
        if at != place[0]:
            return None
    return early


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with as many blanks for each span; what spans have beyond the text's ends doesn't count."""
    out, at = [], 0
    for start, end in sorted(spans):
        start, end = max(at, start), min(len(text), end)
        if start < end:
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def canonical(value: Column, kind: DataType) -> Column:
    """The value with the fields of all its structs, and the keys of its maps, in sorted order."""
    if isinstance(kind, StructType):
        fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))))
    return value


def canonical_json(df: DataFrame, column: str) -> Column:
    """A column of df as JSON without blanks: sorted keys, nulls kept, and characters as they are. It must be a struct, array or map."""
    return F.to_json(canonical(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def canonical_sha256(df: DataFrame, column: str) -> Column:
    """sha256 of canonical_json(): the same for structs that differ only by the order of fields, another for a null than for a field that isn't there."""
    return F.sha2(canonical_json(df, column), 256)


def recovered(text: Column) -> Column:
    """C1 control characters read as the punctuation meant."""
    return F.translate(text, C1_FROM, C1_TO)


def substitutions(text: Column) -> Column:
    """How many characters recovered() changes."""
    return F.length(text) - F.length(F.translate(text, C1_FROM, ""))


#: Pairs of a source's character and the one that a model may write for it. Fixed values.
SAFE_PAIRS = dict(zip(C1_FROM, C1_TO, strict=True))


def projected(sentence: str | None, tagged: str | None, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]] | None, list[tuple[int, str, str]], str | None]:
    """Spans of a model's copy carried over to the sentence: (spans, substitutions, reason), spans or a reason.

    Copy and sentence are walked side by side. They must differ, have one length, and each difference must be one of
    SAFE_PAIRS: a source's control mark for which the copy has the punctuation meant, not the other way round.
    """
    sentence, tagged = sentence or "", tagged or ""
    if sentence == tagged:
        return None, [], "unchanged"
    if len(sentence) != len(tagged):
        return None, [], "length_changed"
    changed = [(k, a, b) for k, (a, b) in enumerate(zip(sentence, tagged, strict=True)) if a != b]
    if any(SAFE_PAIRS.get(a) != b for _, a, b in changed):
        return None, changed, "character_changed"
    return [(a, b, sentence[a:b]) for a, b in spans], changed, None


def redacted(text: Column, secrets: list[str], mark: str = "<redacted>") -> Column:
    """The text with each secret replaced: the leftmost first, of those the longest, whatever their order. For many see phrases."""
    longest = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    return F.regexp_replace(text, "|".join(map(_quoted, longest)), mark) if longest else text


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def json_quoted(text: Column) -> Column:
    """A text as a JSON string, null for null. It is cut by length: no pattern is asked what a line is."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(quoted, F.lit(6), F.length(quoted) - 6))


_SPAN_ROWS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _of_one(f, ddl: str, kind: pa.DataType, column: Column) -> Column:
    @F.arrow_udf(ddl)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in x.to_pylist()], kind)

    return run(column)


def _of_two(f, ddl: str, kind: pa.DataType, one: Column, two: Column) -> Column:
    @F.arrow_udf(ddl)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([f(v, w) for v, w in zip(x.to_pylist(), y.to_pylist(), strict=True)], kind)

    return run(one, two)


def nfkc_text(text: Column) -> Column:
    return _of_one(normalized, "string", pa.string(), text)


def units(text: Column) -> Column:
    return _of_one(word_units, "int", pa.int32(), text)


def unigram_tokens(text: Column) -> Column:
    return _of_one(unigrams, "array<string>", pa.list_(pa.string()), text)


def offset_tokens(text: Column) -> Column:
    return _of_one(tokens_with_offsets, "array<struct<text:string,start:int,end:int>>", _SPAN_ROWS, text)


def edits(source: Column, other: Column) -> Column:
    """Struct of edit_summary() and edit_histogram()."""
    names = ("n_ops", "source_chars", "other_chars", "insert", "delete", "replace")
    kind = pa.struct([(n, pa.int32()) for n in names])
    return _of_two(lambda a, b: edit_summary(a, b) | edit_histogram(a, b), f"struct<{','.join(f'{n}:int' for n in names)}>", kind, source, other)


def lenient_json(content: Column) -> Column:
    kind = pa.struct([("object", pa.string()), ("method", pa.string())])
    return _of_one(lambda c: dict(zip(("object", "method"), lenient_object(c), strict=True)), "struct<object:string,method:string>", kind, content)


def masked_spans(text: Column, spans: Column) -> Column:
    """masked(); null where the text or its array of spans is null."""

    def cover(t: str | None, s: list | None) -> str | None:
        return None if t is None or s is None else masked(t, [(x["start"], x["end"]) for x in s])

    ends = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return _of_two(cover, "string", pa.string(), text, ends)


def placed_payloads(sentence: Column, payloads: Column) -> Column:
    """The unique placement as spans; null if there is none."""

    def place(s: str | None, p: list | None) -> list | None:
        found = unique_assignment(s or "", p or [])
        return None if found is None else [{"text": t, "start": a, "end": b} for t, (a, b) in zip(p, found, strict=True)]

    return _of_two(place, "array<struct<text:string,start:int,end:int>>", _SPAN_ROWS, sentence, payloads)


def projection(sentence: Column, copy: Column, spans: Column) -> Column:
    """struct<spans, substitutions, reason> of projected(); spans is an array of structs with start and end."""
    kind = pa.struct([("spans", _SPAN_ROWS), ("substitutions", pa.list_(pa.struct([("position", pa.int32()), ("source", pa.string()), ("model", pa.string())]))), ("reason", pa.string())])

    @F.arrow_udf("struct<spans:array<struct<text:string,start:int,end:int>>,substitutions:array<struct<position:int,source:string,model:string>>,reason:string>")
    def run(s: pa.Array, c: pa.Array, x: pa.Array) -> pa.Array:
        out = []
        for sentence, copy, ends in zip(s.to_pylist(), c.to_pylist(), x.to_pylist(), strict=True):
            found, changed, reason = projected(sentence, copy, [(e["start"], e["end"]) for e in ends or []])
            rows = None if found is None else [{"text": t, "start": a, "end": b} for a, b, t in found]
            out.append({"spans": rows, "substitutions": [{"position": k, "source": a, "model": b} for k, a, b in changed], "reason": reason})
        return pa.array(out, kind)

    return run(sentence, copy, F.transform(spans, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
