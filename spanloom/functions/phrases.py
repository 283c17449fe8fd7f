"""Many phrases at once: an Aho-Corasick automaton over all of them reads a text once, whatever their number.

The phrases are a relation. They go to every task, so their size is checked first and more than RESIDENT characters are
an error. Matches are leftmost-longest: of those that begin first the longest, then what begins behind its end. Folding
takes no notice of case; matches still have the places of the text as it is.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that a task may hold.
RESIDENT = 1 << 26
REDACTED = "<redacted>"  # fixed value


def _folded(text: str) -> tuple[str, list[int] | None]:
    """The text without case, and for each of its characters the place it comes from; None where these are the same."""
    if text.isascii():
        return text.lower(), None
    parts = [c.casefold() for c in text]
    return "".join(parts), [k for k, p in enumerate(parts) for _ in p]


class Phrases:
    """An automaton of phrases. Empty ones are left out; with fold, phrases that differ by case are one, the first in order."""

    def __init__(self, phrases: list[str], fold: bool = False, words: bool = False):
        self.fold, self.words = fold, words
        self.automaton = ahocorasick.Automaton()
        for p in sorted(set(phrases)):
            key = p.casefold() if fold else p
            if key and key not in self.automaton:
                self.automaton.add_word(key, (len(key), p))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, phrase) of the leftmost-longest matches. With words, a match has no letter, digit or underscore beside it."""
        if not text or not self.some:
            return []
        folded, places = _folded(text) if self.fold else (text, None)
        edge = lambda k: not (0 <= k < len(text) and (text[k].isalnum() or text[k] == "_"))
        all_of = []
        for last, (n, phrase) in self.automaton.iter(folded):
            a, b = last + 1 - n, last + 1
            if places is not None:
                # a match begins and ends with whole characters of the text
                if a and places[a - 1] == places[a] or b < len(places) and places[b] == places[b - 1]:
                    continue
                a, b = places[a], places[b - 1] + 1
            if not self.words or edge(a - 1) and edge(b):
                all_of.append((a, -b, phrase))
        out, at = [], 0
        for a, b, phrase in sorted(all_of):
            if a >= at:
                out.append((a, -b, phrase))
                at = -b
        return out

    def replaced(self, text: str | None, mark: str = REDACTED) -> str | None:
        """The text with each match replaced. What comes of it isn't read again."""
        found = self.found(text)
        if not found:
            return text
        out, at = [], 0
        for a, b, _ in found:
            out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]])

    def replaced_within(self, text: str | None, mark: str = REDACTED) -> str | None:
        """JSON with the matches in its strings replaced, at any depth, keys as they are; what is no JSON as a text."""
        try:
            value = json.loads(text or "")
        except (ValueError, RecursionError):
            return self.replaced(text, mark)
        return json.dumps(self._within(value, mark), ensure_ascii=False)

    def _within(self, value: object, mark: str) -> object:
        if isinstance(value, dict):
            return {k: self._within(v, mark) for k, v in value.items()}
        if isinstance(value, list):
            return [self._within(v, mark) for v in value]
        return self.replaced(value, mark) if isinstance(value, str) else value


class Sent:
    """Phrases as the tasks get them: their texts by broadcast, the automaton made once a worker."""

    def __init__(self, phrases: DataFrame, column: str, fold: bool = False, words: bool = False):
        spark = phrases.sparkSession
        distinct = phrases.select(column).where(F.col(column).isNotNull()).distinct()
        size = distinct.agg(F.sum(F.length(column) + 1)).first()[0] or 0
        if size > RESIDENT:
            raise ValueError(f"phrases of {size} characters are more than a task may hold ({RESIDENT})")
        self.texts = spark.sparkContext.broadcast([r[0] for r in distinct.collect()])
        self.fold, self.words = fold, words

        self.name = uuid.uuid4().hex

    def get(self) -> Phrases:
        if self.name not in _MADE:
            _MADE.clear()
            _MADE[self.name] = Phrases(self.texts.value, self.fold, self.words)
        return _MADE[self.name]


#: The last automaton that this worker made, by the name it was sent under.
_MADE: dict[str, Phrases] = {}


def _column(sent: Sent, work: Callable[[Phrases, str | None], object], ddl: str, kind: pa.DataType, text: Column) -> Column:
    @F.arrow_udf(ddl)
    def run(x: pa.Array) -> pa.Array:
        phrases = sent.get()
        return pa.array([work(phrases, v) for v in x.to_pylist()], kind)

    return run(text)


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("phrase", pa.string())]))


def matches(text: Column, phrases: Sent) -> Column:
    """array<struct<start, end, phrase>> of the leftmost-longest matches; empty for a null."""
    names = ("start", "end", "phrase")
    return _column(phrases, lambda p, v: [dict(zip(names, m, strict=True)) for m in p.found(v)], "array<struct<start:int,end:int,phrase:string>>", _FOUND, text)


def redacted(text: Column, secrets: Sent, mark: str = REDACTED) -> Column:
    return _column(secrets, lambda p, v: p.replaced(v, mark), "string", pa.string(), text)


def redacted_json(text: Column, secrets: Sent, mark: str = REDACTED) -> Column:
    """As redacted(), in the strings of a JSON value."""
    return _column(secrets, lambda p, v: p.replaced_within(v, mark), "string", pa.string(), text)


# --- a list of features, told against a bank and a sentence


_FLAGS = ("in_bank", "in_bank_folded", "in_text", "in_text_folded")


def listed_features(content: str | None, sentence: str | None, bank: frozenset[str], folded_bank: frozenset[str]) -> tuple[list[dict] | None, str | None]:
    """The features of {"trfs": [...]} with their flags, or the reason why there are none: NFKC without blanks around, each once, in order."""
    try:
        value = json.loads(content or "")
    except (ValueError, RecursionError):
        return None, "json"
    if not isinstance(value, dict) or set(value) != {"trfs"}:
        return None, "keys"
    if not isinstance(value["trfs"], list):
        return None, "type"
    out: dict[str, dict] = {}
    sentence = sentence or ""
    low = sentence.casefold()
    for raw in value["trfs"]:
        if not isinstance(raw, str):
            return None, "type"
        text = unicodedata.normalize("NFKC", raw.strip()).strip()
        if not text:
            return None, "blank"
        if text not in out:
            key = text.casefold()
            flags = (text in bank, key in folded_bank, text in sentence, key in low)
            out[text] = {"raw": raw, "text": text, "place": len(out) + 1, **dict(zip(_FLAGS, flags, strict=True))}
    return list(out.values()), None


def features(content: Column, sentence: Column, bank: Sent) -> Column:
    """struct<features, error> of listed_features(); one of the two is null."""
    fields = [("raw", pa.string()), ("text", pa.string()), ("place", pa.int32()), *((f, pa.bool_()) for f in _FLAGS)]
    kind = pa.struct([("features", pa.list_(pa.struct(fields))), ("error", pa.string())])
    flags = ",".join(f"{f}:boolean" for f in _FLAGS)

    @F.arrow_udf(f"struct<features:array<struct<raw:string,text:string,place:int,{flags}>>,error:string>")
    def run(c: pa.Array, s: pa.Array) -> pa.Array:
        exact = frozenset(bank.texts.value)
        folded = frozenset(x.casefold() for x in exact)
        return pa.array([dict(zip(("features", "error"), listed_features(a, b, exact, folded), strict=True)) for a, b in zip(c.to_pylist(), s.to_pylist(), strict=True)], kind)

    return run(content, sentence)
