"""Fill-in-middle transformation by a parallel automaton scan.

One automaton reads both what the cuts need: whether a unit (a line with its end) begins at a character, and whether
the text has one of the control strings. A chunk of text is told by what it does whatever state it is entered in: per
start state the state behind it and the number of units that begin in it. These functions compose associatively. So a
chunk is folded as a tree over its characters, runs of ordinary ones as one; the chunks of a document are folded in
their order, which resolves each chunk's entry state and how many units lie before it; and a cut is selected by the
counts, first the chunk, then down the chunk's tree.

Texts up to GIANT characters are one chunk in one task. The chunks of longer ones are dealt over all tasks, are scanned
before anything is known about what lies in front of them, and only the chunks that hold a cut are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table, tune

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Characters of a text from which it is dealt in chunks, and of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 14
SEED, RATE, SPM = 7, 100, 50


class Automaton:
    """Over classes of characters, class 0 all ordinary ones. A state is a place in a line (its begin or not) and the longest suffix read that begins a mark."""

    def __init__(self, marks: tuple[str, ...] = MARKS):
        letters = sorted({"\n", *"".join(marks)})
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        begun = [""] + sorted({m[:k] for m in marks for k in range(1, len(m))})
        self.found = len(begun)  # the marks' last state: it is never left

        def suffix(read: str) -> int:
            if any(read.endswith(m) for m in marks):
                return self.found
            return max((i for i, b in enumerate(begun) if read.endswith(b)), key=lambda i: len(begun[i]))

        half = self.found + 1
        self.states = 2 * half
        self.goes = np.zeros((self.states, 1 + len(letters)), dtype=np.intp)
        self.begins = np.zeros((self.states, 1 + len(letters)), dtype=np.int64)
        for s in range(self.states):
            for k, c in enumerate(["", *letters]):
                mark = self.found if s % half == self.found else suffix(begun[s % half] + c) if c else 0
                self.goes[s, k] = mark + half * (c != "\n")
                self.begins[s, k] = s < half

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Classes and places of the characters that aren't ordinary and of the first one of each ordinary run: the others of a run change nothing."""
        chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kinds = np.searchsorted(self.codes, chars).astype(np.uint8)
        kinds = np.where(self.codes[np.minimum(kinds, len(self.codes) - 1)] == chars, kinds + 1, 0).astype(np.uint8)
        kept = kinds > 0
        kept[:1] = True
        kept[1:] |= kinds[:-1] > 0
        at = np.flatnonzero(kept)
        return kinds[at], at


class Scan:
    """A chunk's composition tree: its root is the chunk's function and counts by start state."""

    def __init__(self, automaton: Automaton, text: str):
        kinds, self.at = automaton.events(text)
        self.chars = len(text)
        self.levels = [(automaton.goes.T[kinds], automaton.begins.T[kinds])]
        identity = np.arange(automaton.states)[None], np.zeros((1, automaton.states), dtype=np.int64)
        while len(self.levels[-1][0]) != 1:
            goes, begins = self.levels[-1]
            if len(goes) % 2 or not len(goes):
                goes, begins = np.concatenate([goes, identity[0]]), np.concatenate([begins, identity[1]])
                self.levels[-1] = goes, begins
            if len(goes) > 1:
                self.levels.append(compose((goes[::2], begins[::2]), (goes[1::2], begins[1::2])))
        self.goes, self.begins = self.levels[-1][0][0], self.levels[-1][1][0]

    def select(self, state: int, n: int) -> int:
        """The place of the n-th unit, from 0, that begins in the chunk when it is entered in state; the chunk's end if fewer do."""
        if n >= int(self.begins[state]):
            return self.chars
        node = 0
        for goes, begins in reversed(self.levels[:-1]):
            node *= 2
            if n >= (left := int(begins[node, state])):
                n, state, node = n - left, int(goes[node, state]), node + 1
        return int(self.at[node])


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Function and counts of two neighbours, row by row."""
    row = np.arange(len(first[0]))[:, None]
    return then[0][row, first[0]], first[1] + then[1][row, first[0]]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


_CUT = pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])
_CUT_DDL = "struct<n: long, marked: boolean, a: long, b: long>"


def _cut(text: str, h1: int, h2: int) -> dict:
    """Number of units, whether a mark is in the text, and the characters before the first and the second cut."""
    dfa, scan = automaton(), Scan(automaton(), text)
    n = int(scan.begins[0])
    places = [scan.select(0, c) for c in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return {"n": n, "marked": bool(scan.goes[0] % (dfa.found + 1) == dfa.found), "a": places[0], "b": places[1]}


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    return pa.array([_cut(t.as_py(), *h) for t, *h in zip(text, h1.to_pylist(), h2.to_pylist(), strict=True)], _CUT)


# --- giant texts


def _chunking(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(*(batch.column(k) for k in range(2)), strict=True):
                text = text.as_py()
                for at in range(0, len(text), 64 * size):
                    parts = [text[k : k + size] for k in range(at, min(len(text), at + 64 * size), size)]
                    yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * len(parts)), pa.array(range(at // size, at // size + len(parts)), pa.int32()), pa.array(parts)], ["digest", "k", "part"])

    return run


_SCANNED = pa.struct([("chars", pa.int64()), ("goes", pa.list_(pa.int32())), ("begins", pa.list_(pa.int64()))])
_SCANNED_DDL = "struct<chars: long, goes: array<int>, begins: array<long>>"


def _scanned(part: pa.Array) -> pa.Array:
    scans = [Scan(automaton(), p.as_py()) for p in part]
    return pa.array([{"chars": s.chars, "goes": s.goes.tolist(), "begins": s.begins.tolist()} for s in scans], _SCANNED)


_RESOLVED = "digest string, n long, marked boolean, entry array<int>, units array<long>, before array<long>"


def _resolved(chunks: pa.Table) -> pa.Table:
    """One text: each chunk's entry state, and the units and characters before it."""
    rows = sorted(zip(*(chunks[c].to_pylist() for c in ("k", "chars", "goes", "begins")), strict=True))
    state = units = chars = 0
    entry, upto, before = [], [], []
    for _, size, goes, begins in rows:
        entry.append(state)
        upto.append(units)
        before.append(chars)
        units, chars, state = units + begins[state], chars + size, goes[state]
    dfa = automaton()
    columns = [[chunks["digest"][0].as_py()], [units], [state % (dfa.found + 1) == dfa.found], [entry], [upto], [before]]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n", "marked", "entry", "units", "before"])


def _chunk_of(units: pa.Array, c: pa.Array) -> pa.Array:
    """The chunk in which the c-th unit begins, or the last one: the last with at most c units before it."""
    return pa.array([int(np.searchsorted(u.values.to_numpy(), n, "right")) - 1 for u, n in zip(units, c.to_pylist(), strict=True)], pa.int32())


def _selected(part: pa.Array, entry: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([Scan(automaton(), p.as_py()).select(s, k) for p, s, k in zip(part, entry.to_pylist(), n.to_pylist(), strict=True)], pa.int64())


def _giant_cuts(giants: DataFrame) -> DataFrame:
    """doc_id, digest, cut of the texts of giants (doc_id, digest, text, h1, h2); copies of a text are scanned once.

    A text's chunks meet as summaries of some 300 bytes each, at most 2^31 / CHUNK of them, since a text is one value.
    """
    parts = giants.select("digest", "text").mapInArrow(_chunking(CHUNK), "digest string, k int, part string")
    parts = materialize(parts.dropDuplicates(["digest", "k"]).withColumn("scan", F.arrow_udf(_scanned, _SCANNED_DDL)("part")), "fim-chunks")
    known = parts.select("digest", "k", "scan.*").groupBy("digest").applyInArrow(_resolved, _RESOLVED)
    wanted = giants.select("doc_id", "digest", "h1", "h2").distinct().join(known, "digest")
    lines = F.col("n") + 1
    c = F.array(F.least(F.col("h1") % lines, F.col("h2") % lines), F.greatest(F.col("h1") % lines, F.col("h2") % lines))
    each = wanted.select("doc_id", "digest", "n", "marked", "entry", "units", "before", F.posexplode(c).alias("which", "c"))
    each = each.withColumn("k", F.arrow_udf(_chunk_of, "int")("units", "c"))
    at = lambda name: F.get(name, F.col("k")).alias(f"{name}_k")
    placed = each.select("doc_id", "digest", "n", "marked", "which", "c", "k", at("entry"), at("units"), at("before"))
    found = placed.join(parts.select("digest", "k", "part"), ["digest", "k"])
    place = F.col("before_k") + F.arrow_udf(_selected, "long")("part", "entry_k", F.col("c") - F.col("units_k"))
    found = found.select("doc_id", "digest", "n", "marked", "which", place.alias("place"))
    first, second = (F.max(F.when(F.col("which") == w, F.col("place"))).alias(name) for w, name in ((0, "a"), (1, "b")))
    return found.groupBy("doc_id", "digest", "n", "marked").agg(first, second).select("doc_id", "digest", F.struct("n", "marked", "a", "b").alias("cut"))


# --- the operator


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs (doc_id, text); other columns aren't read.

    rate percent of documents are transformed, spm percent of these with the suffix first, by a hash of seed and doc_id.
    Null texts are empty. Empty texts and those with a control string stay plain; then the two lengths are null. A null
    doc_id counts as an empty one in the hash. Repeated rows each have their row; an empty table gives no rows. Texts of
    any length that Spark can hold as one value are cut whole.
    """
    tune(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *h)
    giant = F.length("text") > GIANT
    cut = rows.where(~giant).withColumn("cut", F.arrow_udf(_cuts, _CUT_DDL)("text", "h1", "h2"))
    giants = materialize(rows.where(giant).withColumn("digest", F.sha2("text", 256)), "fim-giants")
    if not giants.isEmpty():
        found = _giant_cuts(giants).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "cut")
        again = giants.join(found, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id")))
        cut = cut.unionByName(again.select("doc_id", "text", "h1", "h2", "h3", "h4", "cut"))
    return cut.select("doc_id", "text", "h3", "h4", "cut.*").select("doc_id", "n", *_formed(rate, spm))


def _formed(rate: int, spm: int) -> list[Column]:
    text, a, b = F.col("text"), F.col("a"), F.col("b")
    plain = (text == "") | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    part = lambda begin, end: F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(form == "plain", text).when(form == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return [form.alias("form"), F.when(~plain, a).alias("prefix_chars"), F.when(~plain, b - a).alias("middle_chars"), output.alias("output")]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark is whole wherever it begins, so the first of each kind is the one set."""
    at = {m: F.instr(output, m) for m in MARKS}
    part = lambda begin, end: F.substring(output, begin + 3, end - begin - 3)
    middle = F.substring(output, at[MIDDLE] + 3, F.length(output))
    psm = F.concat(part(at[PREFIX], at[SUFFIX]), middle, part(at[SUFFIX], at[MIDDLE]))
    spm = F.concat(part(at[PREFIX], at[MIDDLE]), middle, part(at[SUFFIX], at[PREFIX]))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), units AS (
  SELECT doc_id, text, CAST(length(text) - length(replace(text, chr(10), '')) + CAST(text <> '' AND right(text, 1) <> chr(10) AS INTEGER) AS BIGINT) AS n,
    {", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))}, list_transform(str_split(text, chr(10)), lambda x: length(x) + 1) AS sizes FROM hashed
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2 FROM units
), placed AS (
  SELECT *, least(length(text), CAST(coalesce(list_sum(sizes[1:c1]), 0) AS BIGINT)) AS a, least(length(text), CAST(coalesce(list_sum(sizes[1:c2]), 0) AS BIGINT)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256
FROM placed
"""
