"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns behind the last assistant turn, or a conversation without one, make one more example without trainable text, so
that the output holds every turn. An example thus repeats its context: the output grows with the square of a
conversation's turns, as the method has it; workers keep one conversation at a time.

Turns are marked by control strings. Inside roles and texts a backslash is doubled and each control string is broken
by a single backslash behind its first character, which reading undoes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, tune

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other templates; none survives inside a text.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"({re.escape(c[0])})({re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        if c in text:
            text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """The examples of a conversation: formatted text, and where its trainable part begins and ends (equal if there is none)."""
    context: list[str] = []
    size, covered = 0, 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        context.append(head + body + END)
        if role == "assistant":
            begin = size + len(head)
            yield "".join(context), begin, begin + len(body)
            covered = k + 1
        size += len(context[-1])
    if covered < len(turns):
        yield "".join(context), size, size


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of an example, unescaped."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return out


_EXAMPLES = "conv_id long, example int, last boolean, formatted string, loss_begin long, loss_end long"
_KINDS = [("conv_id", pa.int64()), ("example", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss_begin", pa.int64()), ("loss_end", pa.int64())]
#: Characters of examples that go to Spark together.
_TOGETHER = 1 << 20


def _rows(kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations of rows (conv_id, role, text) that lie together."""
    started, now, turns = False, None, []
    for batch in batches:
        for name, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if not started or name != now:
                if started:
                    yield now, turns
                started, now, turns = True, name, []
            turns.append((role, text))
    if started:
        yield now, turns


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for name, turns in _conversations(batches):
        waiting = None
        for example, (text, begin, end) in enumerate(expand(turns)):
            if waiting:
                out.append((*waiting[:2], False, *waiting[2:]))
                size += len(waiting[2])
                if size > _TOGETHER:
                    yield _rows(_KINDS, out)
                    out, size = [], 0
            waiting = (name, example, text, begin, end)
        if waiting:
            out.append((*waiting[:2], True, *waiting[2:]))
            size += len(waiting[2])
    if out:
        yield _rows(_KINDS, out)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, last, formatted, loss_begin, loss_end: the expansion of all conversations (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then role and text, so repeated rows are turns that follow one another. Null
    roles and texts are empty. Rows of a null conv_id are one conversation. An empty table gives no rows. Other columns
    aren't read. A conversation's examples lie together, in order.
    """
    tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_expanded, _EXAMPLES)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_KINDS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    loss, chars, formatted = hashlib.sha256(), 0, 0
    for batch in batches:
        for name, last, text, begin, end in zip(*(batch.column(k) for k in (0, 2, 3, 4, 5)), strict=True):
            text = text.as_py()
            reply = unescape(text[begin.as_py() : end.as_py()])
            loss.update(reply.encode())
            chars += len(reply)
            formatted += len(text)
            if last.as_py():
                turns, seen = hashlib.sha256(), read_turns(text)
                for role, said in seen:
                    turns.update(f"{role}\n{said}\n".encode())
                out.append((name.as_py(), len(seen), turns.hexdigest(), chars, loss.hexdigest(), formatted))
                loss, chars, formatted = hashlib.sha256(), 0, 0
        if len(out) >= 1000:
            yield _rows(_DIGEST_KINDS, out)
            out = []
    if out:
        yield _rows(_DIGEST_KINDS, out)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what examples() gives."""
    return formatted.mapInArrow(_digested, _DIGEST)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(examples(rows.unionByName(extra)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {len(START) + len(MIDDLE) + len(END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}) AS chars,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
