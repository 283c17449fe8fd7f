"""Calls of a chat or embedding model from executors, by an injected client; every attempt is kept in the row."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def chat(self, messages: list[dict]) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class RetryableError(Exception):
    """A rate limit, a server error, a lost connection or a timeout."""


class FakeClient:
    """A deterministic client: answers and vectors follow from the request's hash."""

    def __init__(self, dimensions: int = 8, fail_first: int = 0, answer: Callable[[list[dict]], str] | None = None):
        self.dimensions, self.fail_first, self.answer = dimensions, fail_first, answer

    def chat(self, messages: list[dict]) -> str:
        if len(messages) <= self.fail_first:
            return "not json"
        if self.answer:
            return self.answer(messages)
        return json.dumps({"digest": hashlib.sha256(json.dumps(messages).encode()).hexdigest()[:8]})

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 + 1e-3 for b in hashlib.sha256(t.encode()).digest()[: self.dimensions]] for t in texts]


def retried(call: Callable[[], str], attempts: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """The result and the number of attempts; waits twice as long each time, 16 seconds at most. Only RetryableError is retried."""
    for n in range(1, attempts + 1):
        try:
            return call(), n
        except RetryableError:
            if n == attempts:
                raise
            sleep(min(16.0, pause * 2 ** (n - 1)))
    raise ValueError("attempts must be positive")


def request_sha256(messages: list[dict], schema: dict | None = None) -> str:
    """Of the messages, and of the response schema if the request has one."""
    request = messages if schema is None else {"messages": messages, "schema": schema}
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _repaired(messages: list[dict], answer: str, error: str) -> list[dict]:
    return [*messages, {"role": "assistant", "content": answer}, {"role": "user", "content": f"Repair: {error[:800]}"}]


_RAW = "id long, status string, content string, n_attempts int, request_sha256 array<string>, error string, answers array<string>, errors array<string>"


def converse(prompts: DataFrame, make_client: Callable[[], Client], parse: Callable[[str], str | None], repairs: int = 2, schema: dict | None = None) -> DataFrame:
    """id, status, content, n_attempts, request_sha256, error, answers, errors: a call for each row (id, prompt), repaired while parse gives an error.

    A failure is a row, not an exception, so one answer doesn't fail the job. The client is made once a task. Every
    attempt leaves its request's hash and, unless the call itself failed, its answer and what parse said of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            out = []
            for name, prompt in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                messages, hashes, answers, errors, status, error = [{"role": "user", "content": prompt}], [], [], [], "failed", None
                for _ in range(1 + repairs):
                    hashes.append(request_sha256(messages, schema))
                    try:
                        answer, _n = retried(lambda m=messages: client.chat(m), sleep=lambda s: None)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        break
                    error = parse(answer)
                    answers.append(answer)
                    errors.append(error)
                    if error is None:
                        status = "complete"
                        break
                    messages = _repaired(messages, answer, error)
                out.append((name, status, answers[-1] if answers else None, len(hashes), hashes, error, answers, errors))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _RAW.split(", ")])

    return prompts.select("id", "prompt").mapInArrow(run, _RAW)


def chain_error(prompt: str, row: dict, parse: Callable[[str], str | None] | None = None, repairs: int = 2, schema: dict | None = None, allow_failed: bool = True) -> str | None:
    """Why row can't be what converse() makes of prompt; None if it can. Each request, each error and the final state are replayed."""
    hashes, answers, errors = row["request_sha256"] or [], row["answers"] or [], row["errors"] or []
    if not 1 <= len(hashes) <= 1 + repairs or row["n_attempts"] != len(hashes) or len(answers) != len(errors) or not len(hashes) - 1 <= len(answers) <= len(hashes):
        return "attempts"
    messages = [{"role": "user", "content": prompt}]
    for k, sent in enumerate(hashes):
        if sent != request_sha256(messages, schema):
            return "request"
        if k == len(answers):
            break
        if parse is not None and parse(answers[k]) != errors[k]:
            return "parse"
        if errors[k] is None:
            if k + 1 < len(hashes):
                return "attempts"
        else:
            messages = _repaired(messages, answers[k], errors[k])
    called = len(answers) == len(hashes)
    if row["status"] != ("complete" if called and errors[-1] is None else "failed") or row["content"] != (answers[-1] if answers else None):
        return "final state"
    if called and (row["error"] != errors[-1] or errors[-1] is not None and len(hashes) <= repairs) or not called and not row["error"]:
        return "final state"
    return None if allow_failed or row["status"] == "complete" else "failed"


def replay_errors(raw: DataFrame, prompts: DataFrame, parse: Callable[[str], str | None] | None = None, repairs: int = 2, schema: dict | None = None, allow_failed: bool = True) -> DataFrame:
    """id, reason: rows whose attempt chain can't be what converse() makes, rows without a prompt, and prompts without a row."""
    fields = ("status", "content", "n_attempts", "request_sha256", "error", "answers", "errors")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for row in b.to_pylist():
                reason = "no prompt" if row["asked"] is None else "no answer" if row["made"] is None else chain_error(row["prompt"], row, parse, repairs, schema, allow_failed)
                if reason:
                    bad.append((row["id"], reason))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in bad], pa.int64()), pa.array([x[1] for x in bad], pa.string())], ["id", "reason"])

    asked = prompts.select("id", "prompt", F.lit(True).alias("asked"))
    return asked.join(raw.select("id", *fields, F.lit(True).alias("made")), "id", "full_outer").mapInArrow(check, "id long, reason string")


def embedded(items: DataFrame, cache: DataFrame, make_client: Callable[[], Client], batch_size: int = 20) -> DataFrame:
    """id, v for items (id, sha, text): from cache (sha, v), else one call for each distinct text."""
    missing = items.select("sha", "text").dropDuplicates(["sha"]).join(cache.select("sha"), "sha", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            sha, text = (batch.column(k).to_pylist() for k in range(2))
            vectors = [v for a in range(0, len(text), batch_size) for v in client.embed(text[a : a + batch_size])]
            yield pa.RecordBatch.from_arrays([pa.array(sha), pa.array(vectors, pa.list_(pa.float64()))], ["sha", "v"])

    made = missing.mapInArrow(run, "sha string, v array<double>")
    return items.select("id", "sha").join(cache.select("sha", "v").unionByName(made), "sha").select("id", "v")
