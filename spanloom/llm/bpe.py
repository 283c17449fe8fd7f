"""BPE by content-defined chunks, encoded once and joined by repair.

A rolling hash over the last ROLL characters cuts texts where their content says so, so passages shared by documents
fall into the same chunks; a worker encodes each chunk once and keeps it, over all its tasks, within a bound. A cut may fall inside a
pre-token. So a chunk keeps only the ids between its anchors, places where any encoding of any text around it must
begin a token: white space behind a character that isn't, or an ideographic mark behind an ideograph. What lies from the last anchor before a
cut to the first one behind it is encoded again; without an anchor the window widens chunk by chunk until both sides
agree, at the latest at the ends of the text. The ids then are exactly those of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, text_udf, tune
from .tokens import byte_bpe, id_bytes, vocabulary_path

ROLL = 16
#: A chunk has at least LEAST characters, MOST at most, and about LEAST + MEAN.
LEAST, MEAN, MOST = 64, 256, 4096
#: Characters that are hashed at a time: it bounds memory for very long texts.
SLICE = 1 << 20
#: Characters of chunks that a worker remembers before it starts anew.
REMEMBERED = 16 << 20

_ANCHOR = re.compile(r"(?<=\S)[ \t\n\r]|(?<=[一-鿪ぁ-ゖァ-ヺ])[。、，！？]")
#: Characters at the end of a chunk where its last anchor is looked for.
TAIL = 64
_MULTIPLIER = 0x9E3779B1


def _candidates(text: str):
    """Places where the hash of the ROLL characters before is one of MEAN values."""
    for a in range(0, len(text), SLICE):
        begin = max(0, a - ROLL)
        h = np.frombuffer(text[begin : a + SLICE].encode("utf-32-le", "replace"), dtype="<u4") * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        step, power = 1, _MULTIPLIER
        while step < ROLL:  # the hash of 2 * step characters from two of step
            h[step:] = h[step:] + h[:-step] * np.uint32(power)
            step, power = 2 * step, power * power & 0xFFFFFFFF
        h = h * np.uint32(0xC2B2AE35)
        for k in (np.flatnonzero(h >> np.uint32(24) == 0) + begin + 1).tolist():
            if k > a or a == 0:
                yield k


def cuts(text: str) -> list[int]:
    """The ends of the chunks of a text."""
    out, last = [], 0
    for k in _candidates(text):
        while k - last > MOST:
            last += MOST
            out.append(last)
        if k - last >= LEAST and k < len(text):
            out.append(k)
            last = k
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    return out + [len(text)] if text else []


class Codec:
    def __init__(self, vocabulary: str, ranks: str | None):
        self.encoder = byte_bpe(vocabulary, ranks)
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, int, bytes]] = {}
        self.size = self.reused = self.encoded = 0
        self._bytes: list[bytes] | None = None

    def chunk(self, text: str) -> tuple[int, int, bytes]:
        """First and last anchor and the ids between; 0, 0 and nothing for a chunk without anchor."""
        got = self.known.get(text)
        if got is not None:
            self.reused += 1
            return got
        self.encoded += 1
        first = _ANCHOR.search(text)
        if first is None:
            got = (0, 0, b"")
        else:
            a = b = first.start()
            for last in _ANCHOR.finditer(text, max(a, len(text) - TAIL)):
                b = last.start()
            got = (a, b, self.encoder.ids(text[a:b]).tobytes())
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        self.known[text] = got
        self.size += len(text)
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        open_from = last = 0
        for end in cuts(text):
            first, final, ids = self.chunk(text[last:end])
            if final:  # an anchor is never a chunk's first character
                out.append(self.encoder.ids(text[open_from : last + first]).tobytes())
                out.append(ids)
                open_from = last + final
            last = end
        out.append(self.encoder.ids(text[open_from:]).tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """What the library decodes, special tokens included."""
        if self._bytes is None:
            self._bytes = id_bytes(self.vocabulary)
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(vocabulary: str, ranks: str | None) -> Codec:
    """One for each worker process, so that chunks are known from task to task."""
    return Codec(vocabulary, ranks)


_ROW = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def coder(vocabulary: str, ranks: str | None):
    """Column function: text to struct<n_tokens, ids_sha256, decoded_sha256> of its encoding and that encoding's decoding."""

    def prepare():
        codec = codec_of(vocabulary, ranks)

        def row(text: str | None) -> dict:
            ids = codec.encode(text or "")
            return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(codec.decode(ids).encode()).hexdigest()}

        return lambda texts: [row(t) for t in texts]

    return text_udf(prepare, "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>", _ROW)


def encoder(vocabulary: str, ranks: str | None):
    """Column function: text to binary, its ids as little-endian unsigned 32-bit integers."""

    def prepare():
        codec = codec_of(vocabulary, ranks)
        return lambda texts: [codec.encode(t or "") for t in texts]

    return text_udf(prepare, "binary", pa.binary())


def encode_and_decode(docs: DataFrame, vocabulary: str, ranks: str | None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; only doc_id and text are read.

    Null texts are empty: no ids. Repeated rows each have their row; a null doc_id stays null; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", coder(vocabulary, ranks)(F.col("text")).alias("coded")).select("doc_id", "coded.*")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"))
