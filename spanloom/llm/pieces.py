"""SentencePiece BPE by backtracking over longest matches.

A merge-type encoding is the one sequence of pieces that covers the text and in which every two neighbours are
compatible: merging the characters of both, best score first and leftmost among equals, gives just these two again. So
no merges are made over the whole text. An Aho-Corasick automaton tells the longest piece at each place; pieces are
taken from left to right, longest first, if they are compatible with the piece before. Where nothing fits, the last
piece is taken back and its next shorter prefix tried. A position that was reached once and failed fails always, since
the pieces that lead to it are the encoding of the text before it and there is only one; a bitfield remembers these
positions, so each is left once at most.

Neighbours are merged again once a worker and remembered. Where no piece holds a character in front of a space mark,
no token crosses such a place: the text falls into words, and a worker remembers the ids of those that it has met,
within a bound.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, text_udf, tune
from .tokens import vocabulary_path

SPACE = "▁"
#: Characters of words that a worker remembers before it starts anew, the longest word that it remembers, and pairs of pieces.
REMEMBERED, LONGEST, PAIRS = 4 << 20, 64, 1 << 19


class Pieces:
    """A SentencePiece model of merge type: its normalizer and decoder as the library has them, and its pieces with scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.of_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
        if len(self.of_byte) != 256 or any(model.is_unused(i) for i in size):
            raise ValueError("only models with all byte pieces and no unused ones are supported")
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.id), p[:1]) for p in self.id if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        alone = "".join(c for c in "\n\t" if not any(c in p and p != c for p in self.id))
        self.words = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if words else lambda text: [text]
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.text_of = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode() for i in size]
        self.decimal = [str(i) for i in size]

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged: the best score first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, one: str, two: str) -> bool:
        """Whether two pieces stay as they are beside each other; with nothing before, whether the second is made by merges at all."""
        fits = self.fits.get((one, two))
        if fits is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fits = self.fits[one, two] = self.merged(one + two) == ([one, two] if one else [two])
        return fits

    def split(self, text: str) -> list[str]:
        """The pieces of a text, characters that are no piece among them."""
        longest = {}
        for end, p in self.automaton.iter(text):
            longest[end + 1 - len(p)] = p  # ends rise, so the last is the longest
        failed = bytearray(len(text) // 8 + 1)
        taken: list[str] = []
        at, before, p = 0, "", longest.get(0, text[:1])
        while at < len(text):
            while p:
                end = at + len(p)
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(before, p):
                    break
                p = self.shorter.get(p)
            if p:
                taken.append(p)
                at, before = end, p
                p = longest.get(at, text[at : at + 1])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= len(last)
                before, p = taken[-1] if taken else "", self.shorter.get(last)
        return taken

    def word(self, text: str) -> bytes:
        ids: list[int] = []
        for p in self.split(text):
            i = self.id.get(p)
            if i is None:
                ids += [self.of_byte[b] for b in p.encode()]
            else:
                ids.append(i)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without begin and end."""
        out, known = [], self.known
        for w in self.words(self.library.normalize(text)):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= LONGEST:
                    if self.size > REMEMBERED:
                        known.clear()
                        self.size = 0
                    known[w] = ids
                    self.size += len(w)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """What the library decodes: the first space mark goes, control pieces are empty, byte pieces are their bytes."""
        text = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One for each worker process, so that words and pairs are known from task to task."""
    return Pieces(path)


_ROW = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def coder(model: str):
    """Column function: text to struct<n_tokens, ids_sha256, decoded_sha256> of its encoding and that encoding's decoding."""

    def prepare():
        pieces = pieces_of(model)

        def row(text: str | None) -> dict:
            ids = pieces.encode(text or "")
            decimal = ",".join(map(pieces.decimal.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
            return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(decimal.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(pieces.decode(ids).encode()).hexdigest()}

        return lambda texts: [row(t) for t in texts]

    return text_udf(prepare, "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>", _ROW)


def encoder(model: str):
    """Column function: text to binary, its ids as little-endian unsigned 32-bit integers; a null text has none."""

    def prepare():
        pieces = pieces_of(model)
        return lambda texts: [pieces.encode(t or "") for t in texts]

    return text_udf(prepare, "binary", pa.binary())


def decoder(model: str):
    """Column function: binary of ids to text; null stays null."""

    def prepare():
        pieces = pieces_of(model)
        return lambda values: [None if v is None else pieces.decode(v) for v in values]

    return text_udf(prepare, "string", pa.string())


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; only doc_id and text are read.

    Null texts are empty: no ids. Texts of any length are encoded whole, without recursion. Repeated rows each have
    their row; a null doc_id stays null; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", coder(model)(F.col("text")).alias("coded")).select("doc_id", "coded.*")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
