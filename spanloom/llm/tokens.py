"""Encoders for public vocabularies that give exactly the ids of the tokenizers library, in less time.

Texts of characters below U+0250 are merged by tiktoken, which applies the same merges; any other text, and any that
spells a special token, goes to the tokenizers library itself. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

_BEYOND_LATIN = re.compile("[^\u0000-ɏ]")
_LATIN_1 = re.compile("[\0-\u00ff]*").fullmatch
_WIDE_SPACE = re.compile(r"\s\s")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies spell bytes: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Library:
    """A tokenizer file as the tokenizers library reads it, with truncation and padding unused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = [t["content"] for t in self.spec.get("added_tokens", [])]
        self.is_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


class ByteBpe:
    """Byte-level BPE over whole texts.

    The published pattern leaves the last space of a run to the word behind it, by a lookahead that slows the matcher
    down. Texts without two white-space characters in a row never need it, and take the pattern without it.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.library = Library(path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            pattern = public_tokenizers.PATTERN
            self.fast = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.faster = tiktoken.Encoding("byte-plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or not text.isascii() and _BEYOND_LATIN.search(text) or "<|" in text and self.library.is_special(text):
            return self.library.ids(text)
        return np.array((self.fast if _WIDE_SPACE.search(text) else self.faster)(text), dtype="<u4")


class WordBpe:
    """Lower-case BPE with word ends; white space is dropped.

    Pre-tokens are runs of letters, single digits and runs of other marks: their ends follow from the classes of
    neighbouring characters. NUL is put behind each and stands for the word end in a vocabulary rewritten for it.
    """

    def __init__(self, path: str):
        import tiktoken

        self.library = Library(path)
        end, byte = self.library.spec["model"]["end_of_word_suffix"], byte_alphabet()
        ranks = {}
        for word, i in self.library.spec["model"]["vocab"].items():
            if word not in self.library.special:
                body = word.removesuffix(end)
                ranks[bytes(byte[c] for c in body) + b"\0" * (body != word)] = i
        #: NUL's own rank is free, as each merge with it comes first.
        self.fast = tiktoken.Encoding("word", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x250)]
        self.kind = np.array([0 if chr(c).isspace() and c not in range(0x1C, 0x20) else {"L": 1, "N": 2}.get(k, 3) for c, k in enumerate(kinds)], dtype=np.uint8)

    def spelled(self, low: str) -> str:
        """The pre-tokens of a lower-case text, each with NUL behind it."""
        coding, kind = ("latin-1", np.uint8) if _LATIN_1(low) else ("utf-16-le", np.dtype("<u2"))
        chars = np.frombuffer(low.encode(coding), dtype=kind)
        kinds = self.kind[chars]
        kept = np.ones((len(chars), 2), dtype=bool)
        np.not_equal(kinds, 0, out=kept[:, 0])
        np.not_equal(kinds[1:], kinds[:-1], out=kept[:-1, 1])
        kept[:, 1] |= kinds == 2
        kept[:, 1] &= kept[:, 0]
        out = np.zeros((len(chars), 2), dtype=kind)
        out[:, 0] = chars
        return out[kept].tobytes().decode(coding)

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and _BEYOND_LATIN.search(text) or "'" in text or "\0" in text or "<|" in text and self.library.is_special(text):
            return self.library.ids(text)
        low = text.lower()
        if not low.isascii() and _BEYOND_LATIN.search(low):
            return self.library.ids(text)
        return np.array(self.fast(self.spelled(low)), dtype="<u4")


@lru_cache(maxsize=4)
def byte_bpe(path: str, ranks_path: str | None) -> ByteBpe:
    return ByteBpe(path, ranks_path)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def id_bytes(path: str) -> list[bytes]:
    """Per id of a byte-level vocabulary, the bytes that it decodes to."""
    library, byte = Library(path), byte_alphabet()
    out = [b""] * library.tokenizer.get_vocab_size(with_added_tokens=True)
    for word, i in library.spec["model"]["vocab"].items():
        out[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    for t in library.spec.get("added_tokens", []):
        out[t["id"]] = t["content"].encode()
    return out
