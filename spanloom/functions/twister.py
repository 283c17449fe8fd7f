"""The stream of the Mersenne Twister MT19937, from any place on.

A window of 624 words is the generator's state; a step drops its first word and adds one that is linear, over bits, in
the others. So the window J steps ahead is a sum of windows that lie at most 19,937 steps ahead: those that x^J, reduced
by the characteristic polynomial of the step, has. A place in the stream is reached by the jumps of its binary digits.

Polynomials over bits are Python integers, bit i for x^i. The characteristic polynomial isn't stated here: it follows
from the stream itself by the Berlekamp-Massey rule.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of the generator: words of a window, the distance of the middle word, bits of the state, and its matrix.
WORDS, MIDDLE, BITS, MATRIX = 624, 397, 19937, np.uint32(0x9908B0DF)
_UPPER, _LOWER = np.uint32(0x80000000), np.uint32(0x7FFFFFFF)


def seeded(seed: int) -> np.ndarray:
    """The window that random.Random(seed) begins with."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], dtype=np.uint32)


def extended(window: np.ndarray, n: int) -> np.ndarray:
    """The window and the n words that follow it, as the recurrence has them."""
    x = np.empty(WORDS + n, dtype=np.uint32)
    x[:WORDS] = window
    for at in range(0, n, WORDS - MIDDLE):  # what is made in a stretch of this length rests on older words only
        end = min(n, at + WORDS - MIDDLE)
        y = (x[at:end] & _UPPER) | (x[at + 1 : end + 1] & _LOWER)
        x[at + WORDS : end + WORDS] = x[at + MIDDLE : end + MIDDLE] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), MATRIX, np.uint32(0))
    return x


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The polynomial of the shortest recurrence of one bit of the stream: the characteristic one, as it has full degree."""
    bits = extended(seeded(1), 2 * BITS + 64)[WORDS:] & np.uint32(1)
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * BITS + 64].tolist()):
        seen = seen << 1 | bit  # bit i of seen is the stream's i-th bit back
        if (now & seen).bit_count() & 1:
            if 2 * length <= n:
                now, before, length, gap = now ^ before << gap, now, n + 1 - length, 1
                continue
            now ^= before << gap
        gap += 1
    # now has the recurrence by distance back; the polynomial counts the other way
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


def _reduced(p: int) -> int:
    modulus = characteristic()
    for k in range(p.bit_length() - 1, BITS - 1, -1):
        if p >> k & 1:
            p ^= modulus << (k - BITS)
    return p


_SPREAD = [sum((b >> i & 1) << 2 * i for i in range(8)).to_bytes(2, "little") for b in range(256)]


def squared(p: int) -> int:
    """p times p: over bits the exponents double."""
    return _reduced(int.from_bytes(b"".join(_SPREAD[b] for b in p.to_bytes((p.bit_length() + 7) // 8 or 1, "little")), "little"))


@lru_cache(maxsize=64)
def power(j: int) -> int:
    """x^j, reduced."""
    if j < BITS:
        return 1 << j
    half = squared(power(j // 2))
    return _reduced(half << 1) if j % 2 else half


def jumped(window: np.ndarray, polynomial: int) -> np.ndarray:
    """The window as many steps ahead as the power of x that polynomial is."""
    x = extended(window, BITS)
    bits = np.unpackbits(np.frombuffer(polynomial.to_bytes(BITS // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    out = np.zeros(WORDS, dtype=np.uint32)
    views = np.lib.stride_tricks.sliding_window_view(x, WORDS)
    for at in np.array_split(np.flatnonzero(bits), 16):
        out ^= np.bitwise_xor.reduce(views[at], axis=0)
    return out


def ladder(step: int, n: int) -> list[int]:
    """The polynomials of step, twice step, four times step, as many as numbers below n have binary digits."""
    out = [power(step)] if n > 1 else []
    while len(out) < (n - 1).bit_length():
        out.append(squared(out[-1]))
    return out


def window_of(first: np.ndarray, ladder: list[int], k: int) -> np.ndarray:
    """The window k steps of a ladder ahead."""
    for polynomial in ladder:
        if k & 1:
            first = jumped(first, polynomial)
        k >>= 1
    return first


class Numbers:
    """The numbers of 32 bits that the generator gives from a window on."""

    def __init__(self, window: np.ndarray):
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": window, "pos": WORDS}}

    def next(self, n: int) -> np.ndarray:
        return self.bits.random_raw(n)
