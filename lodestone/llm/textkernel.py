"""Vectorised word scanning and hashing of UTF-8 bytes.

A word's hash is a polynomial in a random byte table modulo 2**64, taken from one running sum over the text;
n-gram hashes are polynomials in word hashes, mixed. Two different n-grams of one corpus of 10**9 distinct ones
share a hash with a probability near 3 %, and a pair of documents is affected only if it holds both."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))  # fixed: all executors draw the same table
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = U(0xD6E8FEB86659FD93)
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(n: int, inverse: bool) -> np.ndarray:
    if len(_powers[inverse]) < n:
        base = np.full(max(n, 1 << 16), _P_INV if inverse else _P)
        base[0] = 1
        _powers[inverse] = np.cumprod(base, dtype=np.uint64)
    return _powers[inverse][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans(text: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~separators[text]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * _power(len(text), False), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(len(text), True)[starts] + (ends - starts).astype(np.uint64))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * _Q + words[j : j + size]
    return mix(h + U(n))
