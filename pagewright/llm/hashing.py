"""Hashes of words and shingles, and polynomial hashes of byte strings.

Words are hashed by 64 bits of BLAKE2, so different words of any length are told apart; each shingle chains its words' hashes through a
finaliser that isn't linear. The polynomial hashes (powers) are only used to find candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b" \t\n\v\f\r"
BLOCK = 1 << 19  # bytes of a long text that are cut into words at once
KNOWN_WORDS = 1 << 18  # words whose hashes a process keeps
BASE = 0x9E3779B97F4A7C15 | 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < KNOWN_WORDS and len(word) < 64:
            self[word] = value
        return value


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0], _powers[1]


def words_of(text: bytes) -> np.ndarray:
    """The hash of each maximal run of bytes that aren't white space; a long text is cut at white space, so that memory stays bounded."""
    if len(text) <= BLOCK:
        found = text.split()
        return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    out, at = [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            end = min((p for p in (text.find(c, end) for c in (SPACES[i : i + 1] for i in range(len(SPACES)))) if p >= 0), default=len(text))
        out.append(np.fromiter(map(_words.__getitem__, text[at:end].split()), np.uint64))
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each lower-cased text; fewer words give one shingle, none give none."""
    words = [words_of(t.translate(LOWER)) for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    w = np.concatenate(words) if words else np.empty(0, np.uint64)
    h = np.full(len(w), n, np.uint64)
    for j in range(n):
        part = h[: max(0, len(w) - j)]
        part[:] = mix(part * np.uint64(BASE) + w[j:])
    sets: list[np.ndarray] = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        k = hi - lo
        if k >= n:
            s = np.sort(h[lo : hi - n + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif k:
            whole = np.array([k], np.uint64)
            for x in w[lo:hi]:
                whole = mix(whole * np.uint64(BASE) + x)
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
