"""Which of many strings stand in a text: one pass over the text at any number of strings."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

GRAM = 8  # bytes of a window; shorter strings are looked for one by one
BITS = 20  # of the table that rules out most windows
SLICE = 1 << 20  # windows that are held at once


def windows(data: bytes) -> np.ndarray:
    """Every stretch of GRAM bytes as a number."""
    n = len(data) - GRAM + 1
    out = np.empty(max(0, n), "<u8")
    for k in range(min(GRAM, len(out))):
        out[k::GRAM] = np.frombuffer(data, "<u8", (n - k + GRAM - 1) // GRAM, k)
    return out


def slots(w: np.ndarray) -> np.ndarray:
    return (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Contained:
    """Each string is found by that window of it which the fewest strings have, and then compared whole."""

    def __init__(self, strings: list[bytes]):
        places = defaultdict(list)
        for i, s in enumerate(strings):
            places[s].append(i)
        self.short = [(s, at) for s, at in places.items() if len(s) < GRAM]
        own = {s: windows(s) for s in places if len(s) >= GRAM}
        times = Counter(x for w in own.values() for x in np.unique(w).tolist())
        anchored = defaultdict(list)
        for s, w in own.items():
            k = min(range(len(w)), key=lambda k: times[int(w[k])])
            anchored[int(w[k])].append((k, s, places[s]))
        self.keys = np.array(sorted(anchored), "<u8")
        self.strings = [anchored[int(k)] for k in self.keys]
        self.table = np.zeros(1 << BITS, bool)
        self.table[slots(self.keys)] = True

    def find(self, data: bytes) -> list[int]:
        """The indexes of the strings that stand in data, in order."""
        out = [i for s, at in self.short if s in data for i in at]
        seen = set()
        for lo in range(0, len(data) - GRAM + 1, SLICE) if len(self.keys) else ():
            w = windows(data[lo : lo + SLICE + GRAM - 1])
            at = np.flatnonzero(self.table[slots(w)])
            key = np.searchsorted(self.keys, w[at]).clip(max=len(self.keys) - 1)
            good = self.keys[key] == w[at]
            for p, k in zip((at[good] + lo).tolist(), key[good].tolist()):
                for back, s, places in self.strings[k]:
                    if s not in seen and p >= back and data.startswith(s, p - back):
                        seen.add(s)
                        out += places
        return sorted(out)
