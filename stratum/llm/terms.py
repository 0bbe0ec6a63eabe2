"""Hashed terms of a text, computed with array operations on its UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, ``_`` and bytes above 127,
after lower-casing the whole text.  The hash of bytes s..e is
``(P[e] - P[s]) * r**-s`` with the running sum ``P`` of ``T[byte] * r**i``
(modulo 2**64, r odd): every word and every prefix of a word comes from one pass.
"""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_T = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: bytes of a word: ASCII letters, digits, underscore, all above 127; or all but ASCII blanks
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
UNBLANK = np.ones(256, bool)
UNBLANK[[32, *range(9, 14)]] = False


class Terms:
    """Word (and word-prefix) slots of a text; tables grow to the longest text seen."""

    def __init__(self, bits: int, prefixes: tuple[int, ...] = (), inside: np.ndarray = LETTERS):
        self.shift, self.prefixes, self.inside = np.uint64(64 - bits), prefixes, inside
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.power) < n:
            n = 1 << n.bit_length()
            for name, r in (("power", _R), ("inverse", _RINV)):
                a = np.full(n, np.uint64(r), np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def slot(self, h: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (h + np.uint64(salt)) * _MIX
        h ^= h >> np.uint64(32)
        return ((h * _MIX) >> self.shift).astype(np.int32)

    def name(self, text: str) -> int:
        """The slot of a named feature."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self._grow(len(b) + 1)
        return int(self.slot(np.array([(_T[b] * self.power[:len(b)]).sum(dtype=np.uint64)], np.uint64), 1)[0])

    def _runs(self, data: np.ndarray):
        n = len(data)
        self._grow(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = self.inside[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_T[data] * self.power[:n], out=total[1:])
        return s, e, total, total[s], self.inverse[s]

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words, in text order."""
        _, e, total, at, inv = self._runs(data)
        return mix((total[e] - at) * inv)

    def words(self, lowered: np.ndarray):
        """(starts, ends, word slots, prefix slots) of lower-cased UTF-8 bytes."""
        s, e, total, at, inv = self._runs(lowered)
        full = self.slot((total[e] - at) * inv)
        cut = [self.slot((total[s[k] + p] - at[k]) * inv[k], p + 1) for p in self.prefixes
               if len(k := np.flatnonzero(e - s > p))]
        return s, e, full, cut


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (of many short arrays, faster than np.unique)."""
    a = np.sort(a)
    first = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=first[1:])
    return a[first]


def lowered(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
