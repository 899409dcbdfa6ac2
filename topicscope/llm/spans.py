"""Vectorised work on the texts of one Arrow batch: code points, runs, span hashes, a hash index.

These are small numpy helpers that run inside Spark tasks; Spark deals out the rows.

A span hash is a polynomial of per-character random 64-bit values modulo 2**64, mixed and keyed by
the span's length.  Two given different spans share a hash with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Code points that are worked on at once (a longer text is a group of its own).
GROUP_CHARS = 1 << 20
_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: high multiplicative order, invertible


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_tables: dict[str, np.ndarray] = {}


def _char_values() -> np.ndarray:
    if "char" not in _tables:
        _tables["char"] = mix64(np.arange(1, 0x110001, dtype=_U) * _U(_BASE))
    return _tables["char"]


def word_chars() -> np.ndarray:
    """For each code point: whether it is a letter or a number."""
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _tables["alnum"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, _U)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=_U)
    return _tables["pow"], _tables["inv"]


def text_groups(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges (lo, hi) of whole texts of at most ``limit`` code points together, or of one text."""
    lo = size = 0
    for k, text in enumerate(texts):
        if k > lo and size + len(text) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and where each text starts (one entry more)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def runs(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's start."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.zeros(len(mask) + 1, bool)
    first[starts] = True
    opened = mask.copy()
    opened[1:] &= ~mask[:-1] | first[1:-1]
    closed = mask.copy()
    closed[:-1] &= ~mask[1:] | first[1:-1]
    return np.flatnonzero(opened), np.flatnonzero(closed) + 1


def span_hashes(cps: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A nonzero 64-bit hash for each span [begin, end)."""
    power, inverse = _powers(len(cps) + 1)
    total = np.zeros(len(cps) + 1, _U)
    np.cumsum(_char_values()[cps] * power[: len(cps)], out=total[1:])
    h = (total[ends] - total[begins]) * inverse[begins]
    h = mix64(h ^ ((ends - begins).astype(_U) * _U(0xD6E8FEB86659FD93)))
    h[h == 0] = 1
    return h


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` word hashes (windows may cross texts; callers cut them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _U(0xD1342543DE82EF95)
        h += words[k : k + n]
    return mix64(h)


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and numbers of the lower-cased texts): hash, length, first word of each text."""
    cps, starts = code_points([t.lower() for t in texts])
    begins, ends = runs(word_chars()[cps], starts)
    return span_hashes(cps, begins, ends), ends - begins, np.searchsorted(begins, starts)


class HashIndex:
    """Open-addressing map from nonzero 64-bit hashes to the numbers 0, 1, 2, ... in order of arrival."""

    def __init__(self, bits: int = 16):
        self._alloc(bits)
        self.size = 0

    def _alloc(self, bits: int) -> None:
        self._shift, self._mask = _U(64 - bits), (1 << bits) - 1
        self._keys = np.zeros(1 << bits, _U)
        self._vals = np.full(1 << bits, -1, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * _U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for an unknown one."""
        out = np.full(len(h), -1, np.int32)
        rest, slot = np.arange(len(h)), self._slots(h)
        while len(rest):
            seen = self._keys[slot]
            hit = seen == h
            out[rest[hit]] = self._vals[slot[hit]]
            on = ~hit & (seen != 0)
            rest, h, slot = rest[on], h[on], (slot[on] + 1) & self._mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct, absent hashes."""
        if 2 * (self.size + len(h)) > len(self._keys):
            used = self._keys != 0
            keys, vals = self._keys[used], self._vals[used]
            bits = int(np.ceil(np.log2(2.5 * (self.size + len(h)))))
            self._alloc(max(16, bits))
            self._place(keys, vals)
        self._place(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)

    def _place(self, keys: np.ndarray, vals: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self._keys[slot[won]], self._vals[slot[won]] = keys[won], vals[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, vals, slot = keys[left], vals[left], (slot[left] + 1) & self._mask


def gather_ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(begins - (ends - lengths), lengths)


def sorted_groups(batches: Iterable, keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Groups of rows that are sorted by the first ``keys`` columns, also across Arrow batches.

    Yields the key and the other columns as numpy arrays.  A group is held whole; callers deal a large
    group out in blocks beforehand.
    """
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:]):
            now = tuple(c[lo] for c in cols[:keys])
            if now != key:
                if parts:
                    yield key, [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts)]
                key, parts = now, []
            parts.append([c[lo:hi] for c in cols[keys:]])
    if parts:
        yield key, [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts)]
