"""Monotone integer sequences in Elias-Fano form, built and searched with array operations."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each value, one after the other, in 64-bit words (and a spare one)."""
    words = np.zeros((len(values) * bits >> 6) + 2, _U)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    for number, part in ((word, values << shift), (word + 1, np.where(shift > 0, values >> ((_U(64) - shift) & _U(63)), _U(0)))):
        first = np.flatnonzero(np.diff(number, prepend=-1))
        words[number[first]] |= np.bitwise_or.reduceat(part, first)
    return words


class EliasFano:
    """``n`` sorted values (unsigned 64-bit) from ``base``; low bits packed, high bits in unary."""

    def __init__(self, n: int, base: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.base, self.bits, self.low, self.high = n, base, bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        x = values.astype(_U) - _U(base)
        span = int(x[-1]) + 1 if n else 1
        bits = max(0, (span // max(1, n)).bit_length() - 1)
        above = (x >> _U(bits)).astype(np.int64)
        ones = np.zeros(n + (int(above[-1]) if n else 0) + 1, bool)
        ones[above + np.arange(n)] = True
        low = x & _U((1 << bits) - 1)
        return cls(n, base, bits, _packed(low, bits), np.packbits(ones))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        second = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | second) & _U((1 << self.bits) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[:self.n]
        above = (ones - np.arange(self.n)).astype(_U)
        return ((above << _U(self.bits)) | self._low(np.arange(self.n))) + _U(self.base)

    def successors(self, wanted: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= ``wanted`` among the places start..end, and whether it is equal."""
        wanted = wanted.astype(_U)
        if not self.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        zeros = np.flatnonzero(np.unpackbits(self.high, count=None) == 0)
        buckets = int(np.searchsorted(zeros - np.arange(len(zeros)), self.n))  # zeros that stand before the last one
        below = wanted < _U(self.base)
        x = np.where(below, _U(0), wanted - _U(self.base))
        above = x >> _U(self.bits)  # may need all 64 bits
        beyond = above > _U(buckets)
        above = np.minimum(above, _U(buckets)).astype(np.int64)
        starts = np.concatenate([[0], zeros[:buckets] - np.arange(buckets)])
        ends = np.append(starts[1:], self.n)
        a, b = starts[above], ends[above]
        a, b = np.where(beyond, self.n, a), np.where(beyond, self.n, b)
        if start is not None:
            a, b = np.maximum(a, start), np.maximum(np.maximum(a, start), np.minimum(b, end))
        target, stop = x & _U((1 << self.bits) - 1), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < target[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        found = np.zeros(len(x), bool)
        inside = np.flatnonzero((a < stop) & ~below & ~beyond)
        found[inside] = self._low(a[inside]) == target[inside]
        return a, found

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.bits], np.int64), "base": np.array([self.base], _U), "low": self.low, "high": self.high}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["head"][0]), int(a["base"][0]), int(a["head"][1]), a["low"], a["high"])
