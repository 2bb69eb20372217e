"""Sorting suffixes by their first ``length`` bytes with hash comparisons, many small groups at once.

Prefix sums of a polynomial hash (modulo 2**64, random byte values) give the hash of any
substring. Two suffixes are compared by a binary search for their longest common extension
(equal hashes of 256, 128, ... bytes) and the byte after it: a number of steps logarithmic in
the length. A bottom-up mergesort of all groups places each suffix by its rank in the other
half. Neighbours whose whole length has equal hashes are compared byte by byte before they
count as equal; if a collision shows, that group is compared by its bytes alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(maxsize=2)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 2**log_size of each."""
    def series(base: int) -> np.ndarray:
        out = np.ones(1 << log_size, _U)
        for k in range(log_size):
            out[1 << k:2 << k] = out[:1 << k] * _U(pow(base, 1 << k, 1 << 64))
        return out
    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


class PrefixHashes:
    """``of(start, length)``: hashes of substrings of ``data``, equal for equal ones wherever they stand.

    ``place`` counts the bytes of ``data``, from 0 on in each of several texts if substrings stay
    inside one (then the powers needed are those of the longest text only).
    """

    def __init__(self, data: np.ndarray, place: np.ndarray | None = None):
        self.place = np.arange(len(data) + 1) if place is None else place
        power, self.inverse = _powers(20 if place is None and len(data) < 1 << 20 else max(10, int(self.place.max(initial=0)).bit_length()))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * power[self.place[:len(data)]], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[self.place[start]]

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, in order of their start."""
        return (self.sums[length:] - self.sums[:len(self.sums) - length]) * self.inverse[:len(self.sums) - length]


def _less(data: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, length: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether the suffix at a comes before the one at b (or is equal, where asked)."""
    out = or_equal.copy()
    open_ = np.flatnonzero(hashes.of(a, length) != hashes.of(b, length))
    x, y = a[open_], b[open_]
    common, step = np.zeros(len(open_), np.int64), 1 << (length - 1).bit_length()
    while step > 1:
        step >>= 1
        fits = common + step <= length
        same = fits & (hashes.of(x + common, np.where(fits, step, 0)) == hashes.of(y + common, np.where(fits, step, 0)))
        common += np.where(same, step, 0)
    common = np.minimum(common, length - 1)
    out[open_] = data[x + common] < data[y + common]
    return out


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, group: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes, by group and then by their first ``length`` bytes; ``group`` is sorted."""
    order = np.arange(len(start))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(first, append=len(group))
    begin, many = np.repeat(first, size), np.repeat(size, size)
    inside = np.arange(len(start)) - begin
    width = 1
    while len(size) and width < size.max():
        active = np.flatnonzero(many > width)  # groups that are sorted already stay as they are
        half = inside[active] // width
        left = half % 2 == 0
        base = begin[active] + (half ^ 1) * width  # the other half
        end = np.minimum(base + width, begin[active] + many[active])
        low, high = np.minimum(base, end), end.copy()
        suffix = start[order[active]]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) >> 1
            # equal suffixes keep their order: the left half's come first
            before = _less(data, hashes, start[order[mid]], suffix[todo], length, ~left[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        rank = low - np.minimum(base, end)
        own = inside[active] - half * width
        place = begin[active] + np.where(left, half, half - 1) * width + own + rank
        new = order.copy()
        new[place] = order[active]
        order, width = new, width * 2
    return order


def repeated(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: int, hashes: PrefixHashes | None = None) -> np.ndarray:
    """For suffixes sorted by group: whether another one of the group begins with the same ``length`` bytes."""
    hashes = hashes or PrefixHashes(data)
    order = sort_suffixes(data, hashes, group, start, length)
    sorted_group, at = group[order], start[order]
    whole = hashes.of(at, length)
    equal = (sorted_group[1:] == sorted_group[:-1]) & (whole[1:] == whole[:-1])
    pairs = np.flatnonzero(equal)
    wrong = np.zeros(len(pairs), bool)
    span = np.arange(length)
    for a in range(0, len(pairs), 4096):
        part = pairs[a:a + 4096]
        wrong[a:a + 4096] = (data[at[part][:, None] + span] != data[at[part + 1][:, None] + span]).any(axis=1)
    both = np.zeros(len(start), bool)
    both[order[:-1][equal]] = True
    both[order[1:][equal]] = True
    for g in np.unique(sorted_group[pairs[wrong]]).tolist():
        own = np.flatnonzero(group == g)
        _, place, times = np.unique(np.array([data[s:s + length].tobytes() for s in start[own].tolist()], dtype=object), return_inverse=True, return_counts=True)
        both[own] = times[place] > 1
    return both
