"""A compressed index of one shard: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Everything is vectorised over many searches at once; one instance lives inside one task.
"""

from __future__ import annotations

import numpy as np

WORD_BITS = 64


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling what is compared.

    Equal ones come in any order, which counts of patterns up to that length do not depend on.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    width = max(1, int(symbols.max()).bit_length())
    packed = max(1, 62 // width)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key = (key << width) | padded[j:j + n]
    reached = packed
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if reached >= depth or rank[order[-1]] == n - 1:
            return order
        # What follows after the symbols compared so far; past the end comes first.
        later = np.zeros(n, np.int64)
        later[:max(0, n - reached)] = rank[reached:] + 1
        key = rank * (n + 1) + later
        reached *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        size = -(-(len(bits) + 1) // WORD_BITS) * WORD_BITS
        padded = np.zeros(size, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        at, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        symbols = np.arange(sigma)
        self.first = self._descend(symbols, np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbols >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position i."""
        return self._descend(symbols, i) - self.first[symbols]


class FMIndex:
    """symbols: texts one after another, each followed by 0; other symbols are 1 .. sigma - 1.

    weights: how often the text of each position occurs. depth: the longest pattern to be searched.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, weights: np.ndarray, depth: int):
        order = suffix_order(symbols, depth)
        self.size = len(symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        self.bwt = WaveletMatrix(symbols[order - 1], sigma)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after putting a symbol before each pattern."""
        both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.smaller[symbols]
        return base + both[:len(low)], base + both[len(low):]

    def reach(self, texts: np.ndarray, lanes: np.ndarray, right: np.ndarray, least: int, stop: np.ndarray | None = None
              ) -> np.ndarray:
        """Search backwards from position right of each lane's text while the pattern occurs ``least`` times or more.

        The leftmost position that still does; right + 1 if not even one symbol does. stop: go no further left.
        """
        at = right.astype(np.int64).copy()
        stop = np.zeros(len(lanes), np.int64) if stop is None else stop
        active = np.flatnonzero(at >= stop)
        low, high = np.zeros(len(active), np.int64), np.full(len(active), self.size, np.int64)
        while len(active):
            low, high = self.extend(low, high, texts[lanes[active], at[active]])
            found = self.weight[high] - self.weight[low] >= least
            active, low, high = active[found], low[found], high[found]
            at[active] -= 1
            going = at[active] >= stop[active]
            active, low, high = active[going], low[going], high[going]
        return at + 1


def repeated_windows(index: FMIndex, texts: np.ndarray, lengths: np.ndarray, window: int, least: int = 2) -> np.ndarray:
    """Which windows of each text occur ``least`` times or more: a row of flags per text, by window start.

    The matching statistic of a right end is how far to the left a search from it gets. Where it stops at a position,
    every window that ends at or after the right end and holds that position is out; the furthest right end that takes
    the position in is found by halving, and the search goes on from there.
    """
    flags = np.zeros((len(texts), max(1, texts.shape[1])), bool)
    lanes = np.flatnonzero(lengths >= window)
    right = lengths[lanes] - 1
    starts = np.arange(flags.shape[1])
    while len(lanes):
        left = index.reach(texts, lanes, right, least)
        flags[lanes] |= (starts >= left[:, None]) & (starts <= (right - window + 1)[:, None])
        going = left > 0
        lanes, right, failed = lanes[going], right[going], left[going] - 1
        # The largest end in [low, high] for which failed .. end occurs often enough; low - 1 if there is none.
        low, high = np.maximum(failed, window - 1), right - 1
        none = low - 1
        best = none.copy()
        while True:
            open_ = np.flatnonzero(low <= high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            fits = index.reach(texts, lanes[open_], middle, least, failed[open_]) <= failed[open_]
            best[open_[fits]] = middle[fits]
            low[open_[fits]] = middle[fits] + 1
            high[open_[~fits]] = middle[~fits] - 1
        # Without such an end, only windows wholly left of the position remain.
        right = np.where(best > none, best, np.minimum(failed, right) - 1)
        going = right >= window - 1
        lanes, right = lanes[going], right[going]
    return flags
