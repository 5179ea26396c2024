"""Suffix arrays and what stands on them, in numpy, for texts of one task."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, bits: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of symbols below ``1 << bits``, by prefix doubling. The end of the text
    ranks below every symbol. Only suffixes that still tie are sorted again, so the cost of a round
    follows what repeats. With ``depth`` suffixes that agree on so many symbols may stay tied: they
    share the rank of the first of them.
    """
    n = len(symbols)
    packed = max(1, 62 // (bits + 1))
    key = np.zeros(n, np.int64)
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(packed, np.int64)]
    for k in range(packed):
        key = key << (bits + 1) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]] if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks[order] = first
    height = packed
    slots = _tied(fresh)
    while len(slots) and (depth is None or height < depth):
        suffix = order[slots]
        after = ranks[np.minimum(suffix + height, n)]
        group = first[slots]
        again = np.lexsort((after, group))
        suffix, after, group = suffix[again], after[again], group[again]
        order[slots] = suffix
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        begin = np.maximum.accumulate(np.where(new, slots, 0))
        first[slots] = begin
        ranks[suffix] = begin
        slots = slots[_tied(new)]
        height *= 2
    return order, ranks[:n]


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Places that share a rank with a neighbour, given where ranks begin."""
    alone = fresh & np.r_[fresh[1:], True]
    return np.flatnonzero(~alone)


class WaveletMatrix:
    """Counts of symbols in prefixes of a sequence: one bit vector with running counts per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest = symbols
        for b in range(bits - 1, -1, -1):
            ones = (rest >> b) & 1
            sums = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=sums[1:])
            zeros = len(rest) - int(sums[-1])
            self.levels.append((b, sums, zeros))
            up = ones.astype(bool)
            rest = np.concatenate((rest[~up], rest[up]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(end), end.copy()
        for b, sums, zeros in self.levels:
            up = (symbol >> b & 1).astype(bool)
            a, z = sums[low], sums[high]
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + z, high - z)
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out = np.zeros_like(place)
        for b, sums, zeros in self.levels:
            one = sums[place + 1] - sums[place]
            out |= one.astype(np.int64) << b
            place = np.where(one == 1, zeros + sums[place], place - sums[place])
        return out


class FmIndex:
    """Backward search and location of phrases in symbols above 0; 0 is the end of the text."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, bits: int):
        text = np.r_[symbols.astype(np.int64), 0]
        self.n = len(text)
        order, _ = suffix_array(text, bits)
        last = text[order - 1]
        self.tree = WaveletMatrix(last, bits)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=1 << bits))]
        kept = order % self.SAMPLE == 0
        self.sampled, self.samples = kept, order[kept]
        self.sample_no = np.cumsum(kept) - 1

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases (one per row, equal length) that occur: row, first and end of their suffixes."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[row, k]
            low = self.below[symbol] + self.tree.rank(symbol, low)
            high = self.below[symbol] + self.tree.rank(symbol, high)
            found = low < high
            row, low, high = row[found], low[found], high[found]
        return row, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix in the intervals: which interval, and its place in the text."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        slot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        place = np.zeros(len(slot), np.int64)
        todo, steps = np.arange(len(slot)), 0
        while len(todo):
            here = self.sampled[slot]
            place[todo[here]] = self.samples[self.sample_no[slot[here]]] + steps
            todo, slot = todo[~here], slot[~here]
            symbol = self.tree.at(slot)
            slot = self.below[symbol] + self.tree.rank(symbol, slot)
            steps += 1
        return which, place
