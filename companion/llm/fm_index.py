"""FM-index over the words of one shard: suffix order, wavelet ranks, sampled positions.

The indexed text is a sequence of symbol numbers in which 0 ends a run; runs
never match across a 0.  Every step works on whole numpy arrays, so a search
advances all phrases of the query set at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in lexicographic order (prefix doubling).

    Each run end compares by its own position, so two suffixes always differ
    by the end of the shorter run and the order is total."""
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends)
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        step = np.empty(n, dtype=np.int64)
        step[0] = 0
        np.cumsum(sorted_rank[1:] != sorted_rank[:-1], out=step[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank = key
        width *= 2


class WaveletMatrix:
    """Rank and access over small integers, one bit level at a time."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n = len(values)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[int] = []
        self.ones_before: list[np.ndarray] = []
        current = values.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones_before.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``position`` (element-wise)."""
        low, high = np.zeros_like(position), position
        for depth, ones in enumerate(self.ones_before):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            one_low, one_high = ones[low], ones[high]
            low = np.where(bit, self.zeros[depth] + one_low, low - one_low)
            high = np.where(bit, self.zeros[depth] + one_high, high - one_high)
        return high - low

    def access(self, position: np.ndarray) -> np.ndarray:
        value = np.zeros_like(position)
        for depth, ones in enumerate(self.ones_before):
            before = ones[position]
            bit = ones[position + 1] - before
            value = (value << 1) | bit
            position = np.where(bit, self.zeros[depth] + before, position - before)
        return value


class FMIndex:
    """Backward search and location of word phrases in one shard."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample_every: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]                 # the last symbol is a run end
        self.tree = WaveletMatrix(before, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        sampled = (order % sample_every == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all ``phrases`` (rows of equal length)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.tree.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column].astype(np.int64)
            base = self.first[symbol]
            low[alive] = base + self.tree.rank(symbol, low[alive])
            high[alive] = base + self.tree.rank(symbol, high[alive])
            found = low[alive] < high[alive]
            high[alive[~found]] = low[alive[~found]]
            alive = alive[found]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ``rows``: step back to the next sample."""
        rows = rows.astype(np.int64)
        positions = np.empty(len(rows), dtype=np.int64)
        open_rows, steps = np.arange(len(rows)), 0
        while len(open_rows):
            at = rows[open_rows]
            done = self.sampled[at]
            positions[open_rows[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_rows, at = open_rows[~done], at[~done]
            symbol = self.tree.access(at)
            rows[open_rows] = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return positions
