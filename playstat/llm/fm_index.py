"""FM-index over a shard of word ids: suffix array, wavelet matrix, sampled positions.

Everything is batched: one call searches many phrases, one call locates many
suffix-array rows.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` by prefix doubling; a shorter suffix sorts first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[:-width] = rank[width:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        if fresh[order[-1]] == n:
            return order
        rank, width = fresh, width * 2


class WaveletMatrix:
    """rank(symbol, i): how often symbol stands in the first i entries."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = []
        current = values
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = ((current >> bit) & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = int(len(values) - before[-1])
            self.levels.append((bit, before, zeros))
            current = np.concatenate((current[~ones], current[ones]))
        self.origin = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols, at):
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.origin[symbols]


class FMIndex:
    """Index of ``text`` (ids from 1; 0 separates runs and never matches)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        # one end mark, smaller than all and unlike the separators, makes the walk back exact
        closed = np.concatenate((np.asarray(text) + 1, [0])).astype(np.int64)
        n_symbols += 1
        order = suffix_array(closed)
        self.n = len(closed)
        self.last = closed[order - 1]
        counts = np.bincount(closed, minlength=n_symbols)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletMatrix(self.last, n_symbols)
        sampled = order % SAMPLE_EVERY == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.sampled = sampled
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (one a row).

        Returns the rows of ``phrases`` that occur, and their suffix ranges."""
        alive = np.arange(len(phrases))
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j] + 1
            low = self.before[c] + self.tree.rank(c, low)
            high = self.before[c] + self.tree.rank(c, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to sampled ones."""
        at = rows.astype(np.int64)
        found = np.full(len(rows), -1, np.int64)
        steps, todo = 0, np.arange(len(rows))
        while len(todo):
            here = self.sampled[at]
            found[todo[here]] = self.samples[self.sample_rank[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.last[at]
            at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return found


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [low, high), and the range each belongs to."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    first = np.cumsum(size) - size
    return np.arange(len(owner)) - first[owner] + low[owner], owner
