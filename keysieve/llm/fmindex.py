"""FM-index over a shard of integer symbols: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

#: Every so many text positions one suffix position is stored.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling: only ties are sorted again.

    The last symbol must be the only one of its kind and the smallest.
    """
    n = len(text)
    rank = text.astype(np.int64) + 1
    width = int(rank.max()).bit_length()
    times = 63 // width
    key = np.zeros(n, np.int64)
    for j in range(times):
        key <<= width
        if j < n:
            key[: n - j] |= rank[j:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    slots = np.arange(n)
    width, depth = n.bit_length(), times
    times = max(2, 63 // width)
    while True:
        head = np.diff(ordered, prepend=-1) != 0
        first = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        rank[order[slots]] = first + 1
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = slots[tied]
        if not len(slots):
            return order
        own = order[slots]
        key = np.zeros(len(own), np.int64)
        for j in range(times):
            at = own + j * depth
            key = (key << width) | np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        turn = np.argsort(key, kind="stable")
        order[slots], ordered = own[turn], key[turn]
        depth *= times


class FMIndex:
    """Counts and finds patterns in ``text``, which ends with its only 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        self.n = len(text)
        self.last = text[order - 1]
        symbols = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.marked = order % SAMPLE == 0
        self.samples = order[self.marked]
        self.sampled = np.cumsum(self.marked) - 1
        # Wavelet matrix: for each bit from the top, zeros so far, then zeros before ones.
        self.bits = max(1, (symbols - 1).bit_length())
        self.zeros = np.zeros((self.bits, self.n + 1), np.int32)
        row = self.last
        for level in range(self.bits):
            zero = (row >> (self.bits - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            row = np.concatenate([row[zero], row[~zero]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each place."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            zeros = self.zeros[level]
            zl, za = zeros[low], zeros[at]
            low = np.where(one, zeros[-1] + low - zl, zl)
            at = np.where(one, zeros[-1] + at - za, za)
        return at - low

    def ranges(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows, symbols from the left), by backward search."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        symbols = len(self.before) - 1
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - 1 - step].astype(np.int64)
            known = symbol < symbols
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            start = self.before[symbol]
            low[live] = start + self.rank(symbol, low[live])
            high[live] = start + self.rank(symbol, high[live])
        return low, high

    def places(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots: step back through the text to a sampled one."""
        out, steps = np.zeros(len(slots), np.int64), 0
        left = np.arange(len(slots))
        while len(left):
            hit = self.marked[slots]
            out[left[hit]] = self.samples[self.sampled[slots[hit]]] + steps
            left, slots = left[~hit], slots[~hit]
            symbol = self.last[slots].astype(np.int64)
            slots = self.before[symbol] + self.rank(symbol, slots)
            steps += 1
        return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
