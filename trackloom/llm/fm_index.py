"""An FM-index over integer symbols: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end of the text sorts first."""
    n = len(text)
    rank = text.astype(np.int64)
    base, span = int(rank.max()) + 2, 1
    packed = rank + 1
    while base ** (2 * span) < 1 << 62:  # several symbols in one key to begin with
        shifted = np.zeros(n, dtype=np.int64)
        shifted[:-span] = packed[span:]
        packed = packed * base**span + shifted
        span *= 2
        if span >= n:
            break
    order = np.argsort(packed)
    while True:
        ordered = packed[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[order[-1]] == n - 1 or span >= n:
            return order
        packed = (fresh + 1) * (n + 1)
        packed[:-span] += fresh[span:] + 1
        span *= 2
        order = np.argsort(packed)


class Bits:
    """A bitmap and the number of ones before any place: packed words, and a count for each word."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, dtype=bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Exact search in ``text``, symbols from 1 up in runs that each end with the break 0.

    The wavelet tree is kept level by level, each level one bit a symbol with counts by word;
    every ``rate``-th position and every run's first are sampled, and only those are kept.
    """

    def __init__(self, text: np.ndarray, rate: int = 16):
        n = self.n = len(text)
        order = suffix_order(text)
        level = np.where(order > 0, text[order - 1], 0)
        self.bits = max(1, int(text.max()).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.bits - 1, -1, -1):
            bit = ((level >> shift) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(n - int(np.count_nonzero(bit)))
            level = np.concatenate([level[~bit], level[bit]])
        symbols = np.arange(1 << self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])[:-1]
        self.origin = self._descend(symbols, np.zeros(len(symbols), dtype=np.int64))
        sampled = ((np.arange(n) % rate == 0) | np.concatenate([[True], text[:-1] == 0]))[order]
        self.sampled, self.sample = Bits(sampled), order[sampled].astype(np.int32)

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = level.rank(at)
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + one, at - one)
        return at

    def _step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self._descend(symbols, at) - self.origin[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of each row of ``patterns``, all searched backwards at once."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        inside = (patterns < len(self.before)).all(axis=1)  # a symbol above the text's alphabet occurs nowhere
        high[~inside] = 0
        live = np.flatnonzero(inside)
        for j in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            symbols = patterns[live, j]
            both = self._step(np.concatenate([symbols, symbols]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = np.split(both, 2)
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row is met, whose rank among those finds its position."""
        found, steps = np.empty(len(rows), dtype=np.int64), 0
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled.get(at) == 1
            found[live[done]] = self.sample[self.sampled.rank(at[done])] + steps
            live, at = live[~done], at[~done]
            symbols, inner = np.zeros(len(at), dtype=np.int64), at.copy()
            for level, zeros in zip(self.levels, self.zeros, strict=True):
                one, bit = level.rank(inner), level.get(inner)
                inner = np.where(bit, zeros + one, inner - one)
                symbols = 2 * symbols + bit
            at = self.before[symbols] + inner - self.origin[symbols]
            steps += 1
        return found
