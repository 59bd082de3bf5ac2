"""An FM-index over word numbers: backward search on wavelet-matrix ranks, positions from sampled suffixes.

All methods take arrays of queries; one call answers all of them with a few numpy operations per symbol and level.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every so many text positions keep their place in the suffix array
_WORD = 64


class BitVector:
    """Bits with ranks: packed words and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // _WORD + 1) * _WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at // _WORD, (at % _WORD).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at // _WORD] >> (at % _WORD).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """One bit vector per bit of the symbols, highest first; zeros go before ones from level to level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(largest).bit_length())
        current = symbols
        for b in range(self.bits - 1, -1, -1):
            ones = ((current >> b) & 1).astype(bool)
            self.levels.append(BitVector(ones))
            self.zeros.append(int(len(ones) - np.count_nonzero(ones)))
            current = np.concatenate((current[~ones], current[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of each position."""
        low = np.zeros(len(at), np.int64)
        at = at.copy()
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            rl, ra = level.rank(low), level.rank(at)
            low = np.where(one, zeros + rl, low - rl)
            at = np.where(one, zeros + ra, at - ra)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, occurrences of it in front) at each position."""
        symbol = np.zeros(len(at), np.int64)
        low, at = np.zeros(len(at), np.int64), at.copy()
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(at)
            rl, ra = level.rank(low), level.rank(at)
            symbol = symbol * 2 + one
            low = np.where(one, zeros + rl, low - rl)
            at = np.where(one, zeros + ra, at - ra)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; after the first rounds only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    key = text[order]
    heads = np.concatenate(([True], key[1:] != key[:-1]))
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 1
    while True:
        slot = rank[order]
        tied = np.zeros(n, bool)  # places of the array in groups of two or more
        same = slot[1:] == slot[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        place = np.flatnonzero(tied)
        if not len(place):
            return order
        suffix = order[place]
        ahead = suffix + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[suffix]
        by = np.lexsort((second, first))
        suffix, first, second = suffix[by], first[by], second[by]
        order[place] = suffix  # groups keep their places
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[suffix] = np.maximum.accumulate(np.where(new, place, 0))
        h *= 2


class FMIndex:
    """Index of a sequence of symbols >= 1. A last symbol 0 is added."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]  # the symbol in front of each suffix
        top = int(text.max())
        self.size = len(text)
        self.tree = WaveletMatrix(last, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        kept = order % sample == 0
        self.marked, self.kept = BitVector(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval [lo, hi) of each row of `patterns`, all of one length; symbols beyond the index match nothing."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        known = ((patterns >= 1) & (patterns < len(self.first) - 1)).all(axis=1)
        hi[~known] = 0
        live = np.flatnonzero(known)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back in the text until a sampled row."""
        out = np.full(len(rows), -1, np.int64)
        rows, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            hit = self.marked.get(rows)
            out[open_[hit]] = self.kept[self.marked.rank(rows[hit])] + steps
            rows, open_ = rows[~hit], open_[~hit]
            symbol, before = self.tree.access(rows)
            rows = self.first[symbol] + before
            steps += 1
        return out % self.size
