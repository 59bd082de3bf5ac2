"""Elias-Fano sequences and an n-gram trie level built of them. Everything is a view of flat buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CODES = 256


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` of each value, one behind the other, with room for a 64-bit read behind the last."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    planes = ((values[:, None] >> np.arange(bits, dtype=np.int64)) & 1).astype(np.uint8)
    return np.concatenate((np.packbits(planes.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)))


@dataclass
class EliasFano:
    """A monotone sequence: low bits packed, high parts as unary gaps, read from the packed bits.

    The directory holds the ones and the zeros in front of every 64 bits of the unary part: one bit per bit.
    """

    size: int
    bits: int
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        """`values` ascending (repeats allowed), each below `universe`."""
        n = len(values)
        bits = max(0, min(48, (max(1, universe) // max(1, n)).bit_length() - 1))
        high = (values >> bits).astype(np.int64)
        length = int(high[-1]) + n + 1 if n else 1
        unary = np.zeros(-(-length // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        return EliasFano(n, bits, _pack(values, bits), np.packbits(unary, bitorder="little"))

    def __post_init__(self):
        self._words = np.ndarray((len(self.high) // 8,), dtype="<u8", buffer=self.high)
        ones = np.cumsum(np.bitwise_count(self._words), dtype=np.uint32)
        self._ones = np.concatenate((np.zeros(1, np.uint32), ones[:-1]))
        self._zeros = (np.arange(len(self._words), dtype=np.int64) * 64 - self._ones).astype(np.uint32)
        self._buckets = int(self.tops(np.array([self.size - 1]))[0]) + 1 if self.size else 0

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the one (or zero) that has `rank` others in front of it."""
        before = self._ones if ones else self._zeros
        at = np.searchsorted(before, rank.astype(np.uint32), side="right") - 1
        word = self._words[at] if ones else ~self._words[at]
        rest = rank - before[at]
        place = at * 64
        for width in (32, 16, 8, 4, 2, 1):  # halve the word
            count = np.bitwise_count(word & np.uint64((1 << width) - 1))
            up = rest >= count
            rest = rest - np.where(up, count, 0)
            place += np.where(up, width, 0)
            word = np.where(up, word >> np.uint64(width), word)
        return place

    def tops(self, at: np.ndarray) -> np.ndarray:
        """High part of each value."""
        return self._select(at, True) - at

    def starts(self, top: np.ndarray) -> np.ndarray:
        """Index of the first element whose high part is no less than each of `top`, which are `_buckets` at most."""
        before = np.maximum(top - 1, 0)
        return np.where(top > 0, self._select(before, False) - before, 0)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at.astype(np.int64) * self.bits
        lanes = np.ndarray((len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        got = lanes[bit >> 3] >> (bit & 7).astype(np.uint64)
        return (got & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self.tops(at) << self.bits) | self.lows(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element that is no less than each value; `size` if there is none."""
        top = values >> self.bits
        buckets = self._buckets
        inside = np.minimum(top, max(0, buckets - 1))
        if not buckets:
            return np.zeros(len(values), np.int64)
        lo, hi = self.starts(inside), self.starts(inside + 1)
        lo[top >= buckets] = hi[top >= buckets] = self.size
        want = values & ((1 << self.bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # halve what is left of each bucket
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not an element."""
        at = self.successor(values)
        if not self.size:
            return np.full(len(values), -1, np.int64)
        safe = np.minimum(at, self.size - 1)
        return np.where((at < self.size) & (self.access(safe) == values), at, -1)


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): book[codes] is near `values`; with CODES distinct values or fewer it equals them."""
    distinct = np.unique(values)
    if len(distinct) <= CODES:
        book = distinct if len(distinct) else np.zeros(1)
    else:
        # bins of equal width; each stands for the mean of its members, so sums stay unbiased
        edges = np.linspace(distinct[0], distinct[-1], CODES + 1)
        bin_ = np.minimum(np.searchsorted(edges, values, side="right") - 1, CODES - 1)
        count = np.bincount(bin_, minlength=CODES)
        total = np.bincount(bin_, values, minlength=CODES)
        book = np.where(count > 0, total / np.maximum(count, 1), (edges[1:] + edges[:-1]) / 2)
        return bin_.astype(np.uint8), book
    return np.searchsorted(book, values).astype(np.uint8), book


@dataclass
class Trie:
    """Two levels: contexts, and per context its successors with the log of their smoothed probability.

    `pointers` says where the successors of a context start. A successor is a number of the shard's vocabulary; numbers
    of context k are raised by k * vocabulary size, which makes the whole level monotone.
    """

    contexts: EliasFano
    pointers: EliasFano
    vocabulary: EliasFano
    successors: EliasFano
    codes: np.ndarray
    book: np.ndarray
    backoff_codes: np.ndarray
    backoff_book: np.ndarray

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, log_p: np.ndarray, nodes: np.ndarray, backoff: np.ndarray) -> Trie:
        """Pairs sorted by (context, successor); `nodes` are all contexts, ascending, `backoff` their logs."""
        words = np.unique(successor)
        node = np.searchsorted(nodes, context)
        ids = np.searchsorted(words, successor)
        starts = np.searchsorted(node, np.arange(len(nodes) + 1))
        room = max(1, len(words))
        codes, book = quantise(log_p)
        backoff_codes, backoff_book = quantise(backoff)
        return Trie(
            EliasFano.of(nodes, 1 << 62),
            EliasFano.of(starts, len(context) + 1),
            EliasFano.of(words, 1 << 48),
            EliasFano.of(node * room + ids, room * max(1, len(nodes))),
            codes, book, backoff_codes, backoff_book,
        )

    def query(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(has the context, has the pair, log): the pair's log probability, else the context's back-off, else 0."""
        node, word = self.contexts.find(context), self.vocabulary.find(successor)
        known = node >= 0
        log = np.zeros(len(context))
        log[known] = self.backoff_book[self.backoff_codes[node[known]]]
        ask = np.flatnonzero(known & (word >= 0))
        room = max(1, self.vocabulary.size)
        at = self.successors.successor(node[ask] * room + word[ask])
        # relative to the context: the successor found has to lie in front of the next context's first
        inside = at < self.pointers.access(node[ask] + 1)
        ask, at = ask[inside], at[inside]
        same = self.successors.access(at) == node[ask] * room + word[ask] if len(at) else np.zeros(0, bool)
        pair = np.zeros(len(context), bool)
        pair[ask[same]] = True
        log[ask[same]] = self.book[self.codes[at[same]]]
        return known, pair, log

    def levels(self) -> dict[str, bytes]:
        """The buffers of all levels, named; `view` is the way back."""
        out = {}
        for name in ("contexts", "pointers", "vocabulary", "successors"):
            ef = getattr(self, name)
            out[name] = np.array([ef.size, ef.bits, len(ef.low)], "<i8").tobytes() + ef.low.tobytes() + ef.high.tobytes()
        return out | {
            "codes": self.codes.tobytes(), "book": self.book.astype("<f8").tobytes(),
            "backoff_codes": self.backoff_codes.tobytes(), "backoff_book": self.backoff_book.astype("<f8").tobytes(),
        }

    @staticmethod
    def view(levels: dict) -> Trie:
        """A trie over given buffers, be they bytes or memory maps; only the directories are made anew."""

        def sequence(raw) -> EliasFano:
            size, bits, low = np.frombuffer(raw, "<i8", 3).tolist()
            rest = np.frombuffer(raw, np.uint8)[24:]
            return EliasFano(size, bits, rest[:low], rest[low:])

        efs = {k: sequence(levels[k]) for k in ("contexts", "pointers", "vocabulary", "successors")}
        return Trie(
            **efs, codes=np.frombuffer(levels["codes"], np.uint8), book=np.frombuffer(levels["book"], "<f8"),
            backoff_codes=np.frombuffer(levels["backoff_codes"], np.uint8), backoff_book=np.frombuffer(levels["backoff_book"], "<f8"),
        )
