"""Clipped n-gram matches of tokenized texts, counted in Arrow batches with numpy: no Python object per token.

A text is tokens between Unicode blanks; where `cut` says so, the rules of the 13a tokenizer part it further. An n-gram is a 64-bit hash; a text's n-grams are one sorted stretch of (row, hash) keys, so
that matches are a search of one stretch in another. A key gives the row as many bits as the rows of a piece need and the
hash the others; a piece has at most `PIECE_ROWS` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .bytewords import _table, chain, column_bytes, hash_spans, spans

# Highest n-gram order, and the bounds of a piece.
ORDER = 4
PIECE_ROWS, PIECE_BYTES = 1 << 10, 1 << 20

STATS = ", ".join(["hyp_len: bigint", "ref_len: bigint", *[f"{k}{n}: bigint" for n in range(1, ORDER + 1) for k in ("match", "total")]])
_NAMES = [f.split(":")[0] for f in STATS.split(", ")]

_PLAIN = _table({*range(0x09, 0x0E), *range(0x1C, 0x21)}, lower=False)
# U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
_WIDE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.uint32)


def _blanked(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with every Unicode blank as spaces."""
    out = _PLAIN[raw]
    two = np.flatnonzero(raw[:-1] == 0xC2)
    two = two[(raw[two + 1] == 0x85) | (raw[two + 1] == 0xA0)]
    out[two] = out[two + 1] = 0x20
    three = np.flatnonzero((raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    code = (raw[three].astype(np.uint32) << 16) | (raw[three + 1].astype(np.uint32) << 8) | raw[three + 2]
    three = three[np.isin(code, _WIDE)]
    for k in range(3):
        out[three + k] = 0x20
    return out


# the first rule's class, without the space
_ALONE, _DIGIT, _POINT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALONE[[*range(0x21, 0x27), *range(0x28, 0x2C), 0x2F, *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT[0x30:0x3A] = True
_POINT[[0x2C, 0x2E]] = True


def _alone(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions of the bytes that the 13a rules make tokens of their own, as if every row stood between spaces.

    A run of points and commas falls apart, as the second rule takes every other one and the third what stands before a
    space. Only its last one can stay with a digit behind it: if an even number of them follows something else than a digit, or
    an odd number follows a digit. (A single one between digits stays with both.) A hyphen stands alone behind a digit.
    `begins` marks the first bytes of rows, and the end.
    """
    digit = _DIGIT[text]
    at = np.flatnonzero(_POINT[text])
    if len(at):
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | begins[at[1:]]
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(at)) - 1
        before = digit[np.maximum(at[heads] - 1, 0)] & ~begins[at[heads]]
        behind = np.append(digit, False)[at[tails] + 1] & ~begins[at[tails] + 1]
        odd = (tails - heads) % 2 == 0
        at = np.delete(at, tails[behind & (before == odd)])
    hyphen = np.flatnonzero(text == 0x2D)
    hyphen = hyphen[digit[np.maximum(hyphen - 1, 0)] & ~begins[hyphen]]
    return np.concatenate([np.flatnonzero(_ALONE[text]), at, hyphen])


class Grams:
    """The n-grams of the rows of a piece: lengths, and per order the row and the hash of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, cut: np.ndarray):
        text, at = _blanked(raw[at[0] : at[-1]]), at - at[0]
        begins = np.zeros(len(text) + 1, bool)
        begins[at] = True
        borders = at
        if cut.any():
            alone = _alone(text, begins)
            if not cut.all():
                alone = alone[cut[np.searchsorted(at, alone, side="right") - 1]]
            begins[alone] = begins[alone + 1] = True
            borders = np.flatnonzero(begins)
        starts, ends = spans(text, borders)
        self.lengths = np.diff(np.searchsorted(starts, at))
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.hashes = hash_spans(text, starts, ends)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        grams, last = chain(self.hashes, n), len(self.row) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), grams
        inside = self.row[:last] == self.row[n - 1 :]
        return self.row[:last][inside], grams[inside]

    def totals(self, n: int) -> np.ndarray:
        return np.maximum(self.lengths - n + 1, 0)


def _keys(rows: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return hashes
    return (rows.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted stretch and how often each is there."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _matches(hyp: np.ndarray, ref: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Clipped matches per output; `owner` is the row of its reference. Both stretches of keys are sorted."""
    held, often = _counted(hyp)
    known, most = _counted(ref)
    if not len(held) or not len(known):
        return np.zeros(len(owner), np.int64)
    at = (held >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(held), np.int64)
    keep = np.uint64((1 << (64 - bits)) - 1)
    want = _keys(owner[at], np.uint64(0) * held, bits) | (held & keep)
    place = np.minimum(np.searchsorted(known, want), len(known) - 1)
    same = known[place] == want
    return np.bincount(at[same], np.minimum(often, most[place])[same], minlength=len(owner)).astype(np.int64)


def _statistics(hyp: Grams, owner: np.ndarray, ref_lengths: np.ndarray, ref_keys, bits: int) -> pa.StructArray:
    """`ref_keys(n)` gives the sorted keys of all references of the piece."""
    columns = [hyp.lengths, ref_lengths[owner]]
    for n in range(1, ORDER + 1):
        rows, hashes = hyp.of(n)
        columns += [_matches(np.sort(_keys(rows, hashes, bits)), ref_keys(n), owner, bits), hyp.totals(n)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _runs(sizes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of a bounded size and number; a row over the bounds is a run of its own."""
    size, many, a = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(rows)), 0
    while a < len(sizes):
        b = min(np.searchsorted(size, size[a] + PIECE_BYTES, side="right"), np.searchsorted(many, many[a] + PIECE_ROWS, side="right")) - 1
        b = max(a + 1, int(b))
        yield a, b
        a = b


_EMPTY = pa.array([], pa.struct([(n, pa.int64()) for n in _NAMES]))


def _flags(cut: pa.Array) -> np.ndarray:
    return cut.to_numpy(zero_copy_only=False).astype(bool)


def statistics(reference: Column, outputs: Column, cut: Column) -> Column:
    """Per entry of an array of outputs, its lengths, clipped matches and totals against the row's reference."""

    def run(reference: pa.Array, outputs: pa.Array, cut: pa.Array) -> pa.Array:
        (raw, at), flags = column_bytes(reference), _flags(cut)
        texts, offsets = outputs.values, outputs.offsets.to_numpy().astype(np.int64)
        out_raw, out_at = column_bytes(texts)
        parts = []
        for a, b in _runs(np.diff(at) + np.diff(out_at[offsets]), np.maximum(np.diff(offsets), 1)):
            if offsets[a] == offsets[b]:
                continue
            owner = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            ref = Grams(raw, at[a : b + 1], flags[a:b])
            hyp = Grams(out_raw, out_at[offsets[a] : offsets[b] + 1], flags[a:b][owner])
            bits = max(len(owner), b - a).bit_length()
            parts.append(_statistics(hyp, owner, ref.lengths, lambda n: np.sort(_keys(*ref.of(n), bits)), bits))
        rows = pa.concat_arrays(parts) if parts else _EMPTY
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), rows)

    return arrow_udf(run, f"array<struct<{STATS}>>")(reference, outputs, cut)


def _listed(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _unlisted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values)"""
    return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)


def reference_grams(reference: Column, cut: Column) -> Column:
    """Length of a text, and its n-grams of every order, sorted, with repeats: struct(ref_len, tokens, r1 … r4).

    `tokens` has the tokens' hashes as they stand, and an order the places at which its n-grams begin, sorted by the n-grams' hashes:
    these follow from the tokens, and words that recur and small numbers take a few bits in a file where a hash takes 64.
    """

    def run(reference: pa.Array, cut: pa.Array) -> pa.Array:
        (raw, at), flags = column_bytes(reference), _flags(cut)
        none = lambda kind: [np.zeros(0, kind)]
        lengths, tokens, orders = none(np.int64), none(np.uint64), [(none(np.int64), none(np.int32)) for _ in range(ORDER)]
        for a, b in _runs(np.diff(at), np.ones(len(at) - 1, np.int64)):
            piece = Grams(raw, at[a : b + 1], flags[a:b])
            lengths.append(piece.lengths)
            tokens.append(piece.hashes)
            for n, (totals, places) in enumerate(orders, 1):
                rows, own = piece.of(n)
                many = piece.totals(n)
                totals.append(many)
                places.append((np.lexsort((own, rows)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32))
        lengths = np.concatenate(lengths)
        lists = [_listed(lengths, np.concatenate(tokens).view(np.int64)), *[_listed(np.concatenate(totals), np.concatenate(places)) for totals, places in orders]]
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), *lists], names=["ref_len", "tokens", *[f"r{n}" for n in range(1, ORDER + 1)]])

    fields = ", ".join(["ref_len: bigint", "tokens: array<bigint>", *[f"r{n}: array<int>" for n in range(1, ORDER + 1)]])
    return arrow_udf(run, f"struct<{fields}>")(reference, cut)


def statistics_stored(output: Column, ref: Column, cut: Column) -> Column:
    """The statistics of one output against what `reference_grams` kept of its reference."""

    def run(output: pa.Array, ref: pa.Array, cut: pa.Array) -> pa.Array:
        (raw, at), flags = column_bytes(output), _flags(cut)
        ref_len = ref.field("ref_len").to_numpy(zero_copy_only=False)
        ends, tokens = _unlisted(ref.field("tokens"))
        orders = [_unlisted(ref.field(f"r{n}")) for n in range(1, ORDER + 1)]
        parts = []
        for a, b in _runs(np.diff(at) + 8 * np.diff(ends), np.ones(len(at) - 1, np.int64)):
            bits = (b - a).bit_length()
            first, own = ends[a:b] - ends[a], tokens[ends[a] : ends[b]].view(np.uint64)

            def stored(n: int) -> np.ndarray:
                at_, places = orders[n - 1][0][a : b + 1], orders[n - 1][1]
                rows = np.repeat(np.arange(b - a), np.diff(at_))
                return _keys(rows, chain(own, n)[first[rows] + places[at_[0] : at_[-1]]], bits)

            parts.append(_statistics(Grams(raw, at[a : b + 1], flags[a:b]), np.arange(b - a), ref_len[a:b].astype(np.int64), stored, bits))
        return pa.concat_arrays(parts) if parts else _EMPTY

    return arrow_udf(run, f"struct<{STATS}>")(output, ref, cut)
