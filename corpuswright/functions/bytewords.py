"""Cutting and hashing words of whole Arrow text columns with numpy: no Python object per word.

Every function works on the UTF-8 bytes of a column. Only ASCII bytes separate words or change case, so a character of
several bytes is never cut. Nulls count as empty texts. A piece holds whole rows, as many as fit `PIECE_BYTES`; a longer
row is a piece of its own, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
LONG_WORD = 256  # bytes; longer words are hashed one by one

_SPACE = 0x20
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _table(separators: set[int], lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    table[sorted(separators)] = _SPACE
    return table


_BLANKS = {0x20, *range(0x09, 0x0E)}
#: words `[^\x20\x09-\x0D]+`, as written and with A-Z lower-cased
PLAIN = _table(_BLANKS, lower=False)
LOWER = _table(_BLANKS, lower=True)
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z, and all beyond ASCII
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive entries; order counts."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * _K1 + hashes[k : k + count])
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


@dataclass
class Words:
    """The words of rows [first, first + rows): hashes, byte spans in `buffer`, and where each row's words start."""

    first: int
    rows: int
    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # rows + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of whole rows."""
    raw, at = column_bytes(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(mapped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blanks, cut at row borders."""
    size = len(mapped)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = mapped != _SPACE
    fresh = np.ones(size + 1, bool)  # position at which a run can start, as what stands before is no word of the row
    fresh[1:] = ~word
    fresh[offsets] = True
    return np.flatnonzero(word & fresh[:-1]), np.flatnonzero(word & _last(word, offsets)) + 1


def _last(word: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    last = np.ones(len(word), bool)
    last[:-1] = ~word[1:]
    borders = offsets[1:] - 1
    last[borders[borders >= 0]] = True
    return last


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes, whatever surrounds them."""
    padded = np.zeros(len(buffer) + 16, np.uint8)
    padded[: len(buffer)] = buffer
    lanes = np.ndarray((len(buffer) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix((lanes[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _K1)
    rest, k = np.flatnonzero(size > 8), 8
    while rest.size and k < LONG_WORD:
        lane = lanes[starts[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]
        out[rest] = mix(out[rest] * _K1 ^ lane)
        k += 8
        rest = rest[size[rest] > k]
    for i in rest:
        out[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(column: pa.Array, table: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of each piece of a text column."""
    for first, raw, offsets in pieces(column, limit):
        mapped = table[raw]
        starts, ends = spans(mapped, offsets)
        yield Words(first, len(offsets) - 1, mapped, starts, ends, hash_spans(mapped, starts, ends), np.searchsorted(starts, offsets))
