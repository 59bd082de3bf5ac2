"""Benchmark decontamination: shards of documents get an FM-index each, in which the test phrases are searched.

A shard is a run of whole texts of one Arrow batch, about `SHARD_WORDS` words of them; a longer text is a shard of its own.
Its words are numbered by the benchmark's own words; all others can be in no phrase and count as one separator, as do row
borders. Stretches between separators that are shorter than the shortest phrase can hold no match and are left out.
Backward search answers all phrases at once; the occurrences found are mapped back to words of documents, and overlapping
ones are merged to removal spans.

The benchmark is a stated query set and may be long: it is searched in blocks of at most `BLOCK_ITEMS` items and
`BLOCK_BYTES` of text (a longer item is a block of its own), one pass over the documents each. Every pass but the last is
written, its spans merged with those before, and its block is dropped before the next one is read: the driver and the
tasks hold one block at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .fmindex import FMIndex
from .shared import restore, share
from .texts import ALNUM, words

WINDOW = 10
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 19

_FOUND = "struct<n_words:bigint,spans:array<struct<lo:bigint,hi:bigint>>,items:array<string>>"


class Phrases:
    """The windows of one block of benchmark items as rows of word numbers, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        hashes = []
        for piece in words(pa.array([text for _, text in items], pa.string()), ALNUM):
            hashes += [piece.hashes[a:b] for a, b in zip(piece.bounds[:-1], piece.bounds[1:])]
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        cuts, items_of = defaultdict(list), defaultdict(list)
        for k, h in enumerate(hashes):
            if size := min(window, len(h)):
                ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
                cuts[size].append(np.lib.stride_tricks.sliding_window_view(ids, size))
                items_of[size].append(np.full(len(ids) - size + 1, k, np.int32))
        # equal windows are searched once; the items of window w are owners[size][0][owners[size][1][w] : owners[size][1][w + 1]]
        self.patterns, self.owners = {}, {}
        for size, found in cuts.items():
            distinct, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            self.patterns[size], self.owners[size] = distinct, (np.concatenate(items_of[size])[order], starts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _stretches(symbols: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words inside rows that are `least` words long or longer."""
    known = symbols > 0
    border = np.ones(len(symbols) + 1, bool)
    border[1:] = ~known
    border[bounds] = True
    starts = np.flatnonzero(known & border[:-1])
    stop = np.ones(len(symbols), bool)
    stop[:-1] = ~known[1:]
    ends_of_rows = bounds[1:] - 1
    stop[ends_of_rows[ends_of_rows >= 0]] = True
    ends = np.flatnonzero(known & stop) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


class Found:
    """What a batch of texts holds: words, merged spans of words inside matches, and the names of the matching items."""

    def __init__(self, n: int):
        self.sizes = np.zeros(n, np.int64)
        self.spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.items: list[set[str]] = [set() for _ in range(n)]

    def add(self, before: pa.Array) -> None:
        """Join what earlier blocks have found in the same texts."""
        for k, old in enumerate(before.to_pylist()):
            self.spans[k] = merge(self.spans[k] + [(s["lo"], s["hi"]) for s in old["spans"]])
            self.items[k].update(old["items"])

    def column(self) -> pa.Array:
        span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
        return pa.StructArray.from_arrays(
            [
                pa.array(self.sizes),
                pa.array([[{"lo": a, "hi": b} for a, b in s] for s in self.spans], pa.list_(span)),
                pa.array([sorted(i) for i in self.items], pa.list_(pa.string())),
            ],
            names=["n_words", "spans", "items"],
        )


def search_texts(column: pa.Array, phrases: Phrases, shard_words: int = SHARD_WORDS) -> Found:
    """Search a batch of texts, shard by shard; the shards' size changes nothing but memory."""
    found = Found(len(column))
    stretches, held = [], 0  # symbols, first word in its row, row
    least = min(phrases.patterns, default=1)
    for piece in words(column, ALNUM):
        found.sizes[piece.first : piece.first + piece.rows] = piece.counts()
        symbols = phrases.number(piece.hashes)
        starts, ends = _stretches(symbols, piece.bounds, least)
        row = np.searchsorted(piece.bounds, starts, side="right") - 1
        for s, e, r in zip(starts.tolist(), ends.tolist(), row.tolist()):
            stretches.append((symbols[s:e], s - int(piece.bounds[r]), piece.first + r))
        held += int((ends - starts).sum())
        if held >= shard_words:
            _search_shard(stretches, phrases, found)
            stretches, held = [], 0
    _search_shard(stretches, phrases, found)
    found.spans = [merge(s) for s in found.spans]
    return found


def _search_shard(stretches: list[tuple[np.ndarray, int, int]], phrases: Phrases, found: Found) -> None:
    if not stretches or not phrases.patterns:
        return
    at = np.concatenate(([0], np.cumsum([len(symbols) + 1 for symbols, _, _ in stretches])))
    text = np.full(at[-1], len(phrases.vocabulary) + 1, np.int64)
    for (symbols, _, _), a in zip(stretches, at[:-1].tolist()):
        text[a : a + len(symbols)] = symbols
    index = FMIndex(text)
    for size, patterns in phrases.patterns.items():
        owners, starts = phrases.owners[size]
        lo, hi = index.search(patterns)
        which = np.repeat(np.arange(len(patterns)), hi - lo)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        position = index.locate(lo[which] + inside)
        stretch = np.searchsorted(at, position, side="right") - 1
        for w, k, offset in zip(which.tolist(), stretch.tolist(), (position - at[stretch]).tolist()):
            _, place, row = stretches[k]
            found.spans[row].append((place + offset, place + offset + size))
            found.items[row].update(phrases.names[i] for i in owners[starts[w] : starts[w + 1]].tolist())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int) -> Iterator[list[tuple[str, str]]]:
    """Lists of (name, text), bounded by items and bytes; an item without a name or without text has no phrases."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text")).dropna()
    for name, text in rows.toLocalIterator():
        more = len(text.encode())
        if block and (len(block) == block_items or size + more > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((name, text))
        size += more
    yield block


def _search(text: Column, before: Column | None, shared: Broadcast) -> Column:
    """The struct of what this block and those before it have found."""
    if before is None:

        def first(t: pa.Array) -> pa.Array:
            return search_texts(t, restore(Phrases, shared)).column()

        return F.arrow_udf(first, _FOUND)(text)

    def next_(t: pa.Array, b: pa.Array) -> pa.Array:
        found = search_texts(t, restore(Phrases, shared))
        found.add(b)
        return found.column()

    return F.arrow_udf(next_, _FOUND)(text, before)


def _clean(text: Column, before: Column | None, shared: Broadcast) -> Column:
    """The text without the words that this block and those before it have found; null where nothing is to be cut."""
    if before is None:

        def first(t: pa.Array) -> pa.Array:
            return _remove(t, search_texts(t, restore(Phrases, shared)).spans)

        return F.arrow_udf(first, "string")(text)

    def next_(t: pa.Array, b: pa.Array) -> pa.Array:
        found = search_texts(t, restore(Phrases, shared))
        found.add(b)
        return _remove(t, found.spans)

    return F.arrow_udf(next_, "string")(text, before)


def _remove(column: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    out: list[str | None] = [None] * len(column)
    for row, cuts in enumerate(spans):
        if not cuts:
            continue
        value = column[row].as_py()
        raw = value.encode()
        piece = next(words(pa.array([value], pa.string()), ALNUM, len(raw) + 1))
        kept, at = [], 0
        for lo, hi in cuts:
            kept.append(raw[at : piece.starts[lo]])
            at = int(piece.ends[hi - 1])
        kept.append(raw[at:])
        out[row] = b" ".join(k.strip(b" ") for k in kept).strip(b" ").decode()
    return pa.array(out, pa.string())


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def _all_but_last(docs: DataFrame, benchmark: DataFrame, text_col: str, name: str, item_col: str, item_text: str, window: int, block_items: int):
    """The documents after a written pass for each block but the last, the column found so far, and the last block."""
    before = None
    blocks = _blocks(benchmark, item_col, item_text, block_items)
    block = next(blocks)
    while True:
        shared = share(benchmark.sparkSession, Phrases(block, window))
        block = next(blocks, None)
        if block is None:
            return docs, before, shared
        docs = cut_lineage(docs.withColumn(name, _search(F.col(text_col), before, shared)), "leaks")
        before = F.col(name)
        shared.destroy()


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "found", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """`docs` with `out`: struct of n_words, spans (word positions [lo, hi), merged) and items (ids as sorted strings).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A phrase is `window` consecutive words of an
    item, or a shorter item as a whole. Null and empty texts have no words. Repeated items count by their names, repeated
    rows each get the same result. A column that is already called `out` is replaced.
    """
    name = _free("__cw_found", [*docs.columns, out])
    docs_, before, shared = _all_but_last(docs, benchmark, text_col, name, item_col, item_text, window, block_items)
    found = docs_.withColumn(out, _search(F.col(text_col), before, shared))
    return found.drop(name)


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """`docs` with the words inside benchmark phrases cut out of `text`; every row and every column stays.

    Rows without a match keep their text byte by byte; null stays null. Repeated rows get the same result. The search and
    the cut are one function, and only texts that change come back from it.
    """
    name = _free("__cw_found", docs.columns)
    docs_, before, shared = _all_but_last(docs, benchmark, text_col, name, item_col, item_text, window, block_items)
    text = F.coalesce(_clean(F.col(text_col), before, shared), F.col(text_col))
    return docs_.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
