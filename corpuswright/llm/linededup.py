"""Line deduplication: a suffix array over line-id sequences, built by distributed prefix doubling.

A document is the sequence of its lines that hold a word; lines are equal if their bytes are equal. Round k gives every
suffix a rank by its first 2^k lines: the rank of a group of equal prefixes is the number of suffixes that sort before
it. The next round orders each group by the rank found 2^k lines further on, so ranks only ever split. Suffixes whose
prefix is unique leave, as they repeat nothing.

A run is deleted if it has `min_words` words or more and occurs earlier. It suffices to look at the shortest such run
that starts at a line and the shortest that ends there: a line lies in some repeated run of that many words if and only
if it lies in one of these two kinds (a longer run can be shortened from its ends until it is one of them and still
holds the line). A run of m lines is named by two ranks at depth 2^k <= m < 2^(k+1), which overlap; runs of one name
are one longest-common-prefix interval of the suffix array cut at depth m. As every line has a word, m <= min_words, so
doubling stops at that depth.

Hot lines: groups are counted before they are ranked, and the ranks of one group are taken over `SLICES` slices of the
second rank, so no task holds a group; joins on a common rank are left to adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .texts import PLAIN, hash_spans, pieces, spans

MIN_WORDS = 50
SLICES = 1024

_NEWLINE = 0x0A


def _line_table(min_words: int):
    """Per document key: hashes of its lines with words, their word counts, and the shortest runs from and to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in pieces(batch.column(2)):
                keep, starts, ends, counts = lines_with_words(raw, offsets)
                hashes = hash_spans(raw, starts[keep], ends[keep]).view(np.int64)
                rows = np.searchsorted(offsets, starts[keep], side="right") - 1
                at = np.searchsorted(rows, np.arange(len(offsets)))
                ahead, back = shortest_runs(counts[keep], at, min_words)
                used = at.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(offsets) - 1),
                        batch.column(1).slice(first, len(offsets) - 1),
                        *(pa.ListArray.from_arrays(pa.array(used), pa.array(x)) for x in (hashes, ahead, back)),
                    ],
                    names=["id", "digest", "lines", "ahead", "back"],
                )

    return run


def lines_with_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keep, starts, ends, words) of all lines of a piece, in order; keep marks those that hold a word."""
    breaks = np.flatnonzero(raw == _NEWLINE)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    # a line ends at its newline or at the end of its row
    ends = np.concatenate((offsets[1:], breaks))
    ends.sort(kind="stable")
    word_starts, _ = spans(PLAIN[raw], offsets)
    counts = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    return counts > 0, starts, ends, counts


def shortest_runs(counts: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the shortest run of min_words words from each line on, and back from it; 0 where the document has none."""
    total = np.concatenate(([0], np.cumsum(counts)))
    n = len(counts)
    index = np.arange(n)
    row_end, row_start = np.repeat(at[1:], np.diff(at)), np.repeat(at[:-1], np.diff(at))
    end = np.searchsorted(total, total[:-1] + min_words)  # first border that far on
    ahead = np.where(end <= row_end, end - index, 0)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    back = np.where((total[1:] >= min_words) & (start >= row_start), index + 1 - start, 0)
    return ahead.astype(np.int32), back.astype(np.int32)


def rank_pairs(pairs: DataFrame, span) -> DataFrame:
    """Refined ranks of (r, s): r + the number of rows of group r with a smaller s, for pairs that repeat.

    `span` is an expression of s that puts it into one of few slices, in order.
    """
    counted = cut_lineage(pairs.groupBy("r", "s").agg(F.count("*").alias("n")).withColumn("slice", span), "lines-counted")
    inside = Window.partitionBy("r", "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = counted.groupBy("r", "slice").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("r").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("r", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = counted.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("n > 1")
    return within.join(offsets, ["r", "slice"]).select("r", "s", (F.col("r") + F.col("ahead") + F.col("inner")).alias("rank"))


def suffix_ranks(table: DataFrame, min_words: int) -> DataFrame:
    """(doc, i, depth, rank) of every suffix whose first `depth` lines repeat, for the depths 1, 2, 4 .. <= min_words."""
    flat = table.select("doc", F.posexplode("lines").alias("i", "s"))
    pairs = flat.select("doc", "i", F.lit(0).cast("long").alias("r"), "s")
    # line hashes spread over all 64-bit numbers; ranks lie below the number of lines
    slice_of = F.shiftright("s", 64 - SLICES.bit_length() + 1)
    depth, levels = 1, []
    while True:
        ranks = rank_pairs(pairs, slice_of)
        level = cut_lineage(pairs.join(ranks, ["r", "s"]).select("doc", "i", F.col("rank").alias("r")), f"lines-{depth}")
        levels.append(level.select("doc", "i", F.lit(depth).alias("depth"), F.col("r").alias("rank")))
        if 2 * depth > min_words:
            break
        if depth == 1:
            lines = flat.agg(F.count("*")).first()[0]
            slice_of = F.floor(F.col("s") * (SLICES / max(1, lines))).cast("long")
        ahead = Window.partitionBy("doc").orderBy("i").rangeBetween(depth, depth)
        pairs = level.select("doc", "i", "r", F.max("r").over(ahead).alias("s")).where("s is not null")
        depth *= 2
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (doc, start, m, ra, rb) of each document: its shortest runs from and to every line, named by two ranks."""
    for batch in batches:
        ahead, back, marks = batch.column(1), batch.column(2), batch.column(3)
        sizes = np.asarray(ahead.value_lengths().fill_null(0))
        base = np.concatenate(([0], np.cumsum(sizes)))  # documents end to end, so that a line has one number
        index = np.arange(base[-1])
        fore, aft = (np.asarray(x.flatten()).astype(np.int64) for x in (ahead, back))
        start = np.concatenate((index[fore > 0], (index - aft + 1)[aft > 0]))
        length = np.concatenate((fore[fore > 0], aft[aft > 0]))
        both = np.unique(np.stack((start, length)), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        start, length = both
        owner = np.repeat(np.arange(len(marks)), np.asarray(marks.value_lengths().fill_null(0)))
        items = marks.flatten()
        depth, line, rank = (np.asarray(items.field(k)).astype(np.int64) for k in range(3))
        level = np.round(np.log2(np.maximum(depth, 1))).astype(np.int64)
        place = (base[owner] + line) * 64 + level
        order = np.argsort(place)
        place, rank = place[order], rank[order]
        want = np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)

        def find(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = lines * 64 + want
            spot = np.minimum(np.searchsorted(place, key), max(0, len(place) - 1))
            return (place[spot] == key, rank[spot]) if len(place) else (np.zeros(len(key), bool), np.zeros(len(key), np.int64))

        has_a, ra = find(start)
        has_b, rb = find(start + length - (1 << want))
        use = has_a & has_b
        start, length, ra, rb = start[use], length[use], ra[use], rb[use]
        doc = np.searchsorted(base, start, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array((start - base[doc]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(ra), pa.array(rb)],
            names=["doc", "start", "m", "ra", "rb"],
        )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, spans): for each document with later copies, the runs [start, end) of its lines with words to delete.

    A document is known by its id and its text's digest; rows equal in both are one document. Documents come in the
    order of id (null first), then digest; inside a document, lines come in order.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, digest long, lines array<long>, ahead array<int>, back array<int>"
    table = source.mapInArrow(_line_table(min_words), schema).where("size(lines) > 0")
    table = cut_lineage(table.dropDuplicates(["id", "digest"]).withColumn("doc", F.struct("id", "digest")).drop("id", "digest"), "lines-table")
    ranks = suffix_ranks(table, min_words)
    marks = ranks.groupBy("doc").agg(F.collect_list(F.struct("depth", "i", "rank")).alias("marks"))
    doc_type = table.schema["doc"].dataType.simpleString()
    runs = cut_lineage(
        table.where("exists(ahead, x -> x > 0)").join(marks, "doc").select("doc", "ahead", "back", "marks")
        .mapInArrow(_name_runs, f"doc {doc_type}, start int, m int, ra long, rb long"),
        "lines-runs",
    )
    name = ["m", "ra", "rb"]
    first = runs.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first")).where("n > 1").drop("n")
    later = runs.join(first, name).where(F.struct("doc", "start") != F.col("first"))
    return later.groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("m")).alias("end"))).alias("spans")).select(
        "doc.id", "doc.digest", "spans"
    )


def _cut_text(text: pa.Array, spans_: pa.Array) -> pa.Array:
    out = []
    for value, cuts in zip(text.to_pylist(), spans_.to_pylist()):
        if value is None or not cuts:
            out.append(value)
            continue
        lines = value.split("\n")
        drop = np.zeros(len(lines) + 1, np.int64)
        for cut in cuts:
            drop[cut["start"]] += 1
            drop[cut["end"]] -= 1
        gone = np.cumsum(drop) > 0
        kept, k = [], 0
        for line in lines:
            if line.strip("\t\n\x0b\x0c\r "):
                if not gone[k]:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every later copy of a repeated run of lines (min_words words or more) deleted from its text.

    Every row and every column stays; a document may be left empty. Lines without a word are kept as they are and do
    not break a run. Null and empty texts stay as they are; repeated rows are one document and get one result; the
    earliest copy is that of the smallest id (null first), then of the smallest text digest.
    """
    if not min_words >= 1:
        raise ValueError("min_words must be 1 or more")
    runs = repeated_runs(docs, min_words, id_col, text_col).toDF("__cw_id", "__cw_digest", "__cw_spans")
    cut = F.arrow_udf(_cut_text, "string")
    same = docs[id_col].eqNullSafe(runs["__cw_id"]) & (F.xxhash64(docs[text_col]) == runs["__cw_digest"])
    joined = docs.join(runs, same, "left")
    # only texts with something to cut go to Python
    changed = F.when(F.col("__cw_spans").isNotNull(), docs[text_col])
    text = F.when(F.col("__cw_spans").isNull(), docs[text_col]).otherwise(cut(changed, "__cw_spans"))
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns), (F.col("__cw_spans").isNotNull()).alias("__cw_cut"))
