"""Ranked lexical search: the best documents of every item by exact inner products, found in sparse ball trees.

A document is a vector of saturated term counts, an item a vector of term weights, and the score their inner product, all
integers. Only terms of items matter to it, so documents are projected on these. Every task cuts its documents into shards,
builds a ball tree of each (`balltree`) and asks it for all items best-first; what it has found so far raises the score
that the next shard must reach. The best of all tasks meet in two ranked steps of at most `top` rows per item and task.

Items are taken in blocks of about `BLOCK_TERMS` terms or `BLOCK_ITEMS` items, whatever comes first; a block's terms and
weights are what tasks get by broadcast, so its size is bounded, and every block is one counting and one searching pass over
all documents. Terms are known by 64-bit hashes (the chance that two of 10⁹ words meet one of a block is about 10⁻⁴).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, work_dir
from .balltree import BallTree
from .texts import ALNUM, column_udf, words

BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 19
#: documents and entries of one ball tree
SHARD_ROWS, SHARD_ENTRIES = 4096, 1 << 18
_SALTS = 64


def _terms(column: pa.Array) -> pa.Array:
    out: list[np.ndarray] = []
    for piece in words(column, ALNUM):
        out += [np.unique(piece.hashes[a:b]).view(np.int64) for a, b in zip(piece.bounds[:-1], piece.bounds[1:])]
    ends = np.cumsum([0, *map(len, out)]).astype(np.int64)
    values = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).cast(pa.list_(pa.int64()))


def _pairs(piece, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the terms of a piece that the vocabulary, sorted hashes, holds."""
    at = np.searchsorted(vocabulary, piece.hashes)
    known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == piece.hashes) if len(vocabulary) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(piece.rows), piece.counts())[known]
    key, count = np.unique(row * max(1, len(vocabulary)) + at[known], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), count.astype(np.int64)


def _statistics(vocabulary):
    """Partial sums of a task: term → documents that hold it; −1 → documents with a term; −2 → all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held, documents, terms = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for piece in words(batch.column(0), ALNUM):
                held += np.bincount(_pairs(piece, known)[1], minlength=len(known))
                counts = piece.counts()
                documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
        some = np.flatnonzero(held)
        term = np.concatenate((some, [-1, -2])).astype(np.int64)
        n = np.concatenate((held[some], [documents, terms])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    return run


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's entry for a term that it holds tf times among n terms: (10⁹ tf) div (1000 tf + 20 m)."""
    most = int(n.max(initial=0))
    if 50 * most * documents < 1 << 63:
        m = 50 + (50 * n * documents) // max(1, terms)
    else:
        m = np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Best:
    """The best rows of one item so far: (−score, id is known, id), ascending."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, ids: list, scores: list[int]) -> None:
        new = [(-s, i is not None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.rows = sorted(self.rows + new)[: self.top]


def _searcher(shared, top: int, id_type: pa.DataType, shard_rows: int, shard_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        vocabulary, weights, documents, terms = block["vocabulary"], block["weights"], block["documents"], block["terms"]
        items, starts = block["items"], block["starts"]
        best = [_Best(top) for _ in range(len(starts) - 1)]
        ids: list = []
        shard: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        entries = 0

        def ask() -> None:
            sizes = np.concatenate([s for s, _, _ in shard])
            indptr = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            tree = BallTree(indptr, np.concatenate([c for _, c, _ in shard]), np.concatenate([v for _, _, v in shard]))
            for item, a, b in zip(best, starts[:-1], starts[1:]):
                own = items[a:b]
                tree.search(own, weights[own], item.least, lambda rows, scores, item=item: item.add([ids[r] for r in rows], scores.tolist()))

        for batch in batches:
            names = batch.column(0)
            for piece in words(batch.column(1), ALNUM):
                row, term, tf = _pairs(piece, vocabulary)
                value = saturated(tf, piece.counts()[row], documents, terms)
                # documents without a term of any item score 0
                full, sizes = np.unique(row, return_counts=True)
                if not len(full):
                    continue
                ids += names.take(pa.array(full + piece.first)).to_pylist()
                shard.append((sizes, term, value))
                entries += len(row)
                if len(ids) >= shard_rows or entries >= shard_entries:
                    ask()
                    ids, shard, entries = [], [], 0
        if shard:
            ask()
        out = [(k, -score, i if known else None) for k, item in enumerate(best) for score, known, i in item.rows]
        columns = list(zip(*out)) if out else [[], [], []]
        types = [pa.int32(), pa.int64(), id_type]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_no", "score", "doc_id"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, shard_rows: int = SHARD_ROWS,
                   shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` rows of `docs` with the highest scores above 0, equal scores by ascending id.

    Rows of `items` with one id, null included, are one item with the terms of all of them; items without a term, and items
    none of whose terms occurs, have no rows. Every row of `docs` counts, repeated rows and null ids (which come first) too; null
    and empty texts have no term. Ids are of any orderable type. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    col = lambda name: F.col(f"`{name}`")
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    wanted = items.select(col(item_id).alias("item_id"), F.explode(column_udf(_terms, "array<bigint>")(col(item_text).cast("string"))).alias("term"))
    wanted = cut_lineage(wanted.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "search-items")
    size = wanted.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(math.ceil(size["items"] / block_items), math.ceil(size["terms"] / block_terms), 1)
    of_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = work_dir(spark, "search")
    schema = f"item_id {wanted.schema['item_id'].dataType.simpleString()}, score long, doc_id {id_type}"
    spark.createDataFrame([], schema).write.parquet(out)
    for number in range(blocks):
        own = wanted.where(of_block == number).collect() if size["items"] else []
        if own:
            _search_block(texts, own, schema, top, shard_rows, shard_entries, out)
    found = spark.read.schema(schema).parquet(out)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    nth = F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))
    nearly = salted.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth", "salt")
    ranked = nearly.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, own: list, schema: str, top: int, shard_rows: int, shard_entries: int, out: str) -> None:
    """Append the best rows of every task for the items of one block to the table `out`."""
    spark = texts.sparkSession
    own = sorted(own, key=lambda r: str(r["item_id"]))
    hashed = [np.unique(np.array(r["terms"], np.int64).view(np.uint64)) for r in own]
    vocabulary = np.unique(np.concatenate(hashed))
    known = spark.sparkContext.broadcast(vocabulary)
    partial = texts.select("text").mapInArrow(_statistics(known), "term long, n long")
    sums = {r["term"]: r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, terms = sums.get(-1, 0), sums.get(-2, 0)
    if documents:
        df = np.array([sums.get(t, 0) for t in range(len(vocabulary))], np.int64)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        # a term that no document holds adds nothing
        held = [np.searchsorted(vocabulary, h) for h in hashed]
        held = [h[df[h] > 0] for h in held]
        block = {
            "vocabulary": vocabulary, "weights": weights, "documents": documents, "terms": terms,
            "items": np.concatenate(held), "starts": np.cumsum([0, *map(len, held)]).tolist(),
        }
        shared = spark.sparkContext.broadcast(block)
        arrow_id = _arrow_type(texts)
        run = _searcher(shared, top, arrow_id, shard_rows, shard_entries)
        best = texts.mapInArrow(run, f"item_no int, score long, doc_id {texts.schema['doc_id'].dataType.simpleString()}")
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)], f"item_no int, {schema.split(', ')[0]}")
        # one row per item of the block
        best.join(F.broadcast(names), "item_no").select("item_id", "score", "doc_id").write.mode("append").parquet(out)
        shared.destroy()
    known.destroy()


def _arrow_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(texts.schema["doc_id"].dataType)
