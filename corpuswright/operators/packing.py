"""Packing token lists into full blocks.

The ids of a source are concatenated in key order and cut into blocks; what is left at the end of a source and fills
no block is dropped. Offsets are running sums over blocks of rows, as in `with_position`, so no task holds a source.
In batch mode the same is done for every `batch_rows` consecutive rows, and the rest of each batch is dropped. Ids are
cut with `slice`, never exploded one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import repeat
from ..functions.text import py_strip
from ..session import cut_lineage
from .ordering import block_starts, with_key_block, with_key_position
from .vocab import Encoder


def mono_ids(vocab: Encoder, text: Column, max_tokens: int | None = None, strip: bool = True) -> Column:
    """BOS + text + EOS of one text, whole unless `max_tokens` is given."""
    return vocab.encode(py_strip(text) if strip else text, max_tokens, bos=True, eos=True)


def two_sided_ids(vocab: Encoder, sides: list[Column], max_tokens: int | None = None) -> Column:
    """The sides of a parallel row as separate texts one after the other; exactly empty sides are skipped."""
    none = F.array().cast("array<int>")
    return F.concat(
        *[F.when(s == "", none).otherwise(mono_ids(vocab, s, max_tokens, strip=False)) for s in sides]
    )


def _offsets(df: DataFrame, ids: str, key: str, by: tuple[str, ...], batch_rows: int | None) -> DataFrame:
    """Rows with `batch`, `__at` and `__start`, the number of ids in front of the row in its batch (a source, without batches).

    `__at` holds the rows of a stretch together: of a block of keys, or of a batch.
    """
    if batch_rows is not None:
        batched = with_key_position(df, key, by, "__pos").withColumn("batch", F.floor(F.col("__pos") / batch_rows).cast("long"))
        batched = batched.withColumn("__at", F.struct(*by, "batch"))
        before = W.partitionBy("__at").orderBy("__pos").rowsBetween(W.unboundedPreceding, -1)
        return batched.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    keyed = with_key_block(df, key, by).withColumn("__at", F.struct(*by, F.struct("__blk").alias("__blk")))
    starts = block_starts(keyed, list(by), F.col("__size"), "__ahead").drop("__sum")
    inside = W.partitionBy("__at").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return placed.join(starts, "__at").withColumn("__start", F.col("__ahead") + F.col("__in")).withColumn("batch", F.lit(0).cast("long"))


def pack_blocks(
    df: DataFrame,
    ids: str,
    key: str,
    block: int,
    by: tuple[str, ...] = (),
    batch_rows: int | None = None,
    prefix_mask: bool = False,
) -> DataFrame:
    """Blocks of exactly `block` ids per source (batch 0) or per (source, batch): input_ids, attention_mask, labels.

    Texts are encoded once, into a written table whose sizes alone are read for the offsets. Ids move once, to the stretch of
    keys they belong to, where nearly all blocks are put together; what stretches share of a block moves a second time.
    """
    batch = [*by, "batch"]
    sized = cut_lineage(df.select(*by, key, ids).withColumn("__size", F.coalesce(F.size(ids), F.lit(0)).cast("long")), "ids")
    placed = _offsets(sized, ids, key, by, batch_rows).filter(F.col("__size") > 0)
    start, end = F.col("__start"), F.col("__start") + F.size(ids)
    touched = F.sequence(F.floor(start / block).cast("long"), F.floor((end - 1) / block).cast("long"))

    def piece(b: Column) -> Column:
        lo = F.greatest(start, b * block)
        hi = F.least(end, (b + 1) * block)
        return F.struct(
            b.alias("block_no"),
            lo.alias("at"),
            F.slice(F.col(ids), (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("part"),
        )

    pieces = placed.select("__at", *batch, F.inline(F.transform(touched, piece)))
    # one group holds the ids of one block, hence at most `block` pieces
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    parts = pieces.groupBy("__at", *batch, "block_no").agg(joined.alias("part"), F.min("at").alias("at"))
    own = parts.filter(F.size("part") == block).select(*batch, "block_no", F.col("part").alias("input_ids"))
    shared = parts.filter(F.size("part") < block).groupBy(*batch, "block_no").agg(joined.alias("input_ids")).filter(F.size("input_ids") == block)
    blocks = own.unionByName(shared)
    out = blocks.withColumn("attention_mask", repeat(1, F.lit(block))).withColumn("labels", F.col("input_ids"))
    return out.withColumn("prefix_mask", repeat(0, F.lit(block))) if prefix_mask else out
