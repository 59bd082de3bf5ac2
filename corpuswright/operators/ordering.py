"""Global positions without a global sort in one task.

A row's position is (rows in earlier blocks) + (position inside its block). Blocks are a monotone function of group and
order key, their number is bounded, so the block table is an ordinary aggregation and only that small table sees an ordered
prefix sum. The block is a pure function of the row and of range bounds that are a pure function of the table: unlike
partition numbers it survives retries, adaptive re-planning and a different number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.let import let
from ..session import cut_lineage

# Rows that a block should hold, as long as that makes no more than the largest number of blocks; a power of two.
BLOCK_ROWS = 1 << 16
MOST_BLOCKS = 1 << 12
# Sampled keys per block: the more, the evener the blocks.
KEYS_PER_BLOCK = 16
# Blocks for keys uniform in [0, 1): the bound of the block table per group.
UNIFORM_BLOCKS = 1 << 12
# Keys per block where keys are known to be dense, such as those of `range`.
DENSE_KEYS = 1 << 16
_HASH_BITS = 30


def dense_block(key: str, width: int = DENSE_KEYS) -> Column:
    """Block of a dense integer key."""
    return F.floor(F.col(key) / F.lit(width)).cast("long")


def uniform_block(u: Column, blocks: int = UNIFORM_BLOCKS) -> Column:
    """Block of a uniform key."""
    return F.floor(u * F.lit(blocks)).cast("long")


def _cuts(df: DataFrame, keys: list[str], block_rows: int) -> Column:
    """Range bounds of (group, key) as a scalar subquery: every sixteenth key of a sorted sample chosen by hash.

    The sample follows the number of rows up to `MOST_BLOCKS` · `KEYS_PER_BLOCK` keys, whatever their type, and it is the same in
    every run. Only the key columns are read for it.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    aim = F.least(n / F.lit(block_rows), F.lit(float(MOST_BLOCKS))) * KEYS_PER_BLOCK / F.greatest(n, F.lit(1))
    place = F.xxhash64(*keys).bitwiseAND(F.lit((1 << _HASH_BITS) - 1)) / F.lit(float(1 << _HASH_BITS))
    sample = df.filter(place < aim).agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("keys"))
    every = F.filter("keys", lambda _, i: i % KEYS_PER_BLOCK == KEYS_PER_BLOCK - 1)
    return sample.select(every.alias("cuts")).scalar()


def with_key_block(df: DataFrame, key: str, by: tuple[str, ...] = (), out: str = "__blk", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block of a row in the order of group and key: even blocks for keys of every orderable type.

    Blocks hold about `block_rows` rows: numbers, texts with a common start, timestamps and structs alike. A block may hold the end
    of one group and the start of the next, so there is no limit to the number of groups. NULL stands in front.
    """
    steps = F.array(*[F.lit(1 << b) for b in range(MOST_BLOCKS.bit_length(), -1, -1)])
    own = F.struct(*by, key)

    def search(bound: Column) -> Column:
        # the number of bounds up to the key, by halving
        return F.aggregate(
            steps, F.lit(0), lambda n, s: n + F.when(F.coalesce(F.get(bound["cuts"], n + s - 1) <= bound["own"], F.lit(False)), s).otherwise(0)
        )

    # a scalar subquery stands as a column first: array functions take no subqueries
    bounded = df.withColumn("__cuts", _cuts(df, [*by, key], block_rows))
    return bounded.withColumn(out, let(F.struct(F.col("__cuts").alias("cuts"), own.alias("own")), search).cast("long")).drop("__cuts")


def with_position(
    df: DataFrame,
    order_by: list[str | Column],
    block: Column,
    by: tuple[str, ...] = (),
    out: str = "pos",
) -> DataFrame:
    """0-based position in `order_by` order inside each `by` group.

    `order_by` must be unique inside a group and `block` non-decreasing along it (NULL first in both). Rows shuffle
    once, by (group, block): a group with a third of all rows is spread over all its blocks, and the table of block starts joins
    them where they are. The second read of the input counts rows per block and needs the key columns only. NULL groups, keys
    and blocks are numbered like others.
    """
    return _number(df.withColumn("__blk", block), order_by, list(by), out)


def _grouped(keyed: DataFrame, by: list[str]) -> DataFrame:
    """One column that names group and block and is never NULL, so that windows and joins on it are the same."""
    return keyed.withColumn("__at", F.struct(*by, F.struct("__blk").alias("__blk")))


def block_starts(keyed: DataFrame, by: list[str], amount: Column, out: str) -> DataFrame:
    """(__at, out): the sum of `amount` over the blocks of a group in front of each; `keyed` has `__at`.

    An ordered prefix sum over blocks, not rows; several groups or one are one narrow row per block.
    """
    sums = keyed.groupBy("__at").agg(F.sum(amount).cast("long").alias("__sum"))
    group = F.struct(*[F.col(f"__at.{c}").alias(c) for c in by], F.lit(0).alias("__"))
    before = W.partitionBy(group).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("__at", "__sum", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias(out))


def _number(keyed: DataFrame, order_by: list[str], by: list[str], out: str) -> DataFrame:
    keyed = _grouped(keyed, by)
    starts = block_starts(keyed, by, F.lit(1), "__start").drop("__sum")
    numbered = keyed.withColumn("__in", F.row_number().over(W.partitionBy("__at").orderBy(*order_by)).cast("long"))
    return numbered.join(starts, "__at").withColumn(out, F.col("__start") + F.col("__in") - 1).drop("__at", "__blk", "__start", "__in")


def first_rows(df: DataFrame, n: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of every group in key order, NULL first; keys are unique inside a group.

    Rows are counted per block; blocks that end before the n-th row are taken whole, where they stand, and only the one block
    of a group in which it lies is sorted. The table of blocks is written, so the planner knows its size when it joins it.
    """
    keyed = _grouped(with_key_block(df, key, by), list(by))
    starts = block_starts(keyed, list(by), F.lit(1), "__start").filter(F.col("__start") < n)
    marks = cut_lineage(starts.select("__at", (F.lit(n) - F.col("__start")).alias("__room"), (F.col("__start") + F.col("__sum") <= n).alias("__whole")), "first-rows")
    found = keyed.join(marks, "__at")
    cut = found.filter(~F.col("__whole")).withColumn("__in", F.row_number().over(W.partitionBy("__at").orderBy(key))).filter(F.col("__in") <= F.col("__room"))
    return found.filter("__whole").select(*df.columns).unionByName(cut.select(*df.columns))


def with_key_position(df: DataFrame, key: str, by: tuple[str, ...] = (), out: str = "pos") -> DataFrame:
    """`with_position` for a unique key of any spread."""
    return _number(with_key_block(df, key, by), [key], list(by), out)


def align_by_position(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), out: str = "pos") -> DataFrame:
    """Rows of two numbered tables that hold the same place; a place that only one of them has keeps its row.

    `by` may hold NULL. The columns of the side that lacks the place are NULL.
    """
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in (*by, out)})
    on = [left[c].eqNullSafe(marked[f"__r_{c}"]) for c in (*by, out)]
    both = left.join(marked, on, "full")
    named = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in (*by, out)}
    return both.withColumns(named).drop(*(f"__r_{c}" for c in named))
