"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects target / source size copies. Documents of a source stand in an order by size (whole
classes of a quarter octave), then by digest; the expected copies are summed up along it, one random offset per source
is added, and a document is emitted once for each integer that its step crosses. Neighbours are of like size, so the
words taken come out near the target as well as the copies.

The prefix sum has two levels: documents are counted per block (source, size class, slice of the digest), the blocks of
a source are summed up as one short sorted array, and inside a block documents are numbered. A source with a third of
all rows is spread over its blocks. All numbers come from digests of the rows: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
SLICES = 64

def words_in(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source, null being a source.

    Sources in code point order, null last, get the weights in turn. They share percent/100 of all words by weight; a
    target stops at `most` times its source's words, and the excess is shared again by weight until none is above.

    With sources in falling order of weight / words the capped ones come first: a source is capped if the words left
    after all before it, shared among it and those behind, would still exceed its cap. That is a running sum.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_size", F.col("source_size").cast("double"))
    # one row: the sources in order as an array; their number is small beside the rows
    all_ = each.agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "source_size"))).alias("s"),
        (F.sum("source_size") * percent / 100).alias("total"),
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    flat = all_.select("total", F.posexplode("s").alias("place", "e")).select(
        "total", F.col("e.source").alias("source"), F.col("e.source_size").alias("source_size"), weight.alias("weight")
    )
    ranked = flat.withColumn("need", F.when(F.col("source_size") > 0, F.col("weight") / F.col("source_size")).otherwise(F.lit(float("inf"))))
    line = ranked.groupBy().agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct(-F.col("need"), "source", "source_size", "weight"))).alias("s"),
        F.sum("weight").alias("weights"),
    )
    start = F.struct(F.col("total").alias("left"), F.col("weights").alias("w"), F.lit(True).alias("capping"), F.lit(0.0).cast("double").alias("rate"))

    def step(state, e):
        cap = e["source_size"] * most
        capped = state["capping"] & (state["left"] * e["weight"] >= cap * state["w"])
        return F.struct(
            F.when(capped, state["left"] - cap).otherwise(state["left"]).alias("left"),
            F.when(capped, state["w"] - e["weight"]).otherwise(state["w"]).alias("w"),
            capped.alias("capping"),
            F.lit(0.0).alias("rate"),
        )

    rate = F.aggregate("s", start, step, lambda z: F.when(z["w"] > 0, z["left"] / z["w"]).otherwise(F.lit(float("inf"))))
    return (
        line.select(rate.alias("rate"), F.explode("s").alias("e"))
        .select(
            F.col("e.source").alias("source"), F.col("e.source_size").cast("long").alias("source_size"),
            F.least(F.col("rate") * F.col("e.weight"), F.col("e.source_size") * most).alias("target"),
        )
    )


def _uniform(*cols) -> Column:
    """A number in [0, 1) from the md5 of the columns."""
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# quarters of an octave in whole numbers: the number of bits, and the two bits after the first
_CLASS = "length(bin(__cw_size + 1)) * 4 + shiftright((__cw_size + 1) * 4, length(bin(__cw_size + 1)) - 1) - 4"


def systematic_copies(docs: DataFrame, expected: Column, group: Column, size: Column, key: Column, tie: Column, seed: str = "mix") -> DataFrame:
    """`docs` with `__cw_copies`: how many integers the running sum of `expected` copies of its group crosses at the row.

    The order inside a group is size class, slice of the md5 of `key`, size, that md5, `tie`; the group's offset is an
    md5 uniform of the group and the seed. Null or negative expectations count as 0. Rows equal in all of this may stand in either order, which
    changes nothing but which of the equal rows is taken. Sums are of whole millionths, so their order cannot matter.
    """
    marked = docs.withColumns({
        "__cw_group": F.struct(group.alias("g")),
        "__cw_step": F.greatest(F.coalesce(F.round(expected * 1_000_000), F.lit(0)), F.lit(0)).cast("long"),
        "__cw_order": F.md5(F.coalesce(key, F.lit(""))),
        "__cw_tie": tie,
        "__cw_size": F.coalesce(size, F.lit(0)).cast("long"),
    }).withColumn("__cw_class", F.expr(_CLASS)).withColumn("__cw_slice", (F.conv(F.substring("__cw_order", 1, 4), 16, 10).cast("int") * F.lit(SLICES) / 65536).cast("int"))
    blocks = marked.groupBy("__cw_group", "__cw_class", "__cw_slice").agg(F.sum("__cw_step").alias("n"))
    offset = F.floor(_uniform(F.lit(seed), F.coalesce(F.col("__cw_group.g").cast("string"), F.lit(""))) * 1_000_000).cast("long")
    lists = blocks.groupBy("__cw_group").agg(F.sort_array(F.collect_list(F.struct("__cw_class", "__cw_slice", "n"))).alias("b"))
    running = F.aggregate(
        "b",
        F.struct(offset.alias("sum"), F.array().cast("array<long>").alias("starts")),
        lambda z, x: F.struct((z["sum"] + x["n"]).alias("sum"), F.concat(z["starts"], F.array(z["sum"])).alias("starts")),
        lambda z: z["starts"],
    )
    starts = (
        lists.select("__cw_group", "b", running.alias("starts"))
        .select("__cw_group", F.explode(F.arrays_zip("b", "starts")).alias("z"))
        .select(F.col("__cw_group").alias("g"), F.col("z.b.__cw_class").alias("c"), F.col("z.b.__cw_slice").alias("s"), F.col("z.starts").alias("__cw_start"))
    )
    same = marked["__cw_group"].eqNullSafe(starts["g"]) & (marked["__cw_class"] == starts["c"]) & (marked["__cw_slice"] == starts["s"])
    inside = Window.partitionBy("__cw_group", "__cw_class", "__cw_slice").orderBy("__cw_size", "__cw_order", "__cw_tie").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__cw_start") + F.sum("__cw_step").over(inside)
    crossed = F.floor(upto / 1_000_000) - F.floor((upto - F.col("__cw_step")) / 1_000_000)
    return marked.join(starts, same).withColumn("__cw_copies", crossed.cast("long")).select(*(docs[c] for c in docs.columns), "__cw_copies")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, source, size, source_size, target, copies, taken (copies * size).

    Texts stay behind; only sizes and digests move. Null texts have size 0. No rows, or no words at all: targets 0.
    """
    narrow = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(source_col).alias("source"),
            words_in(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    aim = targets(narrow.select("source", "size"), weights, percent, most)
    goal = aim.toDF("g_source", "source_size", "target")
    rated = narrow.join(goal, narrow["source"].eqNullSafe(goal["g_source"])).drop("g_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = systematic_copies(rated, expected, F.col("source"), F.col("size"), F.col("doc_id").cast("string"), F.col("digest"))
    return out.select(
        "doc_id", "digest", "source", "size", "source_size", "target", F.col("__cw_copies").alias("copies"), (F.col("__cw_copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kwargs) -> DataFrame:
    """`docs` as mixed: a row is repeated as often as it is taken, rows not taken are gone; all columns stay.

    Rows equal in id, text and source are planned one by one and pooled: their copies are summed on each group of equal
    rows and handed out evenly, the first ones getting one more.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **kwargs)
    pooled = plan.groupBy("doc_id", "digest", "source").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    p = pooled.toDF("__cw_id", "__cw_digest", "__cw_source", "__cw_rows", "__cw_copies")
    # a pool of one row, nearly always, needs no number; equal rows are numbered inside their pool
    same = (
        docs[id_col].eqNullSafe(p["__cw_id"]) & (F.xxhash64(docs[text_col]) == p["__cw_digest"]) & docs[source_col].eqNullSafe(p["__cw_source"])
    )
    joined = docs.join(p.where("__cw_copies > 0"), same)
    single = joined.where("__cw_rows = 1").withColumn("__cw_take", F.col("__cw_copies"))
    many = joined.where("__cw_rows > 1").withColumn(
        "__cw_nth", F.row_number().over(Window.partitionBy("__cw_id", "__cw_digest", "__cw_source").orderBy("__cw_rows"))
    )
    even = F.floor(F.col("__cw_copies") / F.col("__cw_rows"))
    many = many.withColumn("__cw_take", even + (F.col("__cw_nth") <= F.col("__cw_copies") % F.col("__cw_rows")).cast("long")).drop("__cw_nth")
    every = single.unionByName(many).where("__cw_take > 0")
    return every.withColumn("__cw_copy", F.explode(F.sequence(F.lit(1), F.col("__cw_take").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
