"""Sampling, mixing, order, limits and concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rand import pick, uniform
from ..session import cut_lineage
from .ordering import DENSE_KEYS, dense_block, first_rows, uniform_block, with_key_position, with_position

# Partners that one join key of a mixture has at most: a source drawn more often than this is joined under several salts.
REPEATS = 1_000


def uniform_probs(n: int) -> list[float]:
    return [1.0 / n] * n


def sort_mixture(names: list[str], probs: list[float]) -> tuple[list[str], list[float]]:
    """Sources ascending by probability (stable) together with their probabilities."""
    order = sorted(range(len(names)), key=lambda i: probs[i])
    return [names[i] for i in order], [probs[i] for i in order]


def draw_sources(
    spark: SparkSession, n: int, names: list[str], probs: list[float], seed: int, first: int = 0
) -> DataFrame:
    """Draws first … n − 1: (draw, source)."""
    u = uniform(seed, F.col("id"))
    return spark.range(first, n).select(F.col("id").alias("draw"), pick(u, names, probs).alias("source"))


def draws_of_ranks(
    spark: SparkSession, ranks: dict[str, int], names: list[str], probs: list[float], seed: int, first: int = 0, every: bool = False
) -> dict[str, int]:
    """For each source of `ranks`: its draw number `ranks[source]`, from 0, among the draws from `first` on.

    Draws are counted per block; only the one block that holds the sought draw is looked into. The number of draws tried starts
    at twice the expectation and doubles until one of them is found, or all if `every` is set; the least is always among them.
    """
    total = float(sum(probs))
    share = dict(zip(names, probs))
    need = [(n + 1) * total / share[s] for s, n in ranks.items()]
    n = max(int(2 * (max(need) if every else min(need))), 16)
    while True:
        counts = draw_sources(spark, first + n, names, probs, seed, first).groupBy("source", dense_block("draw").alias("blk")).count()
        before = W.partitionBy("source").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
        rank = F.lit(-1)
        for s, k in ranks.items():
            rank = F.when(F.col("source") == s, F.lit(k)).otherwise(rank)
        placed = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        hit = placed.filter((F.col("start") <= rank) & (rank < F.col("start") + F.col("count"))).collect()
        if len(hit) >= (len(ranks) if every else 1):
            break
        n *= 2
    found = {}
    for row in hit:
        lo, hi = max(row.blk * DENSE_KEYS, first), min((row.blk + 1) * DENSE_KEYS, first + n)
        inside = draw_sources(spark, hi, names, probs, seed, lo).filter(F.col("source") == row.source)
        upto = inside.orderBy("draw").limit(ranks[row.source] - row.start + 1)
        found[row.source] = upto.agg(F.max("draw")).first()[0]
    return found


def scheduled(
    spark: SparkSession, first: int, stop: int, drawn: dict[str, int], sizes: dict[str, int], ended: dict[str, bool],
    names: list[str], probs: list[float], seed: int,
) -> DataFrame:
    """Draws first … stop − 1 of a mixture going on: (draw, source, row); sources that ended start over."""
    of = lambda values: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()])
    draws = draw_sources(spark, stop, names, probs, seed, first)
    numbered = with_position(draws, ["draw"], dense_block("draw"), ("source",), "k")
    k = F.col("k") + of(drawn).cast("long")
    size = F.greatest(of(sizes).cast("long"), F.lit(1))
    return numbered.select("draw", "source", F.when(of(ended), k % size).otherwise(k).alias("row"))


def mixture_schedule(
    spark: SparkSession, sizes: dict[str, int], names: list[str], probs: list[float], seed: int
) -> DataFrame:
    """The draws of an all-exhausted mixture: (draw, source, row, cycle), row cycling through the source.

    Drawing stops with the draw that finishes the last unfinished source.
    """
    empty = [s for s in names if sizes.get(s, 0) == 0]
    if empty:
        raise ValueError(f"sources without rows: {empty}")
    if any(p <= 0 for p in probs):
        raise ValueError("an all-exhausted mixture needs positive probabilities")
    finished = draws_of_ranks(spark, {s: sizes[s] - 1 for s in names}, names, probs, seed, every=True)
    draws = draw_sources(spark, max(finished.values()) + 1, names, probs, seed)
    size = F.coalesce(*[F.when(F.col("source") == s, F.lit(sizes[s]).cast("long")) for s in names])
    return (
        with_position(draws, ["draw"], dense_block("draw"), ("source",), "k")
        .withColumn("row", F.col("k") % size)
        .withColumn("cycle", F.floor(F.col("k") / size).cast("long"))
        .select("draw", "source", "row", "cycle")
    )


def interleave(
    df: DataFrame,
    key: str,
    names: list[str],
    probs: list[float] | None,
    seed: int,
    source: str = "source",
    order_by: list[str] | None = None,
    block: Column | None = None,
    out: str = "draw",
    repeats: int = REPEATS,
) -> DataFrame:
    """Draw rows of several sources by probability, oversampling until every source was read once.

    `df` holds all sources with a `source` column and a unique integer `key`; a source is read in key
    order, or in `order_by` order (with its `block`) when it was shuffled before. Schedule and positions are
    computed on (source, key) alone; texts move once, in the last join on (source, key).

    Rows of a small source that is drawn often are join keys with many partners: such a source is copied
    under several salts, one per `repeats` cycles, so that no key has more partners than that.
    """
    spark = df.sparkSession
    probs = probs or uniform_probs(len(names))
    rows = df.filter(F.col(source).isin(names))
    # counted, cut into blocks and numbered: several reads of a few columns, whatever made the rows
    narrow = cut_lineage(rows.select(*dict.fromkeys([source, key, *(order_by or [])])), "mixture-keys")
    sizes = {r[source]: r["count"] for r in narrow.groupBy(source).count().collect()}
    schedule = mixture_schedule(spark, sizes, names, probs, seed).withColumnRenamed("source", source)
    if block is None:
        numbered = with_key_position(narrow, key, (source,), "row")
    else:
        numbered = with_position(narrow, order_by or [key], block, (source,), "row")
    numbered = numbered.select(source, key, "row")
    # expected cycles of each source over the whole schedule; one salt, the common case, adds a constant column
    draws = max(sizes[s] * sum(probs) / p for s, p in zip(names, probs))
    salts = {s: int(draws * p / sum(probs) / sizes[s] / repeats) + 1 for s, p in zip(names, probs)}
    n_salts = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for s, n in salts.items()])
    copies = F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("__salt")
    schedule = schedule.withColumn("__salt", (F.floor(F.col("cycle") / repeats) % n_salts).cast("int"))
    numbered, rows = numbered.select("*", copies), rows.select("*", copies)
    join_on = [source, "__salt"]
    placed = schedule.join(numbered, [*join_on, "row"]).select(*join_on, key, F.col("draw").alias(out))
    return placed.join(rows, [*join_on, key]).drop("__salt")


def mix_nested(
    mono: DataFrame, web: DataFrame, key: str, seed: int, out: str = "draw"
) -> DataFrame:
    """Two finished mixtures, numbered by `key` from 0 without gaps, drawn half and half and shuffled.

    Pass the row keys of the mixtures and join the texts to the result. The keys are written once, because the
    outer mixture reads them several times.
    """
    both = mono.withColumn("mixture", F.lit("mono")).unionByName(
        web.withColumn("mixture", F.lit("web")), allowMissingColumns=True
    )
    both = cut_lineage(both, "mixtures")
    mixed = interleave(both, key, ["mono", "web"], [0.5, 0.5], seed, "mixture", block=dense_block(key), out="__draw")
    return shuffle_position(mixed, seed, "__draw", out).drop("__draw")


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Seeded global permutation as row order; independent of partitioning."""
    return df.orderBy(uniform(seed, F.col(key)), key)


def shuffle_position(df: DataFrame, seed: int, key: str, out: str = "pos") -> DataFrame:
    """The same permutation as an explicit position column."""
    u = uniform(seed, F.col(key))
    return with_position(df.withColumn("__u", u), ["__u", key], uniform_block(F.col("__u")), (), out).drop("__u")


def take_first(df: DataFrame, n: int | None, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """First n rows in key order (NULL first) of every source; one way for every n and every orderable key."""
    return df if n is None else first_rows(df, n, key, by)


def concat_sources(dfs: list[DataFrame], seed: int | None = None, key: str | None = None) -> DataFrame:
    """All rows of all processed sources, duplicates kept; shuffled if a seed is given."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return union if seed is None else shuffle(union, seed, key)


def random_rows(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k distinct random rows (a bounded top-k, not a sort)."""
    return df.orderBy(uniform(seed, F.col(key)), key).limit(k)


def token_accounting(df: DataFrame, ids: str, by: str, rows_per_step: int, block: int) -> DataFrame:
    """Tokens, full blocks, mixture share and training steps per source.

    The total is a window over the per-source rows, of which there are as many as sources.
    """
    per = df.groupBy(by).agg(F.sum(F.size(ids)).cast("long").alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    return per.select(
        by,
        "tokens",
        F.floor(F.col("tokens") / block).cast("long").alias("full_blocks"),
        (F.col("tokens") / total).alias("share"),
        F.floor(F.col("tokens") / (rows_per_step * block)).cast("long").alias("steps"),
    )
