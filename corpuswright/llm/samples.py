"""Bounded training samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_of(column):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def held_out(column, divisor: int = 3, remainder: int = 1):
    return crc_of(column) % divisor == remainder


def learnable(column):
    """Rows whose labels the classifiers may learn."""
    return ~held_out(column)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | None, learn, id_col: str = "doc_id", text_col: str = "text",
                    others: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, y, weight, others) of about `per_class` documents of each class at most, chosen by a digest of the id; None
    takes all labelled documents.

    `learn` is a condition on the id column that says which rows may be learnt from. The share of each class that is
    kept follows from its count, so the sample is bounded whatever the input; the bound holds in expectation, and a
    class smaller than `per_class` is kept whole. `weight` is the number of labelled rows that a row stands for.
    Rows without a label or without an id teach nothing; of several labels of one id the smaller counts, of several texts that
    of the least digest, and of several values of other columns the least.
    """
    named = labels.select(F.col(id_col).alias("__cw_id"), F.col(label).cast("int").alias("y")).where("__cw_id is not null and y in (0, 1)")
    allowed = named.where(learn(F.col("__cw_id"))).groupBy("__cw_id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("__cw_id"), F.col(text_col).alias("text"), *others)
    if per_class is None:
        # only texts that may be learnt from move
        own = texts.where(learn(F.col("__cw_id"))).join(allowed.withColumn("weight", F.lit(1.0)), "__cw_id")
    else:
        counts = {row["y"]: row["n"] for row in allowed.groupBy("y").agg(F.count("*").alias("n")).collect()}
        place = F.xxhash64(F.col("__cw_id"), F.lit(label)).bitwiseAND(F.lit((1 << 30) - 1))
        limit, weight = F.lit(0), F.lit(1.0)
        for y, n in counts.items():
            limit = F.when(F.col("y") == y, F.lit(int(min(1.0, per_class / n) * (1 << 30)))).otherwise(limit)
            weight = F.when(F.col("y") == y, F.lit(max(1.0, n / per_class))).otherwise(weight)
        # the sample's size is bounded by the parameter, so it may be broadcast
        own = texts.join(F.broadcast(allowed.where(place < limit).withColumn("weight", weight)), "__cw_id")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    own = own.groupBy("__cw_id", "y", "weight").agg(least, *(F.min(c).alias(c) for c in others))
    return own.select(F.col("__cw_id").alias("key"), F.col("t.text").alias("text"), "y", "weight", *others)
