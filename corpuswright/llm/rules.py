"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw texts, with DataFrame functions only.

Two multinomials over `BUCKETS` hashed n-grams are counted: one over all texts of the corpus, one over trusted texts, a
bounded sample of labelled documents. Both are smoothed by adding `PRIOR`. The n-grams are words, pairs of words, and
pairs of word shapes (letters and digits folded to a, A and 0, marks kept). A document's score is the mean over its
n-grams of log(trusted share / raw share); it is kept if the score reaches `THRESHOLD` and no base rule fails. Scores and
verdicts cover every whole text.

Counting makes a row of each word with its follower, so that hashing and summing are compiled, and shuffles at most `BUCKETS`
partial sums per task. Scoring stays inside a text's row: its words are cut and hashed once; pairs and windows are made of these
hashes, side by side with themselves shifted, and serve the score and the base counts alike, each a column of its own, since Spark
compiles what stands outside a lambda. The table of ratios has `BUCKETS` numbers whatever the corpus and stands in the plan as a
constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .samples import labelled_sample, learnable

BUCKETS = 1 << 16
PRIOR = 1.0
#: least mean log ratio of a document that is kept
THRESHOLD = -0.3
LEAST_WORDS = 50
REPEAT_PERCENT = 50
PLACE_BITS = 20
#: bound of the trusted sample in documents
TRUSTED = 10_000


def word_list(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def _shape(text: Column) -> Column:
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), r"[a-z\x{80}-\x{10FFFF}]+", "a")
    return F.regexp_replace(F.regexp_replace(folded, "[A-Z]+", "A"), "[0-9]+", "0")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(hashed: Column) -> Column:
    """The remainder by `BUCKETS`, a power of two."""
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _joined(left: Column, right: Column, skip: int, as_=lambda h: h) -> Column:
    """A hash of each entry of `left` with the entry of `right` that stands `skip` places on, for bound arrays."""
    room = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), room), F.slice(right, F.lit(1 + skip), room), lambda a, b: as_(F.xxhash64(a, b)))


def cut(text: Column) -> Column:
    """Struct of the characters in a text's words, their hashes, the hashes of word pairs and the buckets of shape pairs, to be bound."""
    whole = let(word_list(text), lambda w: F.struct(F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _hashes(w).alias("hashes")))
    shapes = let(_hashes(word_list(_shape(text))), lambda s: _joined(s, s, 1, _bucket))
    return let(whole, lambda x: F.struct(
        x["chars"].alias("chars"), x["hashes"].alias("hashes"), _joined(x["hashes"], x["hashes"], 1).alias("pairs"), shapes.alias("shapes")))


def windows_of(pairs: Column, hashes: Column) -> Column:
    """A hash of each 3-word window, from hashes of pairs and words."""
    return _joined(pairs, hashes, 2)


def repetitions(windows: Column) -> Column:
    """Windows that are there already."""
    return F.size(windows) - F.size(F.array_distinct(windows))


def repeated_words(pairs: Column, hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, the first included, from bound hashes of pairs and words."""
    return let(windows_of(pairs, hashes), lambda w: let(repetitions(w), lambda again: covered_words(w, again)))


def covered_words(windows: Column, again: Column) -> Column:
    """Words that lie in windows found twice or more, from bound windows and their number of repetitions.

    Many texts end with the first question, whether any window occurs twice. For the others windows are sorted with their
    places behind them, so that equal ones stand side by side, and the places of these are put in order: each covers three words,
    or as many as there are up to the next. Window and place are one long, 44 bits of the hash above 20 of the place, if the
    text has fewer windows than 2²⁰ and the 44 bits tell as many windows apart as all 64 do: then neighbours that agree are
    as many as the repetitions. Else they are two.
    """
    low = (1 << PLACE_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def neighbours(ordered: Column, same, places) -> Column:
        """Places of each entry and its follower, where the two are the same window."""
        return F.array_compact(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(same(a, b), places(a, b))))

    def spread(found: Column) -> Column:
        # a place that stands there twice covers nothing more
        return let(F.sort_array(F.flatten(found)), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda n, k: n + k))

    packed = F.sort_array(F.transform(windows, lambda h, p: h.bitwiseAND(F.lit(~low)).bitwiseOR(p.cast("long"))))
    one = let(packed, lambda x: neighbours(x, lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0, lambda a, b: F.array(place(a), place(b))))
    pairs = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))
    two = let(pairs, lambda x: neighbours(x, lambda a, b: a["h"] == b["h"], lambda a, b: F.array(a["p"], b["p"])))
    places = let(F.when(F.size(windows) <= low, one), lambda x: F.when(F.size(x) == again, spread(x)).otherwise(spread(two)))
    return F.when(again == 0, F.lit(0)).otherwise(places).cast("long")


def buckets(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row `b` per hashed n-gram of the texts: words, word pairs, shape pairs."""
    after = lambda words: F.slice(words, F.lit(2), F.size(words))
    h = F.xxhash64
    cuts = texts.select(word_list(F.col(text_col)).alias("w"), word_list(_shape(F.col(text_col))).alias("s"))
    # a text has as many shapes as words; the last of both has no follower
    steps = cuts.select(F.inline(F.arrays_zip("w", after(F.col("w")), "s", after(F.col("s")))).alias("w", "w2", "s", "s2"))
    pair = lambda a, b: F.when(F.col(b).isNotNull(), _bucket(h(h(a), h(b))))
    return steps.select(F.explode(F.array(_bucket(h("w")), pair("w", "w2"), pair("s", "s2"))).alias("b")).where("b is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame, text_col: str = "text") -> list[float]:
    """log(trusted share / raw share) of each bucket, both shares smoothed by `PRIOR`."""

    def count(texts: DataFrame) -> dict[int, int]:
        return {r["b"]: r["n"] for r in buckets(texts, text_col).groupBy("b").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS rows

    raw, good = count(docs), count(trusted)
    n_raw, n_good = sum(raw.values()) + PRIOR * BUCKETS, sum(good.values()) + PRIOR * BUCKETS
    return [math.log((good.get(b, 0) + PRIOR) / n_good) - math.log((raw.get(b, 0) + PRIOR) / n_raw) for b in range(BUCKETS)]


def ratio_score(parts: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams of a cut text; 0 for a text without any."""
    # one string that the optimizer folds to a constant array
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    grams = F.concat(F.transform(F.concat(parts["hashes"], parts["pairs"]), _bucket), parts["shapes"])
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b))
    n = F.size(parts["hashes"]) + F.size(parts["pairs"]) + F.size(parts["shapes"])
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def judge_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", trusted: int = TRUSTED, threshold: float = THRESHOLD,
                  learn=learnable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, the base counts, base_failed, score, kept.

    Trusted are about `trusted` documents of label 1 at most, among the rows that may be learnt from. Without any, all
    scores are 0 or follow the prior alone and only the base rules speak. Null and empty texts fail the base rules. Repeated rows are
    judged row by row.
    """
    good = labelled_sample(docs, labels.where(F.col(label) == 1), label, trusted, learn, id_col, text_col).select(F.col("text").alias(text_col))
    ratios = log_ratios(docs.select(text_col), good, text_col)
    if not any(ratios):
        ratios = [0.0] * BUCKETS
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts, windows = F.col("x"), F.col("w")
    out = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), cut(text).alias("x"))
        .select("doc_id", "text", "x", windows_of(parts["pairs"], parts["hashes"]).alias("w"))
        .select("doc_id", "text", "x", "w", repetitions(windows).alias("again"))
        .select(
            "doc_id",
            F.size(parts["hashes"]).cast("long").alias("n_words"),
            parts["chars"].alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("text")).alias("n_dup_lines"),
            covered_words(windows, F.col("again")).alias("n_repeat_words"),
            ratio_score(parts, ratios).alias("score"),
        )
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
