"""Corpus BLEU, score averages, reports, rankings and audits over aligned outputs.

Aligned rows: system, direction, seg_id, source, reference, hypothesis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mt_tokens import NO_TOKENIZER, cut_by_grams, for_grams, tokenize, tokenizer_for
from ..functions.ngrams import ORDER, reference_grams, statistics, statistics_stored
from ..functions.text import py_strip

# Fixed value: decimals of the report.
DECIMALS = 2
SEGMENT = ["system", "direction", "seg_id"]


def target_of(direction: Column) -> Column:
    return F.split_part(direction, F.lit("-"), F.lit(2))


def tokenize_aligned(df: DataFrame) -> DataFrame:
    """Add tokenizer, hyp_tokens, ref_tokens; unsupported targets are flagged by NULL tokens."""
    target = target_of(F.col("direction"))
    return (
        df.withColumn("tokenizer", tokenizer_for(target))
        .withColumn("hyp_tokens", tokenize(F.col("hypothesis"), target))
        .withColumn("ref_tokens", tokenize(F.col("reference"), target))
    )


def ngram_stats(aligned: DataFrame) -> DataFrame:
    """Per system and segment: lengths, and for n = 1..4 clipped matches and totals.

    All outputs of a segment meet its reference once: the reference is tokenized and its n-grams are built
    for all systems together. A segment has as many outputs as there are systems. N-grams never leave their row; only
    sums per system and direction move. A missing output (NULL) counts as an empty one, so it costs its reference's
    length; a segment without a reference, or whose target has no tokenizer here, is left out.
    """
    target = target_of(F.col("direction"))
    usable = aligned.filter(F.col("reference").isNotNull() & (tokenizer_for(target) != NO_TOKENIZER))
    segments = usable.groupBy("direction", "seg_id").agg(
        F.any_value("reference").alias("reference"),
        F.collect_list(F.struct("system", F.coalesce("hypothesis", F.lit("")).alias("text"))).alias("outputs"),
    )

    counted = segments.select(
        "direction", "seg_id", F.col("outputs.system").alias("system"),
        statistics(for_grams(F.col("reference"), target), F.transform("outputs", lambda o: for_grams(o["text"], target)), cut_by_grams(target)).alias("s"),
    )
    rows = counted.select("direction", "seg_id", F.inline(F.arrays_zip("system", "s")))
    return rows.select("system", "direction", "seg_id", "s.*")


#: bytes of text that one bucket should hold, and the least number of buckets; read into memory, n-grams take some five times as much
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 8


def store_reference_stats(references: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """The reference side of BLEU as a table, bucketed by segment, for all systems that come later.

    `references` is (direction, seg_id, reference), one row per segment. Length and sorted n-grams are kept (see `reference_grams`); segments
    without a reference, or whose target has no tokenizer here, are left out. A bucket is the share of one task; unless their
    number is given, it follows the bytes of the references.
    """
    target = target_of(F.col("direction"))
    usable = references.filter(F.col("reference").isNotNull() & (tokenizer_for(target) != NO_TOKENIZER))
    if buckets is None:
        size = usable.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    # every bucket is written by one task, as one file; texts move, their n-grams do not
    moved = usable.select("direction", "seg_id", "reference").repartition(buckets, "direction", "seg_id")
    rows = moved.select("direction", "seg_id", reference_grams(for_grams(F.col("reference"), target), cut_by_grams(target)).alias("ref"))
    writer = rows.write.bucketBy(buckets, "direction", "seg_id").sortBy("direction", "seg_id")
    writer.option("path", path).saveAsTable(table)
    return references.sparkSession.table(table)


def ngram_stats_stored(outputs: DataFrame, stored: DataFrame) -> DataFrame:
    """`ngram_stats` of (system, direction, seg_id, hypothesis) against stored references: a system costs its own outputs alone.

    The stored side lies in its buckets and does not move; outputs shuffle once, to them. Outputs of unknown segments are left out.
    """
    target = target_of(F.col("direction"))
    met = outputs.select("system", "direction", "seg_id", F.coalesce("hypothesis", F.lit("")).alias("text")).join(
        stored, ["direction", "seg_id"]
    )
    return met.select("system", "direction", "seg_id", statistics_stored(for_grams(F.col("text"), target), F.col("ref"), cut_by_grams(target)).alias("s")).select(
        "system", "direction", "seg_id", "s.*"
    )


def corpus_bleu(stats: DataFrame, by: list[str] = ["system", "direction"]) -> DataFrame:  # noqa: B006
    """Corpus BLEU per system and direction: clipped precisions, exponential smoothing, brevity penalty."""
    parts = [f"{k}{n}" for n in range(1, ORDER + 1) for k in ("match", "total")]
    sums = stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("hyp_len", "ref_len", *parts)])
    log_sum, smooth = F.lit(0.0), F.lit(1.0)
    defined = F.lit(True)
    for n in range(1, ORDER + 1):
        match, total = F.col(f"match{n}"), F.col(f"total{n}")
        smooth = F.when(match == 0, smooth * 2).otherwise(smooth)
        precision = F.when(match == 0, 100 / (smooth * total)).otherwise(100.0 * match / total)
        log_sum = log_sum + F.ln(precision)
        defined = defined & (total > 0)
    any_match = sum((F.col(f"match{n}") for n in range(1, ORDER + 1)), F.lit(0)) > 0
    penalty = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.col("hyp_len"))
    )
    score = F.when(defined & any_match, penalty * F.exp(log_sum / ORDER)).otherwise(F.lit(0.0))
    return sums.withColumn("bleu", F.round(score, DECIMALS))


def bleu(aligned: DataFrame) -> DataFrame:
    """(system, direction, bleu); unsupported tokenizers are left out (see `tokenize_aligned`)."""
    return corpus_bleu(ngram_stats(aligned)).select("system", "direction", "bleu")


def system_score(scores: DataFrame, by: tuple[str, ...] = ("system", "direction", "scorer")) -> DataFrame:
    """Mean segment score per scorer."""
    return scores.groupBy(*by).agg(F.avg("score").alias("score"), F.count("score").alias("segments"))


def report(bleu_scores: DataFrame, system_scores: DataFrame, directions: DataFrame, scorers: list[str]) -> DataFrame:
    """One row per system and requested direction: BLEU and every scorer's mean, in request order.

    Requested directions without any result are kept, with NULL metrics.
    """
    wide = system_scores.groupBy("system", "direction").pivot("scorer", scorers).agg(F.max("score"))
    metrics = bleu_scores.join(wide, ["system", "direction"], "full")
    request = directions.select("position", "direction")
    return request.join(metrics, "direction", "left").select("position", "direction", "system", "bleu", *scorers)


def report_long(report_rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per direction × system × metric."""
    return report_rows.unpivot(["position", "direction", "system"], metrics, "metric", "value")


def leaderboard(long_report: DataFrame) -> DataFrame:
    """Rank of the systems per direction and metric, ties share a rank."""
    over = W.partitionBy("direction", "metric").orderBy(F.desc("value"))
    return long_report.filter(F.col("system").isNotNull()).withColumn("rank", F.rank().over(over))


def alignment_audit(source: DataFrame, reference: DataFrame, output: DataFrame, systems: list[str]) -> DataFrame:
    """Per system and direction: line counts of the three sides, lines missing from each, blank outputs.

    Inputs are (direction, seg_id, text), the output also has `system`. The three sides are one table of narrow rows,
    grouped once per segment. A direction without any output of one of the given systems shows zero output lines for it;
    a segment that only outputs have counts as their line.
    """
    none = F.lit(None).cast("string")
    blank = (py_strip(F.col("text")) == "").alias("blank")
    no = F.lit(None).cast("boolean").alias("blank")
    sides = (
        source.select("direction", "seg_id", F.lit("src").alias("role"), none.alias("system"), no)
        .unionByName(reference.select("direction", "seg_id", F.lit("ref").alias("role"), none.alias("system"), no))
        .unionByName(output.select("direction", "seg_id", F.lit("out").alias("role"), "system", blank))
    )
    of_system = [
        F.struct(
            F.lit(s).alias("system"),
            F.count_if(F.col("system") == s).alias("n"),
            F.count_if((F.col("system") == s) & F.col("blank")).alias("blanks"),
        )
        for s in systems
    ]
    segments = sides.groupBy("direction", "seg_id").agg(
        F.count_if(F.col("role") == "src").alias("src"), F.count_if(F.col("role") == "ref").alias("ref"), F.array(*of_system).alias("o")
    )
    rows = segments.select("direction", "src", "ref", F.inline("o"))
    has = lambda c: F.sum(c).cast("long")
    return rows.groupBy("system", "direction").agg(
        has("src").alias("source_lines"),
        has("ref").alias("reference_lines"),
        has("n").alias("output_lines"),
        F.count_if((F.col("src") > 0) & (F.col("ref") == 0)).alias("missing_reference"),
        F.count_if((F.col("src") > 0) & (F.col("n") == 0)).alias("missing_output"),
        has("blanks").alias("blank_outputs"),
    )


def best_system(scores: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Per segment and scorer the best system; ties go to the earlier system of `order`."""
    rank = F.coalesce(*[F.when(F.col("system") == s, F.lit(-i)) for i, s in enumerate(order)])
    return scores.groupBy("scorer", "direction", "seg_id").agg(
        F.max_by("system", F.struct(F.col("score"), rank)).alias("system")
    )


def win_counts(scores: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return best_system(scores, order).groupBy("scorer", "direction", "system").agg(F.count("*").alias("wins"))
