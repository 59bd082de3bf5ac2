"""Translate, clean, score and report: all directions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators import evaluate as E
from ..operators import inference as G
from ..operators import outputs as O
from ..operators import prompts as P
from ..operators.directions import direction_dim
from ..session import cut_lineage
from ..sources.sinks import write_qa_jsonl
from .options import Options
from .training import TEMPLATE, instruction_prompts, prompts_to_translate


def translate(
    spark: SparkSession,
    opts: Options,
    make_backend: Callable[[], G.Backend],
    settings: G.GenerationSettings = G.GenerationSettings(),
    retry: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """(direction, seg_id, output): cleaned translations of the test sets.

    The directions of `retry` are run again under longer limits (source length, new tokens), as in `RETRY_LIMITS`; of
    the runs of a segment the latest counts.
    """
    prompts = prompts_to_translate(spark, opts)
    runs = G.with_limits(prompts, {}, settings).withColumn("run_id", F.lit(1))
    if retry:
        again = prompts.filter(F.col("direction").isin(list(retry)))
        runs = runs.unionByName(G.with_limits(again, retry, settings).withColumn("run_id", F.lit(2)))
    keys = ("direction", "seg_id", "run_id")
    generated = G.batch_translate(runs, make_backend, settings, keys, opts.encdec == "plain")
    generated = G.latest_run(generated).drop("run_id") if retry else generated.drop("run_id")
    if opts.encdec:
        return generated.withColumn("output", O.encdec_output(F.col("output")))
    with_tgt = generated.withColumn("tgt", F.split_part("direction", F.lit("-"), F.lit(2)))
    chat_suffix = TEMPLATE.affixes()[1] if opts.chat else ""
    suffixed = P.answer_suffix(with_tgt, opts.local_prompts, chat_suffix)
    k = F.lit(1)
    if opts.shots:
        from ..sources.readers import read_shots

        counts = read_shots(spark, opts.shots, opts.directions).select("direction", (F.size("shots") + 1).alias("__k"))
        suffixed, k = suffixed.join(counts, "direction"), F.col("__k")
    cleaned = O.clean_output(py_strip(F.col("output")), F.col("suffix"), k)
    return suffixed.select("direction", "seg_id", cleaned.alias("output"))


def evaluate(
    aligned: DataFrame, scores: DataFrame, directions: str | list[str], scorers: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(report, leaderboard) of aligned outputs and their segment scores."""
    dims = direction_dim(aligned.sparkSession, directions)
    report = E.report(E.bleu(aligned), E.system_score(scores), dims, scorers)
    return report, E.leaderboard(E.report_long(report, ["bleu", *scorers]))


def answer_instructions(
    spark: SparkSession,
    opts: Options,
    make_backend: Callable[[], G.Backend],
    out_dir: str,
    settings: G.GenerationSettings = G.GenerationSettings(),
) -> DataFrame:
    """Instruction test rows → prompts → answers, split into question and response and written as JSON lines.

    Returns (lang, seq, question, response, failed).
    """
    rows = instruction_prompts(spark, opts)
    answers = G.batch_translate(rows, make_backend, settings, ("lang", "seq"))
    prefix, suffix = TEMPLATE.affixes() if opts.chat else ("", "")
    out = answers.select("lang", "seq", O.split_qa(F.col("output"), prefix, suffix).alias("qa")).select("lang", "seq", "qa.*")
    out = cut_lineage(out, "answers")
    write_qa_jsonl(out, out_dir)
    return out
