"""Cleaning of generated text, batch translation, scoring, reruns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as G
from ..operators import outputs as O
from ..operators import prompts as P
from ..operators import tokens as T
from . import fixtures as X
from .fixtures import arr, encoded_ctes, pad_sql, with_ctes
from .prompts import expanded
from .registry import query

S = X.SPECIALS


def raw_outputs(spark, sf):
    """Generated text: prompt and answer, with the suffix doubled, the answer on the next line, or no suffix."""
    rows = P.answer_suffix(P.render_prompt(expanded(spark, sf)))
    kind = F.col("seq") % 4
    text = (
        F.when(kind == 0, F.concat("prompt", F.lit(" "), "tgt_text"))
        .when(kind == 1, F.concat("prompt", F.lit("\n"), "tgt_text"))
        .when(kind == 2, F.concat("prompt", "suffix", F.lit(" "), "tgt_text"))
        .otherwise(F.concat("src_text", F.lit(" "), "tgt_text"))
    )
    return rows.withColumn("output", text)


RAW = {
    "outs": """SELECT seq, ord, direction, src_text, tgt_text, tgt, chr(10)||tgt_name||':' AS suffix, CASE seq % 4
        WHEN 0 THEN prompt||' '||tgt_text WHEN 1 THEN prompt||chr(10)||tgt_text
        WHEN 2 THEN prompt||chr(10)||tgt_name||':'||' '||tgt_text ELSE src_text||' '||tgt_text END AS output FROM prompted""",
    "parts": "SELECT *, string_split(output, suffix) AS p FROM outs",
    "lines": f"""SELECT *, {X.strip_sql('l[1]')} AS l0, {X.strip_sql('l[2]')} AS l1, {X.strip_sql('l[3]')} AS l2,
        {X.strip_sql('string_split(p[3], chr(10))[1]')} AS q0 FROM (SELECT *, string_split(p[2], chr(10)) AS l FROM parts)""",
    "answers": """SELECT *, CASE WHEN l0 <> '' THEN l0 WHEN l1 <> '' THEN l1 WHEN l1 IS NOT NULL THEN l2 END AS a FROM lines""",
}


@query(with_ctes("prompted", "SELECT seq, direction, coalesce(a, q0, '') AS cleaned FROM answers", RAW))
def clean_output(spark, sf):
    return raw_outputs(spark, sf).select("seq", "direction", O.clean_output(F.col("output"), F.col("suffix")).alias("cleaned"))


@query(with_ctes("prompted", """
SELECT direction, count(*) FILTER (l0 <> '') AS ok, count(*) FILTER (NOT coalesce(l0 <> '', false) AND a IS NOT NULL) AS blank,
       count(*) FILTER (a IS NULL AND q0 IS NOT NULL) AS recovered,
       count(*) FILTER (a IS NULL AND q0 IS NULL) AS unrecoverable FROM answers GROUP BY direction""", RAW))
def output_issues(spark, sf):
    return O.output_issues(raw_outputs(spark, sf), "output", "suffix")


@query(with_ctes("prompted", f"SELECT seq, direction, {X.strip_sql('output')} AS cleaned FROM outs", RAW))
def encdec_output(spark, sf):
    return raw_outputs(spark, sf).select("seq", "direction", O.encdec_output(F.col("output")).alias("cleaned"))


@query(with_ctes("instr", f"""
SELECT conv_id, turn, CASE WHEN ok THEN q ELSE output END AS question, CASE WHEN ok THEN r ELSE 'TODO' END AS response,
       {X.strip_sql('output')} AS plain_response
FROM (SELECT *, {X.strip_sql("string_split(p[1], '[INST]')[2]")} AS q, {X.strip_sql('p[2]')} AS r,
      len(p) > 1 AND len(string_split(p[1], '[INST]')) > 1 AS ok
  FROM (SELECT *, string_split(output, ' [/INST]') AS p FROM (SELECT conv_id, turn,
    CASE conv_id % 3 WHEN 0 THEN inputs||' '||targets ELSE '[INST] '||inputs||' [/INST] '||targets END AS output FROM instr)))"""))
def split_qa(spark, sf):
    prefix, suffix = P.ChatTemplate().affixes()
    shown = F.concat(F.lit("[INST] "), "inputs", F.lit(" [/INST] "), "targets")
    rows = X.instructions(spark, sf).withColumn(
        "output", F.when(F.col("conv_id") % 3 == 0, F.concat_ws(" ", "inputs", "targets")).otherwise(shown)
    )
    rows = rows.withColumn("qa", O.split_qa(F.col("output"), prefix, suffix))
    plain = O.split_qa(F.col("output"), "", "")["response"]
    return rows.select("conv_id", "turn", "qa.question", "qa.response", plain.alias("plain_response"))


class EchoBackend:
    """A stand-in translator: the prompt, the forced target code and the beam count."""

    def __call__(self, prompts, settings, target_codes):
        return [f"{p} <{c}|{settings['num_beams']}>" for p, c in zip(prompts, target_codes)]


@query(with_ctes("prompted", """
SELECT direction, seq AS seg_id, prompt||' <'||l.nllb||'|5>' AS output FROM prompted p JOIN langs l ON l.lang = p.tgt"""))
def batch_translate(spark, sf):
    rows = P.render_prompt(expanded(spark, sf)).withColumnRenamed("seq", "seg_id")
    return G.batch_translate(rows, EchoBackend, force_target=True)


class LimitBackend:
    """A stand-in translator that says which limits it was given."""

    def __call__(self, prompts, settings, target_codes):
        return [f"{s}/{n}" for s, n in zip(settings["max_source_length"], settings["max_new_tokens"])]


@query(with_ctes("expanded", """
SELECT direction, seq AS seg_id, CASE WHEN direction = 'fr-en' THEN 2 ELSE 1 END AS run_id,
       CASE WHEN direction = 'fr-en' THEN '512/384' ELSE '256/256' END AS output FROM expanded"""))
def translate_with_limits(spark, sf):
    """Every direction once, one again under longer limits; the backend echoes the limits of the run that counts."""
    rows = P.render_prompt(expanded(spark, sf)).withColumnRenamed("seq", "seg_id")
    first = G.with_limits(rows, {}).withColumn("run_id", F.lit(1))
    again = G.with_limits(rows.filter("direction = 'fr-en'"), {"fr-en": (512, 384)}).withColumn("run_id", F.lit(2))
    return G.latest_run(G.batch_translate(first.unionByName(again), LimitBackend, keys=("direction", "seg_id", "run_id")))


@query(with_ctes("prompted aligned", """
SELECT p.direction, p.seq AS seg_id, p.prompt, a.hypothesis AS output FROM prompted p
LEFT JOIN aligned a ON a.direction = p.direction AND a.seg_id = p.seq AND a.system = 'sysA'"""))
def replay_backend(spark, sf):
    rows = P.render_prompt(expanded(spark, sf)).withColumnRenamed("seq", "seg_id")
    stored = X.aligned(spark, sf).filter("system = 'sysA'").withColumnRenamed("hypothesis", "output")
    return G.replay(rows.select("direction", "seg_id", "prompt"), stored)


class LengthScorer:
    """A stand-in metric: the length ratio to the reference, or to the source without one."""

    def __call__(self, sources, hypotheses, references):
        against = sources if references is None else references
        return [len(h) / max(len(a), 1) for h, a in zip(hypotheses, against)]


@query(with_ctes("aligned", """
SELECT system, direction, seg_id, round(length(hypothesis) / greatest(length(reference), 1), 6) AS score,
       round(length(hypothesis) / greatest(length(source), 1), 6) AS score_free FROM aligned"""))
def score_segments(spark, sf):
    rows = X.aligned(spark, sf)
    free = G.score_segments(rows, LengthScorer, with_reference=False).withColumnRenamed("score", "score_free")
    scored = G.score_segments(rows, LengthScorer).join(free, ["system", "direction", "seg_id"])
    return scored.withColumn("score", F.round("score", 6)).withColumn("score_free", F.round("score_free", 6))


@query(with_ctes("prompted vocab", f"""
SELECT seq, direction, CASE WHEN direction = 'fr-en' THEN 2 ELSE 1 END AS run_id, CASE WHEN direction = 'fr-en' THEN 512 ELSE 256 END AS source_limit,
       {arr(pad_sql('cut', 'lim', S.pad, 'left'))} AS input_ids
FROM (SELECT seq, direction, lim, list_concat([{S.bos}], ids)[1:lim] AS cut
      FROM (SELECT *, CASE WHEN direction = 'fr-en' THEN 512 ELSE 256 END AS lim FROM penc))""",
    encoded_ctes("penc", "prompted", "seq, direction", "prompt")))
def length_retry(spark, sf):
    """All directions once, one of them again with a longer source; the latest run counts."""
    v = X.vocabulary(spark, sf)
    rows = P.render_prompt(expanded(spark, sf)).select("seq", "direction", "prompt")
    first = G.with_limits(rows, {}).withColumn("run_id", F.lit(1))
    again = G.with_limits(rows.filter("direction = 'fr-en'"), {"fr-en": (512, 256)}).withColumn("run_id", F.lit(2))
    encoded = T.encode_test(first.unionByName(again), v, "source_limit")
    runs = encoded.select("seq", "direction", "run_id", "source_limit", X.joined("input_ids").alias("input_ids"))
    return G.latest_run(runs, ("seq", "direction"))
