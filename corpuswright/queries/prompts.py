"""Language dimension, directions, prompts and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators import directions as D
from ..operators import filters as R
from ..operators import prompts as P
from ..sources import lang as L
from . import fixtures as X
from .fixtures import with_ctes
from .registry import query


@query(with_ctes("langs", """
SELECT d.lang, name, nllb, iso3, group_id, count(*) AS docs
FROM documents d JOIN langs l ON l.lang = d.lang GROUP BY ALL"""))
def lang_dim(spark, sf):
    docs = X.mono(spark, sf).groupBy("lang").agg(F.count("*").alias("docs"))
    dim = F.broadcast(L.lang_dim(spark)).drop("prefix", "suffix")
    return docs.join(dim, "lang").select("lang", "name", "nllb", "iso3", "group_id", "docs")


@query(with_ctes("langs", """
SELECT doc_id, d.lang, group_id FROM documents d JOIN langs l ON l.lang = d.lang WHERE d.lang <> 'en'"""))
def lang_group(spark, sf):
    return L.lang_group(X.mono(spark, sf).filter("lang <> 'en'").select("doc_id", "lang"), "lang")


@query(with_ctes("parallel dirs", """
SELECT p.seq, p.lang_a, p.lang_b, min(d.position) AS position FROM parallel p
JOIN dirs d ON d.direction IN (p.lang_a||'-'||p.lang_b, p.lang_b||'-'||p.lang_a) GROUP BY ALL"""))
def requested_pairs(spark, sf):
    dims = D.direction_dim(spark, X.DIRECTIONS).groupBy("pair").agg(F.min("position").alias("position"))
    rows = D.filter_pairs(X.parallel(spark, sf), X.DIRECTIONS).withColumn("pair", F.concat_ws("-", "lang_a", "lang_b"))
    return rows.join(F.broadcast(dims), "pair").select("seq", "lang_a", "lang_b", "position")


@query(with_ctes("expanded", "SELECT seq, ord, src, tgt, direction, src_text, tgt_text FROM expanded"))
def expand_directions(spark, sf):
    return D.expand_directions(X.parallel(spark, sf), X.DIRECTIONS)


def expanded(spark, sf):
    return D.expand_directions(X.parallel(spark, sf), X.DIRECTIONS)


@query(with_ctes("prompted", "SELECT seq, direction, prompt FROM prompted"))
def render_prompt(spark, sf):
    return P.render_prompt(expanded(spark, sf)).select("seq", "direction", "prompt")


@query(with_ctes("prompted", """
SELECT direction, count(*) AS examples, round(avg(length(prompt)), 6) AS mean_chars FROM prompted GROUP BY direction"""))
def prompt_length_by_direction(spark, sf):
    return P.render_prompt(expanded(spark, sf)).groupBy("direction").agg(
        F.count("*").alias("examples"), F.round(F.avg(F.length("prompt")), 6).alias("mean_chars")
    )


# Spanish has no localized prompt and would be an error, so it is not requested here
@query(with_ctes("prompted local", """
SELECT seq, direction, CASE WHEN tgt = 'en' THEN prompt ELSE prefix||src_text||suffix END AS prompt
FROM prompted p JOIN local l ON l.lang = p.tgt WHERE direction <> 'en-es'"""))
def render_prompt_local(spark, sf):
    rows = D.expand_directions(X.parallel(spark, sf), [d for d in X.DIRECTIONS if d != "en-es"])
    return P.render_prompt_local(rows).select("seq", "direction", "prompt")


SHOTS = 5


def shot_table(spark, sf):
    """The first shots per direction, as one array per direction."""
    from ..operators.mixing import take_first

    first = take_first(expanded(spark, sf), SHOTS, "seq", ("direction",))
    listed = F.sort_array(F.collect_list(F.struct("seq", F.col("src_text").alias("source"), F.col("tgt_text").alias("target"))))
    return first.groupBy("direction").agg(
        F.transform(listed, lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"))).alias("shots")
    )


SHOT_CTES = {
    "shots": f"""SELECT direction, string_agg(chr(10)||src_name||': '||src_text||chr(10)||tgt_name||': '||tgt_text, ''
        ORDER BY seq) AS body FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY seq) AS rn FROM prompted)
        WHERE rn <= {SHOTS} GROUP BY direction"""
}


@query(with_ctes("prompted", """
SELECT seq, p.direction, 'Translate this from '||src_name||' to '||tgt_name||':'||body||chr(10)||src_name||': '
  ||src_text||chr(10)||tgt_name||':' AS prompt
FROM prompted p JOIN shots s ON s.direction = p.direction""", SHOT_CTES))
def render_few_shot(spark, sf):
    return P.render_few_shot(expanded(spark, sf), shot_table(spark, sf)).select("seq", "direction", "prompt")


@query(with_ctes("prompted", """
SELECT seq, direction, 'Translate to '||tgt_name||': '||src_text AS instruct, src_text AS plain FROM prompted"""))
def render_encdec(spark, sf):
    rows = P.render_encdec(P.render_encdec(expanded(spark, sf), "instruct", "instruct"), "plain", "plain")
    return rows.select("seq", "direction", "instruct", "plain")


@query(with_ctes("instr", """
SELECT conv_id, turn, '<s>[INST] '||inputs||' [/INST]' AS prompt,
       '<s>[INST] '||inputs||' [/INST] '||targets||'</s>' AS full_text FROM instr"""))
def render_chat(spark, sf):
    t = P.ChatTemplate()
    return X.instructions(spark, sf).select(
        "conv_id", "turn", t.prompt(F.col("inputs")).alias("prompt"),
        t.exchange(F.col("inputs"), F.col("targets")).alias("full_text"),
    )


@query(with_ctes("prompted local", """
SELECT seq, direction, chr(10)||tgt_name||':' AS suffix, chr(10)||tgt_name||': [/INST]' AS chat_suffix,
       l.suffix AS local_suffix
FROM prompted p JOIN local l ON l.lang = p.tgt WHERE direction <> 'en-es'"""))
def answer_suffix(spark, sf):
    rows = D.expand_directions(X.parallel(spark, sf), [d for d in X.DIRECTIONS if d != "en-es"])
    rows = P.answer_suffix(P.answer_suffix(rows), chat_suffix=P.ChatTemplate().affixes()[1], out="chat_suffix")
    rows = P.answer_suffix(rows, localized=True, out="local_suffix")
    return rows.select("seq", "direction", "suffix", "chat_suffix", "local_suffix")


@query(with_ctes("prompted", "SELECT seq, direction, prompt||tgt_text AS full_text FROM prompted"))
def full_text(spark, sf):
    return P.full_text(P.render_prompt(expanded(spark, sf))).select("seq", "direction", "full_text")


@query(with_ctes("parallel", """
SELECT seq, 0 AS side, lang_a AS lang, text_a AS text FROM parallel WHERE text_a <> ''
UNION ALL SELECT seq, 1, lang_b, text_b FROM parallel WHERE text_b <> ''"""))
def drop_empty_sides(spark, sf):
    return R.drop_empty_sides(R.sides(X.parallel(spark, sf)))


@query(f"""
SELECT doc_id, pos, line, {X.strip_sql('line')} AS stripped FROM (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(chr(8195)||text||chr(160)||chr(28), chr(10)) AS p FROM documents))""")
def strip_lines(spark, sf):
    padded = F.concat(F.lit("\u2003"), F.col("raw_text"), F.lit("\u00a0\u001c"))
    lines = X.mono(spark, sf).select("doc_id", F.posexplode(F.split(padded, "\n")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", py_strip(F.col("line")).alias("stripped"))


@query(with_ctes("parallel", f"""
SELECT seq, CASE WHEN {X.uniform_sql('seq')} < 0.5 THEN text_a||' '||text_b ELSE text_b||' '||text_a END AS raw_text
FROM parallel"""))
def join_sides_random(spark, sf):
    return R.join_sides_random(X.parallel(spark, sf), X.SEED).select("seq", "raw_text")


@query(with_ctes("instr", "SELECT conv_id, turn, language_code FROM instr WHERE language_code IN ('deu','eng','fra','spa')"))
def filter_language(spark, sf):
    return R.filter_language(X.instructions(spark, sf), X.DIRECTIONS).select("conv_id", "turn", "language_code")


PREF_EXPANDED = {
    "pexp": """
        SELECT seq, 0 AS ord, lang_a AS src, lang_b AS tgt, text_a AS src_text, required_direction, delta,
               [text_b, sys1_b, sys2_b] AS texts, [ref_score_b, sys1_score_b, sys2_score_b] AS scores FROM prefs
        WHERE lang_a||'-'||lang_b IN (SELECT direction FROM dirs)
        UNION ALL
        SELECT seq, 1, lang_b, lang_a, text_b, required_direction, delta,
               [text_a, sys1_a, sys2_a], [ref_score_a, sys1_score_a, sys2_score_a] FROM prefs
        WHERE lang_b||'-'||lang_a IN (SELECT direction FROM dirs)"""
}


@query(with_ctes("prefs dirs", """
SELECT seq, ord, src, tgt, required_direction FROM pexp
WHERE coalesce(required_direction, '') = '' OR split_part(required_direction, '-', 2) = tgt""", PREF_EXPANDED))
def filter_required_direction(spark, sf):
    from ..operators.preference import expand_preferences

    rows = expand_preferences(X.preferences(spark, sf), X.DIRECTIONS)
    return R.filter_required_direction(rows).select("seq", "ord", "src", "tgt", "required_direction")


@query(with_ctes("instr", """
SELECT conv_id, turn, count(*) FILTER (n <= 64) AS untruncated, count(*) FILTER (n < 64) AS strict, count(*) AS reference
FROM (SELECT conv_id, turn, len(""" + X.words_sql("inputs") + ") AS n FROM instr) GROUP BY ALL"))
def filter_prompt_len(spark, sf):
    from ..functions.text import words

    rows = X.instructions(spark, sf).select("conv_id", "turn", words(F.col("inputs")).alias("ids"))
    tagged = None
    for mode in ("reference", "untruncated", "strict"):
        kept = R.filter_prompt_len(rows, "ids", 64, mode).select("conv_id", "turn", F.lit(mode).alias("mode"))
        tagged = kept if tagged is None else tagged.unionByName(kept)
    flag = lambda m: F.count_if(F.col("mode") == m).alias(m)
    return tagged.groupBy("conv_id", "turn").agg(flag("reference"), flag("untruncated"), flag("strict"))


@query(with_ctes("langs parallel", """
SELECT seq, least(l.nllb, 'eng_Latn')||'-'||greatest(l.nllb, 'eng_Latn') AS config
FROM parallel p JOIN langs l ON l.lang = p.lang_a"""))
def web_pair_key(spark, sf):
    rows = L.with_lang(L.with_lang(X.parallel(spark, sf), "lang_a", "nllb", "code_a"), "lang_b", "nllb", "code_b")
    return rows.select("seq", L.nllb_pair_key(F.col("code_a"), F.col("code_b")).alias("config"))


@query("""
WITH t AS (
    SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations
), s AS (
    SELECT t.*, (SELECT arg_max(c.text, c.turn) FROM conversations c WHERE c.conv_id = t.conv_id AND c.role = 'system'
        AND c.turn < t.turn AND c.turn > coalesce(t.last_user, -1)) AS sys FROM t
)
SELECT conv_id, count(*)::INT AS turns, coalesce(string_agg(CASE role
    WHEN 'user' THEN '<s>[INST] '||CASE WHEN sys IS NULL THEN '' ELSE '<<SYS>>'||chr(10)||sys||chr(10)||'<</SYS>>'||chr(10)||chr(10) END||text||' [/INST]'
    WHEN 'assistant' THEN ' '||text||'</s>' ELSE '' END, '' ORDER BY turn), '') AS chat FROM s GROUP BY conv_id""")
def render_conversations(spark, sf):
    return P.render_conversations(X.table(spark, sf, "conversations"))
