"""Preference pairs: choice, scorers, triples, encoding, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preference as R
from ..operators.prompts import ChatTemplate
from . import fixtures as X
from .fixtures import arr, encoded_ctes, joined, pad_sql, with_ctes
from .prompts import PREF_EXPANDED
from .registry import query

S = X.SPECIALS
MAX, PROMPT, BATCH = 512, 256, 8

CHOICE = {
    **PREF_EXPANDED,
    "choice": """SELECT *, src||'-'||tgt AS direction,
        CASE WHEN coalesce(delta, 0) > 0 THEN texts[2] WHEN coalesce(delta, 0) < 0 THEN texts[3]
             ELSE texts[list_position(scores, list_max(scores))] END AS chosen,
        CASE WHEN coalesce(delta, 0) > 0 THEN texts[3] WHEN coalesce(delta, 0) < 0 THEN texts[2]
             ELSE texts[list_position(scores, list_min(scores))] END AS rejected FROM pexp""",
    "triples": """SELECT c.*, 'Translate this from '||s.name||' to '||t.name||':'||chr(10)||s.name||': '||src_text
        ||chr(10)||t.name||':' AS prompt FROM choice c JOIN langs s ON s.lang = src JOIN langs t ON t.lang = tgt
        WHERE coalesce(required_direction, '') = '' OR split_part(required_direction, '-', 2) = tgt""",
}


@query(with_ctes("prefs dirs", "SELECT seq, ord, delta, chosen, rejected FROM choice", CHOICE | {"triples": "SELECT 1"}))
def choose_pair(spark, sf):
    rows = R.require_scores(R.expand_preferences(X.preferences(spark, sf), X.DIRECTIONS))
    return R.choose_pair(rows).select("seq", "ord", "delta", "chosen", "rejected")


@query(with_ctes("aligned scores", """
SELECT a.direction, a.seg_id, arg_max(hypothesis, [score, -rk]) AS chosen, arg_min(hypothesis, [score, rk]) AS rejected
FROM (SELECT *, CASE system WHEN 'sysC' THEN 0 WHEN 'sysA' THEN 1 ELSE 2 END::DOUBLE AS rk FROM aligned) a
JOIN scores s ON s.direction = a.direction AND s.seg_id = a.seg_id AND s.system = a.system AND s.scorer = 'kiwi'
GROUP BY ALL"""))
def choose_pair_long(spark, sf):
    scores = R.select_scorer(X.scores(spark, sf), "kiwi")
    rows = X.aligned(spark, sf).join(scores, ["direction", "seg_id", "system"])
    return R.choose_pair_long(rows, ["direction", "seg_id"], text="hypothesis", order=("sysC", "sysA", "sysB"))


@query(with_ctes("scores", "SELECT direction, seg_id, system, score FROM scores WHERE scorer = 'comet'"))
def select_scorer(spark, sf):
    return R.select_scorer(X.scores(spark, sf), "comet").select("direction", "seg_id", "system", "score")


@query(with_ctes("prefs dirs langs", "SELECT seq, direction, prompt, chosen, rejected FROM triples", CHOICE))
def preference_triples(spark, sf):
    v = X.vocabulary_of_specials()
    rows = R.preference_triples(X.preferences(spark, sf), X.DIRECTIONS, v)
    return rows.select("seq", "direction", "prompt", "chosen", "rejected")


@query(with_ctes("prefs dirs langs", f"""
SELECT seq, direction, '<s>[INST] '||prompt||' [/INST]' AS prompt, chosen, rejected FROM triples
WHERE len({X.words_sql("'<s>[INST] '||prompt||' [/INST]'")}) <= {PROMPT}""", CHOICE))
def preference_triples_untruncated(spark, sf):
    rows = R.preference_triples(
        X.preferences(spark, sf), X.DIRECTIONS, X.vocabulary(spark, sf), PROMPT, "untruncated", ChatTemplate()
    )
    return rows.select("seq", "direction", "prompt", "chosen", "rejected")


@query(with_ctes("instr", f"""
SELECT conv_id, turn, prompt, targets AS chosen, lower(targets) AS rejected
FROM (SELECT *, '<s>[INST] '||inputs||' [/INST]' AS prompt FROM instr) WHERE len({X.words_sql('prompt')}) < 64"""))
def instruction_triples(spark, sf):
    rows = X.instructions(spark, sf).select(
        "conv_id", "turn", F.col("inputs").alias("prompt"), F.col("targets").alias("chosen"), F.lower("targets").alias("rejected")
    )
    return R.instruction_triples(rows, X.vocabulary_of_specials(), 64)


@query(with_ctes("aligned scores", """
SELECT a.direction, a.seg_id, source, reference,
       max(hypothesis) FILTER (a.system = 'sysA') AS "sysA_text", max(score) FILTER (a.system = 'sysA') AS "sysA_score",
       max(hypothesis) FILTER (a.system = 'sysB') AS "sysB_text", max(score) FILTER (a.system = 'sysB') AS "sysB_score"
FROM aligned a JOIN scores s ON s.direction = a.direction AND s.seg_id = a.seg_id AND s.system = a.system AND s.scorer = 'kiwi'
GROUP BY ALL"""))
def build_preferences(spark, sf):
    scores = R.select_scorer(X.scores(spark, sf), "kiwi")
    return R.build_preferences(X.aligned(spark, sf), scores, ("sysA", "sysB"))


GAPS = {
    "outs": "SELECT * FROM aligned WHERE NOT (system = 'sysB' AND seg_id % 3 = 0) AND seg_id % 7 <> 2",
    "marks": "SELECT * FROM scores WHERE scorer = 'kiwi' AND NOT (system = 'sysA' AND seg_id % 4 = 1)",
    "met": """SELECT coalesce(o.direction, m.direction) AS direction, coalesce(o.seg_id, m.seg_id) AS seg_id,
        coalesce(o.system, m.system) AS system, source, reference, hypothesis, score
        FROM outs o FULL JOIN marks m ON m.direction = o.direction AND m.seg_id = o.seg_id AND m.system = o.system""",
}


@query(with_ctes("aligned scores", """
SELECT direction, seg_id, max(source) AS source, max(reference) AS reference,
       max(hypothesis) FILTER (system = 'sysA') AS "sysA_text", max(score) FILTER (system = 'sysA') AS "sysA_score",
       max(hypothesis) FILTER (system = 'sysB') AS "sysB_text", max(score) FILTER (system = 'sysB') AS "sysB_score"
FROM met GROUP BY direction, seg_id""", GAPS))
def build_preferences_gaps(spark, sf):
    """One system lacks outputs, the other scores, and some segments have scores alone."""
    outputs = X.aligned(spark, sf).filter("NOT (system = 'sysB' AND seg_id % 3 = 0) AND seg_id % 7 <> 2")
    marks = R.select_scorer(X.scores(spark, sf), "kiwi").filter("NOT (system = 'sysA' AND seg_id % 4 = 1)")
    return R.build_preferences(outputs, marks, ("sysA", "sysB"))


def triples(spark, sf, v):
    rows = R.preference_triples(X.preferences(spark, sf), X.DIRECTIONS, v)
    return rows.select("seq", "direction", "prompt", "chosen", "rejected")


ENC = {
    **CHOICE,
    **encoded_ctes("own", "triples", "seq, direction", "prompt"),
    **encoded_ctes("cfull", "triples", "seq, direction", "prompt||chosen"),
    **encoded_ctes("rfull", "triples", "seq, direction", "prompt||rejected"),
    "splits": """SELECT o.seq, o.direction, o.ids AS p, c.ids AS cf, r.ids AS rf,
            CASE WHEN o.ids = c.ids[1:len(o.ids)] THEN len(o.ids) ELSE len(o.ids) - 1 END AS nc,
            CASE WHEN o.ids = r.ids[1:len(o.ids)] THEN len(o.ids) ELSE len(o.ids) - 1 END AS nr
        FROM own o JOIN cfull c ON c.seq = o.seq AND c.direction = o.direction
                   JOIN rfull r ON r.seq = o.seq AND r.direction = o.direction""",
}


@query(with_ctes("prefs dirs langs vocab", f"""
SELECT seq, direction, {arr('cf[1:nc]')} AS prompt_ids, {arr('cf[nc + 1:]')} AS answer_ids FROM splits""", ENC))
def split_answer_tokens(spark, sf):
    v = X.vocabulary(spark, sf)
    rows = triples(spark, sf, v).withColumn("s", R.split_answer(v, F.col("prompt"), F.col("chosen")))
    return rows.select("seq", "direction", joined("s.prompt_ids").alias("prompt_ids"), joined("s.answer_ids").alias("answer_ids"))


def _ended(ids: str) -> str:
    return f"CASE WHEN {ids}[-1] = {S.eos} THEN {ids} ELSE list_concat({ids}, [{S.eos}]) END"


def pref_ctes(mode: str) -> dict[str, str]:
    cut = (lambda p: f"{p}[1:{PROMPT}]") if mode == "keep_start" else (lambda p: f"{p}[greatest(len({p}) - {PROMPT}, 0) + 1:]")
    fit = lambda p: f"CASE WHEN len({p}) + longer > {MAX} THEN {cut(p)} ELSE {p} END"
    short = lambda p, a: f"CASE WHEN len({p}) + longer > {MAX} THEN {a}[1:{MAX - PROMPT}] ELSE {a} END"
    return {
        **ENC,
        "parts": f"""SELECT seq, direction, list_concat([{S.bos}], p[1:least(nc, nr)]) AS p,
            list_concat([{S.bos}], cf[1:nc]) AS pc, list_concat([{S.bos}], rf[1:nr]) AS pr,
            {_ended('cf[nc + 1:]')} AS ac, {_ended('rf[nr + 1:]')} AS ar FROM splits""",
        "fitted": f"""SELECT seq, direction, longer, {fit('p')} AS p, {fit('pc')} AS pc, {fit('pr')} AS pr, ac, ar
            FROM (SELECT *, greatest(len(ac), len(ar)) AS longer FROM parts)""",
        "pref": f"SELECT seq, direction, p, pc, pr, {short('pc', 'ac')} AS ac, {short('pr', 'ar')} AS ar FROM fitted",
    }


PREF_OUT = f"""SELECT seq, direction, {arr('p')} AS prompt_input_ids, {arr('list_concat(pc, ac)')} AS chosen_input_ids,
    {arr('list_concat(pr, ar)')} AS rejected_input_ids, {arr('list_concat([-100 for q in pc], ac)')} AS chosen_labels,
    {arr('list_concat([-100 for q in pr], ar)')} AS rejected_labels FROM pref"""


def _encoded(spark, sf, mode):
    v = X.vocabulary(spark, sf)
    return R.encode_preference(triples(spark, sf, v), v, MAX, PROMPT, mode)


def _pref_columns(rows):
    names = ("prompt_input_ids", "chosen_input_ids", "rejected_input_ids", "chosen_labels", "rejected_labels")
    return rows.select("seq", "direction", *[joined(c).alias(c) for c in names])


@query(with_ctes("prefs dirs langs vocab", PREF_OUT, pref_ctes("keep_end")))
def encode_preference(spark, sf):
    return _pref_columns(_encoded(spark, sf, "keep_end"))


@query(with_ctes("prefs dirs langs vocab", PREF_OUT, pref_ctes("keep_start")))
def encode_preference_keep_start(spark, sf):
    return _pref_columns(_encoded(spark, sf, "keep_start"))


ENCDEC = {
    **CHOICE,
    **encoded_ctes("own", "triples", "seq, direction", "prompt"),
    **encoded_ctes("cenc", "triples", "seq, direction", "chosen"),
    **encoded_ctes("renc", "triples", "seq, direction", "rejected"),
    "three": f"""SELECT o.seq, o.direction, list_concat([{S.bos}], o.ids)[1:256] AS p,
        list_concat([{S.bos}], c.ids)[1:256] AS c, list_concat([{S.bos}], r.ids)[1:256] AS r FROM own o
        JOIN cenc c ON c.seq = o.seq AND c.direction = o.direction JOIN renc r ON r.seq = o.seq AND r.direction = o.direction""",
}


@query(with_ctes("prefs dirs langs vocab", f"""
SELECT seq, direction, {arr('p')} AS prompt_input_ids, {arr('c')} AS chosen_labels, {arr('r')} AS rejected_labels FROM three""", ENCDEC))
def encode_preference_encdec(spark, sf):
    v = X.vocabulary(spark, sf)
    rows = R.encode_preference_encdec(triples(spark, sf, v), v)
    return rows.select("seq", "direction", *[joined(c).alias(c) for c in ("prompt_input_ids", "chosen_labels", "rejected_labels")])


def _stacked_sql(side: int, ids: str, labels: str) -> str:
    return f"""SELECT seq, direction, {side} AS side, {arr(pad_sql(ids, 'width', S.pad))} AS input_ids,
        {arr(pad_sql(f'[1 for q in {ids}]', 'width', 0))} AS attention_mask, {arr(pad_sql(labels, 'width', -100))} AS labels FROM wide"""


@query(with_ctes("prefs dirs langs vocab",
    _stacked_sql(0, "c", "cl") + " UNION ALL " + _stacked_sql(1, "r", "rl"), {
    **pref_ctes("keep_end"),
    "wide": f"""SELECT *, max(greatest(len(c), len(r))) OVER (PARTITION BY direction, seq // {BATCH}) AS width
        FROM (SELECT seq, direction, list_concat(pc, ac) AS c, list_concat(pr, ar) AS r,
              list_concat([-100 for q in pc], ac) AS cl, list_concat([-100 for q in pr], ar) AS rl FROM pref)""",
}))
def stack_pairs(spark, sf):
    batch = F.concat_ws("/", "direction", F.floor(F.col("seq") / BATCH).cast("string"))
    rows = R.stack_pairs(_encoded(spark, sf, "keep_end").withColumn("batch", batch), "batch", S.pad)
    return rows.select("seq", "direction", "side", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def _stacked_encdec(side: int, labels: str) -> str:
    return f"SELECT seq, direction, {side} AS side, {arr('p')} AS input_ids, {arr(pad_sql(labels, 'width', -100))} AS labels FROM wide"


@query(with_ctes("prefs dirs langs vocab", _stacked_encdec(0, "c") + " UNION ALL " + _stacked_encdec(1, "r"), {
    **ENCDEC,
    "wide": f"SELECT *, max(greatest(len(c), len(r))) OVER (PARTITION BY direction, seq // {BATCH}) AS width FROM three",
}))
def stack_pairs_encdec(spark, sf):
    v = X.vocabulary(spark, sf)
    batch = F.concat_ws("/", "direction", F.floor(F.col("seq") / BATCH).cast("string"))
    rows = R.encode_preference_encdec(triples(spark, sf, v), v).withColumn("batch", batch)
    return R.stack_pairs(rows, "batch", S.pad, encdec=True).select(
        "seq", "direction", "side", joined("input_ids").alias("input_ids"), joined("labels").alias("labels")
    )
