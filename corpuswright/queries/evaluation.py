"""Corpus BLEU, averages, reports, ranks and audits of three systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mt_tokens as M
from ..functions.text import PY_SPACE
from ..operators import directions as D
from ..operators import evaluate as E
from ..session import cut_lineage, release, work_dir
from . import fixtures as X
from .fixtures import lit, with_ctes
from .registry import query


def rules_sql(text: str) -> str:
    for pattern, kind in M.RULES:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(M.replacement(kind, chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({text}, '[{PY_SPACE}]+'), lambda w: w <> '')"


def tokens_13a_sql(text: str) -> str:
    text = f"replace(replace(replace({text}, '<skipped>', ''), '-'||chr(10), ''), chr(10), ' ')"
    for entity, char in M.ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return rules_sql(f"(' '||{text}||' ')")


def tokens_zh_sql(text: str) -> str:
    return rules_sql(f"regexp_replace({X.strip_sql(text)}, '([{M.CJK}])', ' \\1 ', 'g')")


@query(f"SELECT doc_id, array_to_string({tokens_13a_sql('text')}, ' ') AS tokens FROM documents")
def tokenize_13a(spark, sf):
    return X.mono(spark, sf).select("doc_id", F.array_join(M.tokenize_13a(F.col("raw_text")), " ").alias("tokens"))


# letters with accents become Chinese characters, so that the rule that isolates them has work to do
def _sinified(c):
    return F.translate(c, "éèàñü", "的是一。“")


@query(f"""SELECT doc_id, array_to_string({tokens_zh_sql("translate(text, 'éèàñü', '的是一。“')")}, ' ') AS tokens FROM documents""")
def tokenize_zh(spark, sf):
    return X.mono(spark, sf).select("doc_id", F.array_join(M.tokenize_zh(_sinified(F.col("raw_text"))), " ").alias("tokens"))


@query(with_ctes("parallel", """
SELECT seq, CASE lang_a WHEN 'zh' THEN 'zh' WHEN 'ja' THEN 'ja-mecab' ELSE '13a' END AS tokenizer FROM parallel"""))
def tokenizer_choice(spark, sf):
    return X.parallel(spark, sf).select("seq", M.tokenizer_for(F.col("lang_a")).alias("tokenizer"))


def _orders(col: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT system, direction, seg_id, {n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS gram, {int(col == 'h')} AS h, {int(col == 'r')} AS r
        FROM (SELECT system, direction, seg_id, {col} AS t, unnest(range(1, len({col}) - {n - 2})) AS i FROM toks WHERE len({col}) >= {n})"""
        for n in range(1, 5)
    )


STATS = {
    "toks": f"SELECT system, direction, seg_id, {tokens_13a_sql('hypothesis')} AS h, {tokens_13a_sql('reference')} AS r FROM aligned",
    "grams": f"""SELECT system, direction, seg_id, n, gram, sum(h) AS h, sum(r) AS r
        FROM ({_orders('h')} UNION ALL {_orders('r')}) GROUP BY ALL""",
    "sums": "SELECT system, direction, seg_id, "
    + ", ".join(
        f"coalesce(sum(least(h, r)) FILTER (n = {n}), 0)::BIGINT AS match{n}, coalesce(sum(h) FILTER (n = {n}), 0)::BIGINT AS total{n}"
        for n in range(1, 5)
    )
    + " FROM grams GROUP BY ALL",
    "stats": "SELECT t.system, t.direction, t.seg_id, len(t.h) AS hyp_len, len(t.r) AS ref_len, "
    + ", ".join(f"coalesce({k}{n}, 0) AS {k}{n}" for n in range(1, 5) for k in ("match", "total"))
    + """ FROM toks t LEFT JOIN sums s ON s.system = t.system AND s.direction = t.direction AND s.seg_id = t.seg_id""",
}
_S = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in ["hyp_len", "ref_len", *[f"{k}{n}" for n in range(1, 5) for k in ("match", "total")]])
_PREC = " + ".join(
    f"""ln(CASE WHEN match{n} = 0 THEN 100 / (power(2, {' + '.join(f'(match{m} = 0)::INT' for m in range(1, n + 1))}) * total{n})
        ELSE 100 * match{n} / total{n} END)"""
    for n in range(1, 5)
)
BLEU = {
    **STATS,
    "corpus": f"SELECT system, direction, {_S} FROM stats GROUP BY ALL",
    "bleu": f"""SELECT system, direction, CASE WHEN least(total1, total2, total3, total4) > 0 AND match1 > 0 THEN
        round(CASE WHEN hyp_len > ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len) END * exp(({_PREC}) / 4), 2) ELSE 0 END AS bleu FROM corpus""",
}
SYS = {"means": "SELECT system, direction, scorer, avg(score) AS score, count(*) AS segments FROM scores GROUP BY ALL"}


@query(with_ctes("aligned", "SELECT * FROM stats", STATS))
def ngram_stats(spark, sf):
    return E.ngram_stats(X.aligned(spark, sf))


@query(with_ctes("aligned", "SELECT * FROM stats", STATS))
def ngram_stats_stored(spark, sf):
    """References stored once; each system is then scored by itself. The segments are joined and written once, for all that read them."""
    segments, path = cut_lineage(X.segments_of(X.parallel(spark, sf)).drop("source"), "segments"), work_dir(spark, "references")
    release(spark)
    stored = E.store_reference_stats(segments, path.rsplit("/", 1)[1].replace("-", "_"), path)
    release(spark)
    rows = X.answered(segments)
    parts = [E.ngram_stats_stored(rows.filter(F.col("system") == s).drop("reference"), stored) for s in X.SYSTEMS]
    return reduce(DataFrame.unionByName, parts)


@query(with_ctes("aligned", "SELECT system, direction, bleu FROM bleu", BLEU))
def corpus_bleu(spark, sf):
    return E.bleu(X.aligned(spark, sf))


@query(with_ctes("scores", "SELECT system, direction, scorer, round(score, 6) AS score, segments FROM means", SYS))
def system_score(spark, sf):
    return E.system_score(X.scores(spark, sf)).withColumn("score", F.round("score", 6))


def report_rows(spark, sf):
    dims = D.direction_dim(spark, X.DIRECTIONS)
    means = E.system_score(X.scores(spark, sf)).withColumn("score", F.round("score", 6))
    return E.report(E.bleu(X.aligned(spark, sf)), means, dims, list(X.SCORERS))


REPORT = {
    **BLEU,
    **SYS,
    "report": """SELECT d.position, d.direction, b.system, b.bleu, round(c.score, 6) AS comet, round(k.score, 6) AS kiwi FROM dirs d
        LEFT JOIN bleu b ON b.direction = d.direction
        LEFT JOIN means c ON c.direction = b.direction AND c.system = b.system AND c.scorer = 'comet'
        LEFT JOIN means k ON k.direction = b.direction AND k.system = b.system AND k.scorer = 'kiwi'""",
    "long": """SELECT position, direction, system, 'bleu' AS metric, bleu AS value FROM report
        UNION ALL SELECT position, direction, system, 'comet', comet FROM report
        UNION ALL SELECT position, direction, system, 'kiwi', kiwi FROM report""",
}


@query(with_ctes("aligned scores dirs", "SELECT * FROM report", REPORT))
def report(spark, sf):
    return report_rows(spark, sf)


@query(with_ctes("aligned scores dirs", """
SELECT position, direction, system, metric, value, rank() OVER (PARTITION BY direction, metric ORDER BY value DESC) AS rank
FROM long WHERE system IS NOT NULL""", REPORT))
def leaderboard(spark, sf):
    return E.leaderboard(E.report_long(report_rows(spark, sf), ["bleu", *X.SCORERS]))


AUDIT = {
    "outs": """SELECT a.system, a.direction, a.seg_id, a.hypothesis AS text FROM aligned a
        WHERE a.system <> 'sysB' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.seg_id)""",
    "srcs": "SELECT lang_a||'-en' AS direction, seq AS seg_id, text_a AS text FROM parallel",
    "expect": "SELECT s.direction, s.seg_id, y.system FROM srcs s CROSS JOIN (SELECT DISTINCT system FROM outs) y",
}


@query(with_ctes("aligned", f"""
SELECT e.system, e.direction, count(*) AS source_lines, count(*) AS reference_lines, count(o.seg_id) AS output_lines,
       0 AS missing_reference, count(*) FILTER (o.seg_id IS NULL) AS missing_output,
       count(*) FILTER ({X.strip_sql('o.text')} = '') AS blank_outputs
FROM expect e LEFT JOIN outs o ON o.system = e.system AND o.direction = e.direction AND o.seg_id = e.seg_id GROUP BY ALL""", AUDIT))
def alignment_audit(spark, sf):
    """One system has outputs only for labelled documents, which the audit must report."""
    rows = X.aligned(spark, sf)
    labelled = X.table(spark, sf, "labels").select(F.col("doc_id").alias("seg_id"))
    partial = rows.filter("system = 'sysB'").join(labelled, "seg_id", "left_semi")
    outputs = rows.filter("system <> 'sysB'").unionByName(partial).select("system", "direction", "seg_id", F.col("hypothesis").alias("text"))
    seg = X.parallel(spark, sf).select(
        F.concat(F.col("lang_a"), F.lit("-en")).alias("direction"), F.col("seq").alias("seg_id"), "text_a", "text_b"
    )
    source = seg.select("direction", "seg_id", F.col("text_a").alias("text"))
    reference = seg.select("direction", "seg_id", F.col("text_b").alias("text"))
    return E.alignment_audit(source, reference, outputs, list(X.SYSTEMS))


@query(with_ctes("scores", """
SELECT scorer, direction, seg_id, arg_max(system, [score, -ascii(system[4])]) AS system FROM scores GROUP BY ALL"""))
def best_system(spark, sf):
    return E.best_system(X.scores(spark, sf), X.SYSTEMS)


@query(with_ctes("scores", """
SELECT scorer, direction, system, count(*) AS wins FROM (
  SELECT scorer, direction, seg_id, arg_max(system, [score, -ascii(system[4])]) AS system FROM scores GROUP BY ALL) GROUP BY ALL"""))
def win_counts(spark, sf):
    return E.win_counts(X.scores(spark, sf), X.SYSTEMS)
