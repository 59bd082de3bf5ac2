"""Losses over logged logits: an embedding is the logits of one token over a 64-word vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from . import fixtures as X
from .fixtures import with_ctes
from .registry import query

BETA, PAIRS = 0.1, 5


def token_rows(spark, sf):
    """Ten tokens per sequence, two sequences per pair; the first three labels belong to the prompt."""
    e = X.table(spark, sf, "embeddings")
    seq = F.floor(F.col("vec_id") / 10).cast("long")
    pos = (F.col("vec_id") % 10).cast("int")
    return e.select(
        F.floor(seq / 2).cast("long").alias("pair"),
        seq.alias("seq"),
        (seq % 2 == 0).alias("chosen"),
        pos.alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(pos < 3, F.lit(-100)).otherwise(F.col("label")).alias("label"),
    )


def tokens(spark, sf):
    # partitioned by pair once: the label shift, the sequence sums and the pairing all reuse it
    return L.token_table(token_rows(spark, sf).repartition("pair"), ["pair", "seq"])


def pairs(spark, sf, loss_type="sigmoid", penalty=None):
    table = L.pair_table(tokens(spark, sf), ["pair"], "chosen", loss_type)
    rows = L.rewards(L.preference_loss(L.adaptive_penalty(table, penalty=penalty), loss_type, BETA), BETA)
    return rows.withColumn("batch", F.floor(F.col("pair") / PAIRS).cast("long")).withColumn(
        "phase", F.when(F.col("batch") % 2 == 0, F.lit("train")).otherwise(F.lit("eval"))
    )


def r6(c):
    return F.round(c, 6)


CTES = {
    "raw": """SELECT vec_id // 20 AS pair, vec_id // 10 AS seq, (vec_id // 10) % 2 = 0 AS chosen, vec_id % 10 AS pos,
        embedding::DOUBLE[] AS x, CASE WHEN vec_id % 10 < 3 THEN -100 ELSE label END AS label FROM embeddings""",
    "shifted": "SELECT *, lead(label) OVER (PARTITION BY pair, seq ORDER BY pos) AS target FROM raw",
    "tok": """SELECT *, CASE WHEN target <> -100 THEN x[target + 1] - (list_max(x)
        + ln(list_sum([exp(v - list_max(x)) for v in x]))) END AS logp FROM shifted""",
    "pairs": """SELECT pair, coalesce(sum(logp) FILTER (chosen), 0) AS cl, coalesce(sum(logp) FILTER (NOT chosen), 0) AS rl,
        avg(logp) FILTER (chosen) AS cm, avg(logp) FILTER (NOT chosen) AS rm,
        count(*) FILTER (chosen AND label <> -100) AS cn, count(*) FILTER (NOT chosen AND label <> -100) AS rn,
        sum(list_sum(x)) FILTER (chosen) AS cx, sum(list_sum(x)) FILTER (NOT chosen) AS rx,
        sum(len(x)) FILTER (chosen) AS cxn, sum(len(x)) FILTER (NOT chosen) AS rxn,
        -sum(logp) FILTER (chosen) AS nll_sum, count(logp) FILTER (chosen) AS nll_n FROM tok GROUP BY pair""",
    "pen": "SELECT *, least(0.9 * exp(0.4 * abs(cl / cn - rl / rn)) - 1, 1.0) AS p FROM pairs",
    "penm": "SELECT *, least(0.9 * exp(0.4 * abs(cm / cn - rm / rn)) - 1, 1.0) AS p FROM pairs",
    "loss": f"""SELECT *, ln(1 + exp(-{BETA} * (cl - p * rl))) AS loss, pair // {PAIRS} AS batch,
        CASE WHEN (pair // {PAIRS}) % 2 = 0 THEN 'train' ELSE 'eval' END AS phase FROM pen""",
}


def sql(body):
    return with_ctes("", body, CTES)


@query(sql("SELECT seq, pos, target, round(logp, 6) AS logp FROM tok"))
def token_logp(spark, sf):
    return tokens(spark, sf).select("seq", "pos", "target", r6(F.col("logp")).alias("logp"))


@query(sql("SELECT seq, round(sum(logp), 6) AS total, round(avg(logp), 6) AS mean FROM tok GROUP BY seq"))
def sequence_logp(spark, sf):
    t = tokens(spark, sf)
    total = L.sequence_logp(t, ["pair", "seq"]).withColumnRenamed("logp", "total")
    mean = L.sequence_logp(t, ["pair", "seq"], True).withColumnRenamed("logp", "mean")
    return total.join(mean, ["pair", "seq"]).select("seq", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"))


@query(sql("SELECT seq, count(*) FILTER (label <> -100) AS n_tokens FROM raw GROUP BY seq"))
def non_pad_count(spark, sf):
    return L.non_pad_count(token_rows(spark, sf), ["seq"])


@query(sql("SELECT pair, round(p, 6) AS penalty, round(cl - p * rl, 6) AS margin, round(cl - rl, 6) AS plain FROM pen"))
def adaptive_penalty(spark, sf):
    rows = pairs(spark, sf)
    plain = L.adaptive_penalty(rows.select("pair", "chosen_logp", "rejected_logp", "penalty", F.col("margin").alias("m")), penalty=1)
    adaptive = rows.select("pair", r6(F.col("penalty")).alias("penalty"), r6(F.col("margin")).alias("margin"))
    return adaptive.join(plain.select("pair", r6(F.col("margin")).alias("plain")), "pair")


@query(sql(f"""
SELECT pair, round(ln(1 + exp(-{BETA} * m)), 6) AS sigmoid,
       round(0.9 * ln(1 + exp(-{BETA} * m)) + 0.1 * ln(1 + exp({BETA} * m)), 6) AS smoothed,
       round(greatest(1 - {BETA} * m, 0), 6) AS hinge FROM (SELECT *, cl - p * rl AS m FROM pen)"""))
def preference_loss(spark, sf):
    rows = pairs(spark, sf)
    rows = L.preference_loss(rows, "sigmoid", BETA, out="sigmoid")
    rows = L.preference_loss(rows, "sigmoid", BETA, 0.1, out="smoothed")
    rows = L.preference_loss(rows, "hinge", BETA, out="hinge")
    return rows.select("pair", *[r6(F.col(c)).alias(c) for c in ("sigmoid", "smoothed", "hinge")])


@query(sql(f"""
SELECT pair, round(power(m - 1 / (2 * {BETA}), 2), 6) AS ipo, round(ln(1 + exp(-{BETA} * (m - 0.5 / {BETA}))), 6) AS simpo
FROM (SELECT *, cm - p * rm AS m FROM penm)"""))
def preference_loss_averaged(spark, sf):
    """The loss types that work on mean log-probabilities."""
    rows = L.preference_loss(pairs(spark, sf, "ipo"), "ipo", BETA, out="ipo")
    rows = L.preference_loss(rows, "simpo", BETA, out="simpo")
    return rows.select("pair", r6(F.col("ipo")).alias("ipo"), r6(F.col("simpo")).alias("simpo"))


@query(sql(f"""
SELECT pair, round({BETA} * cl, 6) AS chosen_reward, round({BETA} * rl, 6) AS rejected_reward,
       round({BETA} * cl - {BETA} * rl, 6) AS reward_margin, (cl > rl)::INT::DOUBLE AS accuracy FROM pairs"""))
def rewards(spark, sf):
    rows = pairs(spark, sf)
    return rows.select(
        "pair", *[r6(F.col(c)).alias(c) for c in ("chosen_reward", "rejected_reward", "reward_margin")], "accuracy"
    )


@query(sql("SELECT phase, batch, round(sum(nll_sum) / sum(nll_n), 6) AS nll FROM loss GROUP BY ALL"))
def nll(spark, sf):
    return L.nll(pairs(spark, sf), ["phase", "batch"]).select("phase", "batch", r6(F.col("nll")).alias("nll"))


@query(sql("""
SELECT phase, batch, round(avg(loss) + sum(nll_sum) / sum(nll_n), 6) AS total_loss,
       round(avg(loss) + sum(nll_sum) / sum(nll_n) + 0.001 * avg(cx / cxn), 6) AS with_router FROM loss GROUP BY ALL"""))
def total_loss(spark, sf):
    rows = pairs(spark, sf)
    plain = L.total_loss(rows, ["phase", "batch"])
    aux = L.total_loss(rows, ["phase", "batch"], aux=F.try_divide("chosen_logit_sum", "chosen_logit_n"), aux_coef=0.001)
    return plain.join(aux.withColumnRenamed("total_loss", "with_router"), ["phase", "batch"]).select(
        "phase", "batch", r6(F.col("total_loss")).alias("total_loss"), r6(F.col("with_router")).alias("with_router")
    )


@query(sql(f"""
SELECT phase, batch, CASE WHEN phase = 'eval' THEN 'eval_' ELSE '' END||metric AS metric, round(value, 6) AS value FROM (
  SELECT phase, batch, unnest(['rewards/chosen','rewards/rejected','rewards/accuracies','rewards/margins','logps/rejected',
    'logps/chosen','logits/rejected','logits/chosen','nll_loss']) AS metric,
    unnest([avg({BETA} * cl), avg({BETA} * rl), avg((cl > rl)::INT), avg({BETA} * cl - {BETA} * rl), avg(rl), avg(cl),
    sum(rx) / sum(rxn), sum(cx) / sum(cxn), sum(nll_sum) / sum(nll_n)]) AS value FROM loss GROUP BY phase, batch)"""))
def batch_metrics(spark, sf):
    rows = L.batch_metrics(pairs(spark, sf), ["phase", "batch"])
    return rows.withColumn("value", r6(F.col("value")))


def metric_log(spark, sf):
    """Logged values: the mean of an event type per batch of ten events."""
    e = X.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    rows = e.select(
        F.when(F.col("user_id") % 2 == 0, F.lit("train")).otherwise(F.lit("eval")).alias("phase"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("log_window"),
        F.floor(F.col("event_id") / 10).cast("long").alias("batch"),
        F.col("event_type").alias("metric"),
        "value",
    )
    return rows.groupBy("phase", "log_window", "batch", "metric").agg(F.avg("value").alias("value"))


LOG_CTES = {
    "batches": """SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, event_id // 1000 AS log_window,
        event_id // 10 AS batch, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL"""
}


@query(with_ctes("", """
SELECT phase, log_window, metric, avg(value)::FLOAT AS mean, count(*) AS batches FROM batches GROUP BY ALL""", LOG_CTES))
def log_metrics(spark, sf):
    rows = L.log_metrics(metric_log(spark, sf), ["phase", "log_window", "metric"])
    return rows.withColumn("mean", F.col("mean").cast("float"))


@query(with_ctes("prompted", f"""
SELECT seq, direction, prompt, tgt_text AS policy FROM prompted
ORDER BY {X.uniform_sql("seq*2+ord")}, seq*2+ord LIMIT 16"""))
def policy_sample_table(spark, sf):
    """A random batch of prompts with what follows them in the output."""
    from ..operators.mixing import random_rows
    from .tokens import rendered

    rows = rendered(spark, sf).withColumn("key", F.col("seq") * 2 + F.col("ord"))
    sample = L.policy_sample_table(random_rows(rows, 16, X.SEED, "key"), output="full_text")
    return sample.select("seq", "direction", "prompt", "policy")
