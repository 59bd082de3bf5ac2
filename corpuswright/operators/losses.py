"""Preference-loss analytics over logged token logits.

Token rows carry (sequence keys, pos, logits, label). One shuffle by pair brings the tokens of a pair
together; the label shift, the sequence sums and the chosen/rejected pairing all reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE
from ..functions.let import let, let_all

# Relaxation constants of the adaptive penalty.
RELAX_1, RELAX_2 = 0.9, 0.4
LOSS_TYPES = ("sigmoid", "hinge", "ipo", "simpo")
AVERAGED = ("ipo", "simpo")


def token_logp(logits: Column, label: Column) -> Column:
    """log softmax(logits)[label], shifted by the maximum so that exp cannot overflow."""

    def logp(s: Column) -> Column:
        z = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + F.exp(v - s["m"]))
        return F.get(s["x"], s["label"]) - (s["m"] + F.ln(z))

    doubles = logits.cast("array<double>")
    return let(doubles, lambda x: let_all({"x": x, "m": F.array_max(x), "label": label.cast("int")}, logp))


def shifted_labels(df: DataFrame, seq: list[str], pos: str = "pos", label: str = "label", out: str = "target") -> DataFrame:
    """The label a position predicts: the next one of its sequence; the last position has none."""
    after = W.partitionBy(*seq).orderBy(pos)
    return df.withColumn(out, F.lead(label).over(after))


def token_table(
    df: DataFrame, seq: list[str], pos: str = "pos", logits: str = "logits", label: str = "label", encdec: bool = False
) -> DataFrame:
    """Add target (shifted for a decoder-only model) and logp, NULL where the loss ignores the position."""
    rows = df.withColumn("target", F.col(label)) if encdec else shifted_labels(df, seq, pos, label)
    counted = F.col("target").isNotNull() & (F.col("target") != IGNORE)
    return rows.withColumn("logp", F.when(counted, token_logp(F.col(logits), F.col("target"))))


def sequence_logp(tokens: DataFrame, seq: list[str], average: bool = False) -> DataFrame:
    """Sum (or mean) of the token log-probabilities of a sequence; 0 when all are ignored.

    The mean of nothing is undefined and stays NULL.
    """
    agg = F.avg("logp") if average else F.coalesce(F.sum("logp"), F.lit(0.0))
    return tokens.groupBy(*seq).agg(agg.alias("logp"))


def non_pad_count(tokens: DataFrame, seq: list[str], label: str = "label") -> DataFrame:
    """Labels that are not ignored, unshifted."""
    return tokens.groupBy(*seq).agg(F.count_if(F.col(label) != IGNORE).alias("n_tokens"))


def pair_table(
    tokens: DataFrame, pair: list[str], side: str = "chosen", loss_type: str = "sigmoid", logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    """One row per pair: log-probabilities, label counts, logit sums and the chosen side's token sums.

    `side` is a boolean column. Both sides of a pair are conditional sums of one aggregation: no self-join.
    """
    is_chosen = F.col(side)
    logit_sum = F.aggregate(F.col(logits).cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    mean = loss_type in AVERAGED
    aggs = []
    for name, cond in (("chosen", is_chosen), ("rejected", ~is_chosen)):
        value = F.when(cond, F.col("logp"))
        logp = F.avg(value) if mean else F.coalesce(F.sum(value), F.lit(0.0))
        aggs += [
            logp.alias(f"{name}_logp"),
            F.count_if(cond & (F.col(label) != IGNORE)).alias(f"{name}_tokens"),
            F.sum(F.when(cond, logit_sum)).alias(f"{name}_logit_sum"),
            F.sum(F.when(cond, F.size(logits))).alias(f"{name}_logit_n"),
        ]
    chosen_logp = F.when(is_chosen, F.col("logp"))
    return tokens.groupBy(*pair).agg(
        *aggs, F.coalesce(-F.sum(chosen_logp), F.lit(0.0)).alias("nll_sum"), F.count(chosen_logp).alias("nll_n")
    )


def adaptive_penalty(df: DataFrame, c1: float = RELAX_1, c2: float = RELAX_2, penalty: float | None = None) -> DataFrame:
    """Add penalty and margin = chosen − penalty · rejected.

    The penalty grows with the per-token distance of the two sides, at most 1; it is negative for close
    sides. A side without counted labels has no distance, which gives 1. A given constant `penalty` (1 for the plain loss) replaces it.
    """
    if penalty is not None:
        p = F.lit(float(penalty))
    else:
        distance = F.abs(
            F.try_divide("chosen_logp", "chosen_tokens") - F.try_divide("rejected_logp", "rejected_tokens")
        )
        p = F.least(c1 * F.exp(c2 * distance) - 1, F.lit(1.0))
    return df.withColumn("penalty", p).withColumn(
        "margin", F.col("chosen_logp") - F.col("penalty") * F.col("rejected_logp")
    )


def minus_log_sigmoid(x: Column) -> Column:
    """−log σ(x) without overflow for either sign."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(
    df: DataFrame, loss_type: str = "sigmoid", beta: float = 0.1, label_smoothing: float = 0.0, gamma: float = 0.5,
    out: str = "loss",
) -> DataFrame:
    """Loss of a pair from its margin."""
    if loss_type not in LOSS_TYPES:
        raise ValueError(f"no such loss: {loss_type} (there are {', '.join(LOSS_TYPES)})")
    margin = F.col("margin")
    if loss_type == "hinge":
        loss = F.greatest(1 - beta * margin, F.lit(0.0))
    elif loss_type == "ipo":
        loss = F.pow(margin - 1 / (2 * beta), F.lit(2.0))
    else:
        if loss_type == "simpo":
            margin = margin - gamma / beta
        x = beta * margin
        loss = minus_log_sigmoid(x) * (1 - label_smoothing) + minus_log_sigmoid(-x) * label_smoothing
    return df.withColumn(out, loss)


def rewards(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Rewards of either side, their difference, and whether the chosen side wins."""
    return (
        df.withColumn("chosen_reward", beta * F.col("chosen_logp"))
        .withColumn("rejected_reward", beta * F.col("rejected_logp"))
        .withColumn("reward_margin", F.col("chosen_reward") - F.col("rejected_reward"))
        .withColumn("accuracy", (F.col("chosen_reward") > F.col("rejected_reward")).cast("double"))
    )


def nll(pairs: DataFrame, by: list[str], alpha: float = 1.0) -> DataFrame:
    """Token mean (not mean of means) of the chosen side's cross entropy; 0 without weight, NULL without counted labels."""
    value = F.lit(0.0) if alpha == 0 else F.try_divide(F.sum("nll_sum"), F.sum("nll_n"))
    return pairs.groupBy(*by).agg(value.alias("nll"))


def total_loss(pairs: DataFrame, by: list[str], alpha: float = 1.0, aux: Column | None = None, aux_coef: float = 0.0) -> DataFrame:
    """Mean pair loss + alpha · nll (+ aux_coef · mean router loss)."""
    value = F.avg("loss")
    if alpha != 0:
        value = value + alpha * F.try_divide(F.sum("nll_sum"), F.sum("nll_n"))
    if aux is not None:
        value = value + aux_coef * F.avg(aux)
    return pairs.groupBy(*by).agg(value.alias("total_loss"))


def batch_metrics(pairs: DataFrame, by: list[str], phase: str = "phase", alpha: float = 1.0) -> DataFrame:
    """(by…, metric, value): nine means per batch; evaluation metrics carry the prefix eval_."""
    logits = lambda s: F.try_divide(F.sum(f"{s}_logit_sum"), F.sum(f"{s}_logit_n"))
    metrics = {
        "rewards/chosen": F.avg("chosen_reward"),
        "rewards/rejected": F.avg("rejected_reward"),
        "rewards/accuracies": F.avg("accuracy"),
        "rewards/margins": F.avg("reward_margin"),
        "logps/rejected": F.avg("rejected_logp"),
        "logps/chosen": F.avg("chosen_logp"),
        "logits/rejected": logits("rejected"),
        "logits/chosen": logits("chosen"),
        "nll_loss": F.lit(0.0) if alpha == 0 else F.try_divide(F.sum("nll_sum"), F.sum("nll_n")),
    }
    wide = pairs.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])
    long = wide.unpivot(by, list(metrics), "metric", "value")
    return long.withColumn("metric", F.when(F.col(phase) == "eval", F.concat(F.lit("eval_"), "metric")).otherwise(F.col("metric")))


def log_metrics(metrics: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean of the batch values of each log window; partial sums combine before the shuffle."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("batches"))


def policy_sample_table(df: DataFrame, prompt: str = "prompt", output: str = "output") -> DataFrame:
    """Prompt and its continuation: the output without the first len(prompt) characters."""
    rest = F.substring(F.col(output), F.length(prompt) + 1, F.length(output))
    return df.withColumn("policy", rest)
