"""Preference data: choosing pairs, rendering them, and encoding chosen and rejected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.let import let_all
from .directions import parse_directions
from .filters import filter_prompt_len, filter_required_direction
from .prompts import ChatTemplate, render_prompt
from .vocab import Encoder

# Order of the candidates, which decides ties.
CANDIDATES = ("ref", "sys1", "sys2")


def expand_preferences(df: DataFrame, directions: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide preference rows to one example per requested direction, forward first.

    In: lang_x, text_x, sys1_x, sys2_x, {ref,sys1,sys2}_score_x for x in a, b; delta; required_direction.
    Out: src, tgt, src_text, texts and scores of the target side in candidate order.
    """
    wanted = parse_directions(directions)

    def side(order: int, s: str, t: str) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.col(f"lang_{s}").alias("src"),
            F.col(f"lang_{t}").alias("tgt"),
            F.col(f"text_{s}").alias("src_text"),
            F.array(f"text_{t}", f"sys1_{t}", f"sys2_{t}").alias("texts"),
            F.array(*[F.col(f"{c}_score_{t}") for c in CANDIDATES]).alias("scores"),
        )

    both = F.filter(
        F.array(side(0, "a", "b"), side(1, "b", "a")), lambda x: F.concat_ws("-", x["src"], x["tgt"]).isin(wanted)
    )
    passed = [c for c in (*keep, "seq", "delta", "required_direction") if c in df.columns]
    return df.select(*passed, F.inline(both)).withColumn("direction", F.concat_ws("-", "src", "tgt"))


def require_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Fail on NULL or NaN scores, whose maximum would depend on their order."""
    bad = F.exists(scores, lambda s: s.isNull() | F.isnan(s))
    return df.withColumn(scores, F.when(bad, F.raise_error(F.lit("score is NULL or NaN"))).otherwise(F.col(scores)))


def choose_pair(df: DataFrame, texts: str = "texts", scores: str = "scores", delta: str = "delta") -> DataFrame:
    """Add chosen and rejected.

    A non-zero human `delta` decides between the two systems; otherwise the first best and the first worst
    score decide, so equal scores give the reference twice.
    """
    best = F.get(texts, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    worst = F.get(texts, (F.array_position(scores, F.array_min(scores)) - 1).cast("int"))
    first, second = F.get(texts, F.lit(1)), F.get(texts, F.lit(2))
    human = F.coalesce(F.col(delta), F.lit(0))
    return df.withColumn("chosen", F.when(human > 0, first).when(human < 0, second).otherwise(best)).withColumn(
        "rejected", F.when(human > 0, second).when(human < 0, first).otherwise(worst)
    )


def choose_pair_long(
    scored: DataFrame, keys: list[str], system: str = "system", text: str = "text", score: str = "score",
    order: tuple[str, ...] = CANDIDATES,
) -> DataFrame:
    """Chosen and rejected from the long form (one row per system): partial argmax/argmin, one shuffle."""
    rank = F.coalesce(*[F.when(F.col(system) == s, F.lit(i)) for i, s in enumerate(order)])
    rows = scored.withColumn("__rank", rank)
    return rows.groupBy(*keys).agg(
        F.max_by(text, F.struct(F.col(score), -F.col("__rank"))).alias("chosen"),
        F.min_by(text, F.struct(F.col(score), F.col("__rank"))).alias("rejected"),
    )


def select_scorer(scores: DataFrame, scorer: str) -> DataFrame:
    """One scorer of the long score table; an unknown name gives no rows."""
    return scores.filter(F.col("scorer") == scorer).drop("scorer")


def preference_triples(
    df: DataFrame,
    directions: str | list[str],
    vocab: Encoder,
    max_len: int = 256,
    mode: str = "reference",
    template: ChatTemplate | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """prompt, chosen, rejected for every requested direction of wide preference rows."""
    rows = filter_required_direction(expand_preferences(df, directions, keep))
    rows = render_prompt(rows)
    if template:
        rows = rows.withColumn("prompt", template.prompt(F.col("prompt")))
    if mode != "reference":  # the reference mode never drops a row, so nothing needs encoding
        ids = vocab.encode(F.col("prompt"), None, bos=template is None)
        rows = filter_prompt_len(rows.withColumn("__ids", ids), "__ids", max_len, mode).drop("__ids")
    return choose_pair(rows)


def instruction_triples(
    df: DataFrame, vocab: Encoder, max_len: int = 256, template: ChatTemplate | None = ChatTemplate()
) -> DataFrame:
    """Given prompt/chosen/rejected rows, chat-wrapped; prompts of max_len tokens or more are dropped."""
    rows = df.withColumn("prompt", template.prompt(F.col("prompt"))) if template else df
    ids = vocab.encode(F.col("prompt"), None, bos=template is None)
    return filter_prompt_len(rows.withColumn("__ids", ids), "__ids", max_len, "strict").drop("__ids")


def build_preferences(aligned: DataFrame, scores: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """Outputs and scores of several systems to one wide row per (direction, segment).

    Outputs and scores meet in one aggregation and not by a join, so a segment keeps its row whatever it lacks: an
    unscored output has a NULL score, a score without an output a NULL text, and a segment of which only scores are known
    has no source and no reference. Of repeated outputs or scores of a system the largest counts.
    """
    key = ["direction", "seg_id"]
    rows = aligned.select(*key, "system", "source", "reference", F.col("hypothesis").alias("text")).unionByName(
        scores.select(*key, "system", "score"), allowMissingColumns=True
    )
    of_system = [F.max(F.when(F.col("system") == s, F.col(c))).alias(f"{s}_{c}") for s in systems for c in ("text", "score")]
    return rows.groupBy(*key).agg(F.max("source").alias("source"), F.max("reference").alias("reference"), *of_system)


def split_answer(vocab: Encoder, prompt: Column, answer: Column, own: Column | None = None) -> Column:
    """struct(prompt_ids, answer_ids): the ids of prompt + answer, cut at the length of the prompt's own ids.

    When the last prompt token merged with the answer, the cut moves one token to the left. `own` are the
    prompt's ids where they are at hand.
    """
    own = vocab.encode(prompt) if own is None else own

    def cut(s: Column) -> Column:
        own = F.size(s["own"])
        short = F.size(s["full"]) < own
        n = F.when(s["own"] == F.slice(s["full"], 1, own), own).otherwise(own - 1)
        n = F.when(short, F.raise_error(F.lit("a prompt has more ids than itself with its answer"))).otherwise(n)
        return F.struct(
            F.slice(s["full"], 1, n).alias("prompt_ids"),
            F.slice(s["full"], n + 1, F.size(s["full"])).alias("answer_ids"),
        )

    return let_all({"full": vocab.encode(F.concat(prompt, answer)), "own": own}, cut)


def encode_preference(
    df: DataFrame,
    vocab: Encoder,
    max_length: int = 512,
    max_prompt: int = 256,
    mode: str = "keep_end",
) -> DataFrame:
    """prompt/chosen/rejected texts to token lists with labels; the prompt is ignored in the loss."""
    if mode not in ("keep_start", "keep_end"):
        raise ValueError(f"a prompt is cut by keep_start or keep_end, not by {mode}")
    s = vocab.specials
    rows = df.withColumn("__p", vocab.encode(F.col("prompt")))
    for name, answer in (("__c", "chosen"), ("__r", "rejected")):
        rows = rows.withColumn(name, split_answer(vocab, F.col("prompt"), F.col(answer), F.col("__p")))
    pc, pr = F.col("__c.prompt_ids"), F.col("__r.prompt_ids")
    n_c, n_r = F.size(pc), F.size(pr)
    shared = F.least(n_c, n_r)
    differing = F.size(
        F.filter(F.zip_with(F.slice(pc, 1, shared), F.slice(pr, 1, shared), lambda a, b: a != b), lambda x: x)
    )
    error = F.raise_error(F.lit("chosen and rejected prompts differ in more than their last token"))
    prompt_ids = F.when((differing > 1) | (F.abs(n_c - n_r) > 1), error).otherwise(
        F.slice(F.col("__p"), 1, shared)
    )
    rows = rows.select(
        *df.columns,
        A.prepend_bos(prompt_ids, s.bos).alias("__p"),
        A.prepend_bos(pc, s.bos).alias("__pc"),
        A.prepend_bos(pr, s.bos).alias("__pr"),
        A.append_eos(F.col("__c.answer_ids"), s.eos).alias("__ac"),
        A.append_eos(F.col("__r.answer_ids"), s.eos).alias("__ar"),
    )
    longer = F.greatest(F.size("__ac"), F.size("__ar"))

    def cut_prompt(c: str) -> Column:
        part = A.truncate(F.col(c), max_prompt) if mode == "keep_start" else A.tail(F.col(c), max_prompt)
        return F.when(F.size(c) + F.col("__longer") > max_length, part).otherwise(F.col(c))

    def cut_answer(p: str, a: str) -> Column:
        part = A.truncate(F.col(a), max_length - max_prompt)
        return F.when(F.size(p) + F.col("__longer") > max_length, part).otherwise(F.col(a))

    rows = rows.withColumn("__longer", longer)
    for c in ("__p", "__pc", "__pr"):
        rows = rows.withColumn(c, cut_prompt(c))
    rows = rows.withColumn("__ac", cut_answer("__pc", "__ac")).withColumn("__ar", cut_answer("__pr", "__ar"))
    for name, p, a in (("chosen", "__pc", "__ac"), ("rejected", "__pr", "__ar")):
        rows = (
            rows.withColumn(f"{name}_input_ids", F.concat(p, a))
            .withColumn(f"{name}_attention_mask", A.repeat(1, F.size(p) + F.size(a)))
            .withColumn(f"{name}_labels", F.concat(A.repeat(A.IGNORE, F.size(p)), F.col(a)))
        )
    return (
        rows.withColumn("prompt_input_ids", F.col("__p"))
        .withColumn("prompt_attention_mask", A.repeat(1, F.size("__p")))
        .drop("__p", "__pc", "__pr", "__ac", "__ar", "__longer")
    )


def encode_preference_encdec(
    df: DataFrame, vocab: Encoder, max_prompt: int = 256, max_target: int = 256
) -> DataFrame:
    """Three independent encodings, each cut to its own length."""
    prompt = vocab.encode(F.col("prompt"), max_prompt, bos=True)
    return (
        df.withColumn("prompt_input_ids", prompt)
        .withColumn("prompt_attention_mask", A.repeat(1, F.size("prompt_input_ids")))
        .withColumn("chosen_labels", vocab.encode(F.col("chosen"), max_target, bos=True))
        .withColumn("rejected_labels", vocab.encode(F.col("rejected"), max_target, bos=True))
    )


def stack_pairs(df: DataFrame, batch: str, pad: int = 0, encdec: bool = False) -> DataFrame:
    """Chosen (side 0) and rejected (side 1) as rows, padded to the longest of their batch.

    A batch is a device batch, a handful of rows; one shuffle by batch serves the maximum. The
    encoder-decoder form pads the labels and repeats the prompt for either side.
    """
    over = W.partitionBy(batch)
    passed = [c for c in df.columns if not c.startswith(("chosen_", "rejected_", "prompt_"))]
    if encdec:
        width = F.max(F.greatest(F.size("chosen_labels"), F.size("rejected_labels"))).over(over)
        side = lambda i, c: F.struct(
            F.lit(i).alias("side"),
            F.col("prompt_input_ids").alias("input_ids"),
            F.col("prompt_attention_mask").alias("attention_mask"),
            A.pad_to(F.col(f"{c}_labels"), F.col("__width"), A.IGNORE).alias("labels"),
        )
    else:
        width = F.max(F.greatest(F.size("chosen_input_ids"), F.size("rejected_input_ids"))).over(over)
        side = lambda i, c: F.struct(
            F.lit(i).alias("side"),
            A.pad_to(F.col(f"{c}_input_ids"), F.col("__width"), pad).alias("input_ids"),
            A.pad_to(F.col(f"{c}_attention_mask"), F.col("__width"), 0).alias("attention_mask"),
            A.pad_to(F.col(f"{c}_labels"), F.col("__width"), A.IGNORE).alias("labels"),
        )
    rows = df.withColumn("__width", width)
    return rows.select(*passed, F.inline(F.array(side(0, "chosen"), side(1, "rejected"))))
