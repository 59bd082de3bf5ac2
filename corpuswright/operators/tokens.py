"""Model examples: the encode → pad → mask chains, each one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.let import let
from .prompts import ChatTemplate
from .vocab import Encoder


def encode_train_left(
    df: DataFrame,
    vocab: Encoder,
    src_len: int = 256,
    new_len: int = 256,
    ignore_pad: bool = True,
    ignore_prompt: bool = False,
    chat: bool = False,
    prompt: str = "prompt",
    text: str = "full_text",
) -> DataFrame:
    """Left-padded examples of src_len + new_len ids.

    Plain text gets BOS and, decided per row, EOS; chat text brings its own. The prompt is measured without
    BOS, so a plain prompt keeps its last token in the loss (pinned behaviour).
    """
    s, total = vocab.specials, src_len + new_len
    width = total - 1 if chat else total
    ids = vocab.encode(F.col(text), total - 1, bos=not chat)
    if not chat:
        ids = A.append_eos(ids, s.eos)
    rows = df.withColumn("__ids", ids).withColumn(
        "__n", F.size(vocab.encode(F.col(prompt), src_len))
    )
    rows = rows.withColumn("input_ids", A.pad_to(F.col("__ids"), width, s.pad, "left")).withColumn(
        "attention_mask", A.pad_mask(F.col("__ids"), width, "left")
    )
    rows = rows.withColumn("labels", A.ignore_value(F.col("input_ids"), s.pad) if ignore_pad else F.col("input_ids"))
    if ignore_pad and ignore_prompt:
        start = A.first_index_not(F.col("labels"), A.IGNORE)
        rows = rows.withColumn("__at", start).withColumn(
            "labels", A.ignore_span(F.col("labels"), F.col("__at"), F.col("__n"))
        )
    return rows.drop("__ids", "__n", "__at")


def encode_train_right(
    df: DataFrame,
    vocab: Encoder,
    src_len: int = 256,
    new_len: int = 256,
    ignore_pad: bool = True,
    ignore_prompt: bool = True,
    prefix_lm: bool = True,
    prompt: str = "prompt",
    text: str = "full_text",
) -> DataFrame:
    """Right-padded examples; the EOS takes the first pad, or the last position of a full row."""
    if prefix_lm and not ignore_prompt:
        raise ValueError("a prefix language model must ignore the prompt in the loss")
    s, total = vocab.specials, src_len + new_len
    ids = vocab.encode(F.col(text), total, bos=True)
    rows = df.withColumn("__ids", ids).withColumn(
        "__n", F.size(vocab.encode(F.col(prompt), src_len))
    )
    rows = rows.withColumn("__padded", A.pad_to(F.col("__ids"), total, s.pad)).withColumn(
        "__slot", A.eos_slot(F.col("__padded"), s.pad)
    )
    rows = rows.withColumn("input_ids", A.put_at(F.col("__padded"), F.col("__slot"), s.eos)).withColumn(
        "attention_mask", A.put_at(A.pad_mask(F.col("__ids"), total), F.col("__slot"), 1)
    )
    labels = A.ignore_value(F.col("input_ids"), s.pad) if ignore_pad else F.col("input_ids")
    if ignore_pad and ignore_prompt:
        labels = A.ignore_span(labels, F.lit(0), F.col("__n"))
    rows = rows.withColumn("labels", labels)
    if prefix_lm and ignore_pad:
        rows = rows.withColumn("prefix_mask", A.leading_ones(F.lit(total), F.col("__n")))
    return rows.drop("__ids", "__n", "__padded", "__slot")


def encode_pair(
    df: DataFrame, vocab: Encoder, src_len: int = 256, new_len: int = 256, prompt: str = "prompt",
    target: str = "tgt_text",
) -> DataFrame:
    """Encoder-decoder examples: input and target apart, left-padded to their own lengths."""
    s = vocab.specials
    rows = df.withColumn("__in", vocab.encode(F.col(prompt), src_len, bos=True)).withColumn(
        "__out", vocab.encode(F.col(target), new_len, bos=True)
    )
    return (
        rows.withColumn("input_ids", A.pad_to(F.col("__in"), src_len, s.pad, "left"))
        .withColumn("attention_mask", A.pad_mask(F.col("__in"), src_len, "left"))
        .withColumn("labels", A.ignore_value(A.pad_to(F.col("__out"), new_len, s.pad, "left"), s.pad))
        .drop("__in", "__out")
    )


def encode_instruction(
    df: DataFrame, vocab: Encoder, template: ChatTemplate = ChatTemplate(), src_len: int = 256, new_len: int = 256,
    ignore_prompt: bool = True,
) -> DataFrame:
    """Instruction rows (inputs, targets) as chat examples with the same masks as `encode_train_left`."""
    rendered = df.withColumn("prompt", template.prompt(F.col("inputs"))).withColumn(
        "full_text", template.exchange(F.col("inputs"), F.col("targets"))
    )
    return encode_train_left(rendered, vocab, src_len, new_len, ignore_prompt=ignore_prompt, chat=True)


def encode_test(
    df: DataFrame, vocab: Encoder, src_len: int | str = 256, chat: bool = False, prefix_lm: bool = False,
    prompt: str = "prompt",
) -> DataFrame:
    """Prompt only, always left-padded, no labels. `src_len` may name a column of per-row limits."""
    limit: int | Column = F.col(src_len) if isinstance(src_len, str) else src_len
    rows = df.withColumn("__ids", vocab.encode(F.col(prompt), limit, bos=not chat))
    rows = rows.withColumn("input_ids", A.pad_to(F.col("__ids"), limit, vocab.specials.pad, "left")).withColumn(
        "attention_mask", A.pad_mask(F.col("__ids"), limit, "left")
    )
    if prefix_lm:
        rows = rows.withColumn("prefix_mask", F.col("attention_mask"))
    return rows.drop("__ids")


def encode_instruction_test(
    df: DataFrame, vocab: Encoder, template: ChatTemplate | None = ChatTemplate(), src_len: int = 256
) -> DataFrame:
    """Instruction inputs as test prompts, chat-wrapped when there is a template."""
    prompt = template.prompt(F.col("inputs")) if template else F.col("inputs")
    return encode_test(df.withColumn("prompt", prompt), vocab, src_len, chat=template is not None)


def token_windows(df: DataFrame, ids: str, width: int, pad: int, key: str, out_key: str = "row_id") -> DataFrame:
    """Whole texts as right-padded rows of `width` ids, keyed `key:window`; a full row has no padding."""

    def windows(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / F.lit(width)).cast("int")
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice(x, i * width + 1, width).alias("ids")))

    passed = [c for c in df.columns if c != ids]
    return (
        df.withColumn("__w", F.explode(let(F.col(ids), windows)))
        .withColumn(out_key, F.concat_ws(":", F.col(key).cast("string"), F.col("__w.i").cast("string")))
        .withColumn("attention_mask", A.pad_mask(F.col("__w.ids"), width))
        .withColumn("input_ids", A.pad_to(F.col("__w.ids"), width, pad))
        .select(*passed, out_key, "input_ids", "attention_mask")
    )
