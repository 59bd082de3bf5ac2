"""Mixture of denoisers over right-padded rows (input_ids, labels, attention_mask).

Per row, the task is drawn, spans are drawn (in Arrow batches), and inputs and labels are rewritten with higher-order functions:
row-local, no shuffle. All draws are md5 uniforms of (seed, row key, position), so a retried task repeats them.
Rows without padding have no first pad (index −1); what follows from that is pinned in the tests.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.let import let, let_all
from ..functions.rand import pick, uniform

TASKS = ("R", "S", "X")


@dataclass(frozen=True)
class DenoiseConfig:
    """Task weights, (mean span, density) per R setting, (max mean span, density, ratio) per X setting."""

    weights: tuple[float, float, float] = (0.25, 0.5, 0.25)
    enabled: tuple[bool, bool, bool] = (True, True, True)
    r_spans: tuple[tuple[float, float], ...] = ((3, 0.15),)
    x_spans: tuple[tuple[float, float, float], ...] = ((32, 0.5, 0.5),)


def assign_task(key: Column, seed: int, config: DenoiseConfig = DenoiseConfig()) -> Column:
    """R, S or X per row; a disabled task is never drawn."""
    live = [(t, w) for t, w, on in zip(TASKS, config.weights, config.enabled) if on and w > 0]
    return pick(uniform(seed, F.lit("task"), key), [t for t, _ in live], [w for _, w in live])


def noise_counts(length: Column, mean: Column, density: Column) -> tuple[Column, Column]:
    """(noise tokens, spans). Rounding is half-even; at least one token of either kind, at least one span.

    Spans are also held to the tokens of either kind, without which no segmentation exists. A mean of 0, that of a
    row without any token, gives one span.
    """
    noise = F.least(F.greatest(F.rint(length * density), F.lit(1.0)), length - 1).cast("int")
    spans = F.coalesce(F.greatest(F.rint(F.try_divide(noise.cast("double"), mean)), F.lit(1.0)), F.lit(1.0))
    return noise, F.least(spans, noise, length - noise).cast("int")


def segmentation(items: Column, segments: Column, seed: int, *keys: Column) -> Column:
    """Random lengths ≥ 1 of `segments` pieces that add up to `items`; every cut set is equally likely.

    Cuts are the first segments − 1 inner positions in the order of their hash, `hash_hex(seed, *keys, position)`. The hashes are
    taken in Arrow batches, and only for rows that are cut at all. It is a Python function: it cannot stand in a lambda.
    """

    @F.arrow_udf("array<int>")
    def lengths(prefixes: pa.Array, items: pa.Array, segments: pa.Array) -> pa.Array:
        rows = zip(prefixes.to_pylist(), items.to_pylist(), segments.to_pylist())
        return pa.array([None if n is None or k is None else _cut(p, n, k) for p, n, k in rows], pa.list_(pa.int32()))

    return lengths(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), items, segments)


def _cut(prefix: str, items: int, segments: int) -> list[int]:
    """Lengths of the pieces of one row; positions of equal hashes go in their own order."""
    if segments < 1:
        raise ValueError(f"{items} items have no {segments} segments")
    if segments == 1:
        return [items]
    start = md5(f"{prefix}:".encode(), usedforsecurity=False)

    def place(i: int) -> bytes:
        whole = start.copy()
        whole.update(b"%d" % i)
        return whole.digest()[:4]

    ends = [*sorted(sorted(range(1, items), key=place)[: segments - 1]), items]
    return [b - a for a, b in zip([0, *ends], ends)]


def noise_mask(length: Column, mean: Column, density: Column, seed: int, *keys: Column) -> Column:
    """0/1 array: spans of kept and masked tokens alternate, kept first."""
    noise, spans = noise_counts(length, mean, density)
    masked = segmentation(noise, spans, seed, *keys, F.lit("noise"))
    kept = segmentation(length - noise, spans, seed, *keys, F.lit("kept"))
    return F.flatten(F.zip_with(kept, masked, lambda k, m: F.concat(A.repeat(0, k), A.repeat(1, m))))


def mask_union(masks: list[Column]) -> Column:
    """Position-wise OR."""
    out = masks[0]
    for m in masks[1:]:
        out = F.zip_with(out, m, lambda a, b: F.greatest(a, b))
    return out


def clear_from(mask: Column, first_pad: Column) -> Column:
    """No noise from the first pad on; without a pad only the last position is cleared (slice from −1)."""

    def cleared(s: Column) -> Column:
        stop = F.when(s["pad"] < 0, F.size(s["mask"]) - 1).otherwise(s["pad"])
        return F.concat(F.slice(s["mask"], 1, stop), A.repeat(0, F.size(s["mask"]) - stop))

    return let_all({"mask": mask, "pad": first_pad}, cleared)


def sentinels(mask: Column, vocab_len: int) -> Column:
    """vocab_len − k at the start of the k-th masked run, −1 on the rest of it, 0 elsewhere."""

    def starts_run(m: Column, i: Column) -> Column:
        return (F.get(m, i) == 1) & ((i == 0) | (F.get(m, i - 1) == 0))

    def marks(s: Column) -> Column:
        return F.transform(
            s["mask"],
            lambda m, i: F.when(m == 0, A.int_lit(0))
            .when(starts_run(s["mask"], i), (F.lit(vocab_len) - F.array_position(s["starts"], i)).cast("int"))
            .otherwise(A.int_lit(-1)),
        )

    def with_starts(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: starts_run(m, i))
        return let_all({"mask": m, "starts": starts}, marks)

    return let(mask, with_starts)


def apply_sentinels(ids: Column, marks: Column, pad: int) -> Column:
    """Ids with every masked run collapsed into its sentinel, right-padded to the old length."""
    full = F.zip_with(ids, marks, lambda i, s: F.when(s != 0, s).otherwise(i))
    return A.pad_to(F.filter(full, lambda x: x >= 0), F.size(ids), pad)


def span_denoise(df: DataFrame, mask: str, vocab_len: int, pad: int, ids: str = "input_ids") -> DataFrame:
    """Rewrite rows by their noise mask: corrupted text followed by its target, in one row of the old length.

    Adds new_ids, new_labels (ignored on the corrupted part), new_attention, new_prefix.
    """
    width = F.size(ids)
    rows = df.withColumn("__s", sentinels(F.col(mask), vocab_len)).withColumn(
        "__t", sentinels(F.transform(mask, lambda m: (1 - m).cast("int")), vocab_len)
    )
    real = lambda marks: F.filter(apply_sentinels(F.col(ids), F.col(marks), pad), lambda x: x != pad)
    rows = rows.withColumn("__in", real("__s")).withColumn("__out", real("__t"))
    n_in, n_all = F.size("__in"), F.size("__in") + F.size("__out")
    text = F.concat("__in", "__out")
    labels = F.concat(A.repeat(A.IGNORE, n_in), F.col("__out"))
    return (
        rows.withColumn("new_ids", A.truncate(A.pad_to(text, width, pad), width))
        .withColumn("new_labels", A.truncate(A.pad_to(labels, width, A.IGNORE), width))
        .withColumn("new_attention", A.leading_ones(width, n_all))
        .withColumn("new_prefix", A.leading_ones(width, n_in))
        .drop("__s", "__t", "__in", "__out")
    )


def r_mask(length: Column, first_pad: Column, seed: int, key: Column, config: DenoiseConfig = DenoiseConfig()) -> Column:
    """Short spans, drawn on the padded length."""
    masks = [
        noise_mask(length, F.lit(float(mean)), F.lit(density), seed, key, F.lit(f"r{i}"))
        for i, (mean, density) in enumerate(config.r_spans)
    ]
    return clear_from(mask_union(masks), first_pad)


def x_mask(length: Column, first_pad: Column, seed: int, key: Column, config: DenoiseConfig = DenoiseConfig()) -> Column:
    """Long spans, at most a share of the valid length.

    A row without pad counts −1 valid tokens: a negative span number, held to one span.
    """
    masks = [
        noise_mask(
            length, F.least(F.lit(float(mean)), first_pad * ratio), F.lit(density), seed, key, F.lit(f"x{i}")
        )
        for i, (mean, density, ratio) in enumerate(config.x_spans)
    ]
    return clear_from(mask_union(masks), first_pad)


def s_prefix(length: Column, first_pad: Column) -> Column:
    """Prefix mask of the sequential task: the first half of the valid tokens, at least two."""
    return A.leading_ones(length, F.greatest(F.floor(first_pad / F.lit(2)).cast("int"), F.lit(2)))


def _span_task(df: DataFrame, task: str, key: str, seed: int, vocab_len: int, pad: int, config: DenoiseConfig) -> DataFrame:
    length, first = F.size("input_ids"), F.col("__pad")
    draw = r_mask if task == "R" else x_mask
    rows = df.withColumn("__pad", A.first_index(F.col("input_ids"), pad))
    rows = rows.withColumn("__m", draw(length, first, seed, F.col(key), config))
    return _replace(span_denoise(rows, "__m", vocab_len, pad)).drop("__m", "__pad")


def _replace(df: DataFrame) -> DataFrame:
    new = {"input_ids": "new_ids", "labels": "new_labels", "attention_mask": "new_attention", "prefix_mask": "new_prefix"}
    out = df
    for name, source in new.items():
        out = out.withColumn(name, F.col(source))
    return out.drop(*new.values())


def r_denoise(
    df: DataFrame, key: str, seed: int, vocab_len: int, pad: int = 0, config: DenoiseConfig = DenoiseConfig()
) -> DataFrame:
    return _span_task(df, "R", key, seed, vocab_len, pad, config)


def x_denoise(
    df: DataFrame, key: str, seed: int, vocab_len: int, pad: int = 0, config: DenoiseConfig = DenoiseConfig()
) -> DataFrame:
    return _span_task(df, "X", key, seed, vocab_len, pad, config)


def s_denoise(df: DataFrame, pad: int = 0) -> DataFrame:
    """Ids, labels and attention as they are; only the prefix mask is set."""
    return df.withColumn(
        "prefix_mask", s_prefix(F.size("input_ids"), A.first_index(F.col("input_ids"), pad))
    )


def denoise(
    df: DataFrame,
    key: str,
    seed: int,
    vocab_len: int,
    pad: int = 0,
    training: bool = True,
    config: DenoiseConfig = DenoiseConfig(),
) -> DataFrame:
    """Draw a task per row and rewrite the row accordingly, in one pass; evaluation passes rows through."""
    if not training:
        return df
    length, first = F.size("input_ids"), F.col("__pad")
    rows = df.withColumn("task", assign_task(F.col(key), seed, config)).withColumn(
        "__pad", A.first_index(F.col("input_ids"), pad)
    )
    # sequential rows have no mask: all that is derived from it stays NULL and costs nothing; nor are masks of the other task drawn
    of = lambda task: F.when(F.col("task") == task, length)
    mask = F.when(F.col("task") == "R", r_mask(of("R"), first, seed, F.col(key), config)).when(
        F.col("task") == "X", x_mask(of("X"), first, seed, F.col(key), config)
    )
    rows = span_denoise(rows.withColumn("__m", mask), "__m", vocab_len, pad)
    sequential = F.col("task") == "S"
    keep = lambda old, new: F.when(sequential, F.col(old)).otherwise(F.col(new))
    return (
        rows.withColumn("input_ids", keep("input_ids", "new_ids"))
        .withColumn("labels", keep("labels", "new_labels"))
        .withColumn("attention_mask", keep("attention_mask", "new_attention"))
        .withColumn("prefix_mask", F.when(sequential, s_prefix(length, first)).otherwise(F.col("new_prefix")))
        .drop("new_ids", "new_labels", "new_attention", "new_prefix", "__m", "__pad")
    )
