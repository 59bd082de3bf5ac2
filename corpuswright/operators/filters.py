"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..sources.lang import lang_rows
from .directions import requested_languages


def drop_empty_sides(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop exactly empty texts; a blank text with spaces stays."""
    return df.filter(F.col(text) != "")


def sides(df: DataFrame) -> DataFrame:
    """A parallel row as its two monolingual texts, in order."""
    side = lambda i, s: F.struct(
        F.lit(i).alias("side"), F.col(f"lang_{s}").alias("lang"), F.col(f"text_{s}").alias("text")
    )
    passed = [c for c in df.columns if c not in ("lang_a", "lang_b", "text_a", "text_b")]
    return df.select(*passed, F.inline(F.array(side(0, "a"), side(1, "b"))))


def join_sides_random(df: DataFrame, seed: int, key: str = "seq", out: str = "raw_text") -> DataFrame:
    """Both sides in one text, in either order with probability one half."""
    forward = F.concat_ws(" ", "text_a", "text_b")
    backward = F.concat_ws(" ", "text_b", "text_a")
    return df.withColumn(out, F.when(uniform(seed, F.col(key)) < 0.5, forward).otherwise(backward))


def iso3_codes(directions: str | list[str]) -> list[str]:
    """ISO-639-3 codes of all requested languages; an unknown language is an error."""
    iso3 = {row[0]: row[3] for row in lang_rows()}
    return [iso3[lang] for lang in requested_languages(directions)]


def filter_language(df: DataFrame, directions: str | list[str], col: str = "language_code") -> DataFrame:
    """Instruction rows in a requested language. At most 50 codes: an IN list reaches the scan."""
    return df.filter(F.col(col).isin(iso3_codes(directions)))


def filter_required_direction(df: DataFrame, col: str = "required_direction") -> DataFrame:
    """Keep rows that require no direction, or whose required target is this example's target."""
    free = F.col(col).isNull() | (F.col(col) == "")
    return df.filter(free | (F.split_part(F.col(col), F.lit("-"), F.lit(2)) == F.col("tgt")))


def filter_prompt_len(df: DataFrame, ids: str, max_len: int, mode: str = "reference") -> DataFrame:
    """Drop rows whose prompt is too long.

    'reference': tokens were cut to max_len before the test, so nothing is dropped (pinned behaviour);
    'untruncated': test the whole prompt; 'strict': keep only prompts below max_len, cut or not.
    """
    size = F.size(ids)
    if mode == "reference":
        return df.filter(F.least(size, F.lit(max_len)) <= max_len)
    if mode == "untruncated":
        return df.filter(size <= max_len)
    if mode == "strict":
        return df.filter(size < max_len)
    raise ValueError(f"unknown mode: {mode}")


MODEL_COLUMNS = ("input_ids", "attention_mask", "labels", "prefix_mask")


def select_model_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only what a model reads; all other columns are pruned from the scan."""
    return df.select(*keep, *[c for c in MODEL_COLUMNS if c in df.columns])
