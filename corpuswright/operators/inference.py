"""Batched translation and scoring with user-given backends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table
from ..sources.lang import with_lang


class Backend(Protocol):
    """Translates prompts; `settings` holds the generation options, one forced target code per prompt.

    Options that go by row are lists, one entry per prompt: `max_source_length` (ids of a prompt that the backend
    reads, it cuts the rest) and `max_new_tokens`.
    """

    def __call__(self, prompts: list[str], settings: dict, target_codes: list[str | None]) -> list[str]: ...


class Scorer(Protocol):
    """Scores hypotheses; a reference-free scorer is given no references."""

    def __call__(self, sources: list[str], hypotheses: list[str], references: list[str] | None) -> list[float]: ...


@dataclass(frozen=True)
class GenerationSettings:
    """Defaults of the generation options."""

    max_source_length: int = 256
    max_new_tokens: int = 256
    num_beams: int = 5
    batch_size: int = 4

    def options(self) -> dict:
        return {"num_beams": self.num_beams}


def batch_translate(
    df: DataFrame,
    make_backend: Callable[[], Backend],
    settings: GenerationSettings = GenerationSettings(),
    keys: tuple[str, ...] = ("direction", "seg_id"),
    force_target: bool = False,
) -> DataFrame:
    """(keys…, output): prompts of all directions in one job.

    The backend is built once per task, not per batch. With `force_target` each prompt comes with the long
    code of its target language. Rows that have `source_limit` and `new_limit` (see `with_limits`) are translated under
    their own limits, others under those of the settings.
    """
    for name, value in (("source_limit", settings.max_source_length), ("new_limit", settings.max_new_tokens)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    rows = with_lang(df, "tgt", "nllb", "__code") if force_target else df.withColumn("__code", F.lit(None).cast("string"))
    rows = rows.select(*keys, "prompt", "__code", "source_limit", "new_limit")
    schema = rows.select(*keys).withColumn("output", F.lit("")).schema
    options, size = settings.options(), settings.batch_size
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for frame in frames:
            outputs: list[str] = []
            for i in range(0, len(frame), size):
                part = frame.iloc[i : i + size]
                own = {"max_source_length": part["source_limit"].tolist(), "max_new_tokens": part["new_limit"].tolist()}
                outputs += backend(part["prompt"].tolist(), options | own, part["__code"].tolist())
            yield frame[names].assign(output=outputs)

    return rows.mapInPandas(run, schema)


def replay(df: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("direction", "seg_id")) -> DataFrame:
    """The built-in backend: outputs of an earlier run, joined by key."""
    return df.join(stored.select(*keys, "output"), list(keys), "left")


def score_segments(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    batch_size: int = 256,
    with_reference: bool = True,
    keys: tuple[str, ...] = ("system", "direction", "seg_id"),
) -> DataFrame:
    """(keys…, score) by a user-given scorer, built once per task."""
    columns = ["source", "hypothesis", *(["reference"] if with_reference else [])]
    rows = df.select(*keys, *columns)
    schema = rows.select(*keys).withColumn("score", F.lit(0.0)).schema
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            scores: list[float] = []
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                refs = part["reference"].tolist() if with_reference else None
                scores += scorer(part["source"].tolist(), part["hypothesis"].tolist(), refs)
            yield frame[names].assign(score=scores)

    return rows.mapInPandas(run, schema)


# Fixed values: (source length, new tokens) of directions that are run again with longer limits, per news set.
RETRY_LIMITS = {
    "2022": {"zh-en": (512, 256)},
    "2023": {"ru-en": (1024, 512), "de-en": (1024, 512), "en-de": (1024, 512), "zh-en": (1024, 512)},
}


def with_limits(
    df: DataFrame, limits: dict[str, tuple[int, int]], settings: GenerationSettings = GenerationSettings()
) -> DataFrame:
    """Add source_limit and new_limit of a row's direction; other directions keep the general settings."""
    rows = [(d, source, new) for d, (source, new) in limits.items()]
    dim = local_table(df.sparkSession, rows, "direction string, __source int, __new int")
    joined = df.join(F.broadcast(dim), "direction", "left")
    return (
        joined.withColumn("source_limit", F.coalesce("__source", F.lit(settings.max_source_length)))
        .withColumn("new_limit", F.coalesce("__new", F.lit(settings.max_new_tokens)))
        .drop("__source", "__new")
    )


def latest_run(outputs: DataFrame, keys: tuple[str, ...] = ("direction", "seg_id"), run: str = "run_id") -> DataFrame:
    """Of several runs of a segment, the last: partial argmax instead of a window over all runs."""
    rest = [c for c in outputs.columns if c not in (*keys, run)]
    last = F.max_by(F.struct(*rest), run).alias("__last")
    return outputs.groupBy(*keys).agg(last, F.max(run).alias(run)).select(*keys, run, "__last.*")
