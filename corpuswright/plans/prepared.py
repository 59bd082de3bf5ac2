"""Prepared data of the plans, written once and read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.vocab import Encoder, Vocabulary
from ..sources.sinks import fingerprint, prepare_once
from .options import Options


def kept(spark: SparkSession, kind: str, opts: Options, vocab: Encoder, make: Callable[[], DataFrame]) -> DataFrame:
    """`make()`, or what an earlier call with the same options and vocabulary has left in `opts.prepared`.

    Nothing is read or planned where a result is found. Input files that change under their paths need another tag, and so
    does an encoder other than `Vocabulary`, whose words cannot be looked at.
    """
    if opts.prepared is None:
        return make()
    words = vocab.tokens if isinstance(vocab, Vocabulary) else None
    if words is None and not opts.prepared_tag:
        raise ValueError("prepared data of an external encoder needs a prepared_tag that names it")
    asked = replace(opts, prepared=None, overwrite_prepared=False)
    folder = f"{opts.prepared}/{kind}-{fingerprint(asked, vocab.specials, len(vocab), words)}"
    return prepare_once(spark, make, folder, opts.overwrite_prepared)
