"""Preference training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixing as M
from ..operators import preference as P
from ..operators.ordering import uniform_block, with_position
from ..functions.rand import uniform
from ..operators.prompts import ChatTemplate
from ..operators.vocab import Encoder
from ..sources import readers as R
from .options import Options
from .prepared import kept


def prepare_triples(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """(pos, prompt, chosen, rejected), shuffled; the row limit applies per language pair before rendering."""
    raw = R.read_preferences(spark, opts.preferences, opts.directions, opts.scorer, opts.systems, numbered=True)
    rows = M.take_first(raw, opts.max_train, "seq", ("lang_pair",))
    triples = P.preference_triples(
        rows, opts.directions, vocab, opts.src_len, template=ChatTemplate() if opts.chat else None, keep=("lang_pair",)
    )
    key = F.concat_ws(":", "lang_pair", F.col("seq").cast("string"), "direction")
    keyed = triples.select(key.alias("row_key"), "prompt", "chosen", "rejected")
    u = uniform(opts.seed, F.col("row_key"))
    return with_position(keyed.withColumn("__u", u), ["__u", "row_key"], uniform_block(F.col("__u"))).drop("__u")


def prepare_preferences(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """Encoded chosen and rejected answers of the triples."""
    return kept(spark, "preferences", opts, vocab, lambda: _preference_rows(spark, opts, vocab))


def _preference_rows(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    triples = prepare_triples(spark, opts, vocab)
    if opts.encdec:
        return P.encode_preference_encdec(triples, vocab, opts.max_prompt, opts.new_len)
    return P.encode_preference(triples, vocab, opts.max_length, opts.max_prompt, opts.truncation)
