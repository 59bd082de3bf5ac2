"""Training, validation and test sets from the readers, one lazy plan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import repeat
from ..functions.rand import uniform
from ..operators import mixing as M
from ..operators import prompts as P
from ..operators import tokens as T
from ..operators.denoise import denoise
from ..operators.directions import expand_directions, parse_directions
from ..operators.filters import MODEL_COLUMNS, join_sides_random
from ..operators.ordering import uniform_block
from ..operators.packing import mono_ids, pack_blocks, two_sided_ids
from ..operators.prompts import ChatTemplate
from ..operators.vocab import Encoder
from ..sources import readers as R
from ..sources.files import path_exists
from .options import Options
from .prepared import kept

TEMPLATE = ChatTemplate()


def _model_rows(df: DataFrame, source: str, *key: str) -> DataFrame:
    """Model columns under a key that is unique over all sources."""
    row_key = F.concat_ws(":", F.lit(source), *[F.col(k).cast("string") for k in key])
    return df.select(row_key.alias("row_key"), *[c for c in MODEL_COLUMNS if c in df.columns])


def encode_parallel(rows: DataFrame, opts: Options, vocab: Encoder) -> DataFrame:
    """Parallel rows → examples per requested direction → model columns."""
    examples = expand_directions(rows, opts.directions)
    if opts.encdec:
        return T.encode_pair(P.render_encdec(examples, opts.encdec), vocab, opts.src_len, opts.new_len)
    prompted = P.full_text(P.render_prompt(examples))
    if opts.right_pad:
        return T.encode_train_right(
            prompted, vocab, opts.src_len, opts.new_len, opts.ignore_pad, opts.ignore_prompt, opts.prefix_lm
        )
    if opts.chat:
        user, answer = F.col("prompt"), F.col("tgt_text")
        prompted = prompted.withColumn("full_text", TEMPLATE.exchange(user, answer)).withColumn("prompt", TEMPLATE.prompt(user))
    return T.encode_train_left(
        prompted, vocab, opts.src_len, opts.new_len, opts.ignore_pad, opts.ignore_prompt, opts.chat
    )


def _pack(df: DataFrame, order: str, opts: Options) -> DataFrame:
    block = opts.src_len + opts.new_len
    return pack_blocks(df, "ids", order, block, (), opts.batch_rows, prefix_mask=opts.prefix_lm)


def web_mixture(spark: SparkSession, opts: Options) -> DataFrame | None:
    """(pos, raw_text): shuffled web texts mixed by probability, with web pairs half and half if both exist.

    Mixtures are drawn on row keys; texts join once at the end.
    """
    parts: list[DataFrame] = []
    keys: list[DataFrame] = []
    if opts.web_mono:
        names, probs = M.sort_mixture(opts.web_langs, opts.web_probs or M.uniform_probs(len(opts.web_langs)))
        rows = R.read_web_mono(spark, opts.web_mono, names, opts.web_format, numbered=True)
        parts.append(rows.select(F.lit("mono").alias("mixture"), F.col("lang").alias("part"), "seq", "raw_text"))
        keys.append(_shuffled_mixture(rows, "lang", names, probs, opts.seed))
    if opts.web_parallel:
        names = parse_directions(opts.directions)
        rows = R.read_web_parallel(spark, opts.web_parallel, names, opts.web_fallback)
        rows = join_sides_random(rows.withColumn("__id", F.concat_ws(":", "direction", F.col("seq").cast("string"))), opts.seed, "__id")
        parts.append(rows.select(F.lit("web").alias("mixture"), F.col("direction").alias("part"), "seq", "raw_text"))
        probs = opts.web_parallel_probs or M.uniform_probs(len(names))
        keys.append(_shuffled_mixture(rows, "direction", names, probs, opts.seed))
    if not parts:
        return None
    if len(parts) == 2:
        placed = M.mix_nested(keys[0], keys[1], "place", opts.seed, "pos")
        return placed.join(parts[0].unionByName(parts[1]), ["mixture", "part", "seq"]).select("pos", "raw_text")
    return keys[0].join(parts[0], ["part", "seq"]).select(F.col("place").alias("pos"), "raw_text")


def _shuffled_mixture(rows: DataFrame, source: str, names: list[str], probs: list[float], seed: int) -> DataFrame:
    """(place, part, seq) of a mixture whose sources are shuffled first."""
    keyed = rows.select(source, "seq").withColumn("__u", uniform(seed, F.col(source), F.col("seq")))
    mixed = M.interleave(keyed, "seq", names, probs, seed, source, ["__u", "seq"], uniform_block(F.col("__u")), "place")
    return mixed.select("place", F.col(source).alias("part"), "seq")


def prepare_training(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """(pos, model columns): all sources processed, concatenated, denoised if asked for, and shuffled."""
    return kept(spark, "training", opts, vocab, lambda: _training_rows(spark, opts, vocab))


def _training_rows(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    parts: list[DataFrame] = []
    if opts.parallel_root:
        rows = R.read_parallel(spark, opts.parallel_root, opts.directions, ("train",), opts.parallel_suffix)
        rows = M.take_first(rows, opts.max_train, "seq", ("pair",))
        parts.append(_model_rows(encode_parallel(rows, opts, vocab), "parallel", "pair", "seq", "ord"))
    if opts.instructions:
        rows = R.read_instructions(spark, opts.instructions, opts.directions, numbered=True, per_language=False)
        rows = M.take_first(rows, opts.max_train, "seq")
        encoded = T.encode_instruction(rows, vocab, TEMPLATE, opts.src_len, opts.new_len, opts.ignore_prompt)
        parts.append(_model_rows(encoded, "instruction", "language_code", "seq"))
    if opts.mono:
        rows = M.take_first(R.read_mono_json(spark, opts.mono, numbered=True), opts.max_train, "seq")
        ids = two_sided_ids(vocab, [F.col("text_a"), F.col("text_b")], opts.max_text_tokens)
        parts.append(_model_rows(_pack(rows.select("seq", ids.alias("ids")), "seq", opts), "mono", "batch", "block_no"))
    web = web_mixture(spark, opts)
    if web is not None:
        ids = mono_ids(vocab, F.col("raw_text"), opts.max_text_tokens)
        parts.append(_model_rows(_pack(web.select("pos", ids.alias("ids")), "pos", opts), "web", "batch", "block_no"))
    if not parts:
        raise ValueError("no training source given")
    rows = M.concat_sources(parts)
    if opts.denoise:
        rows = denoise(rows, "row_key", opts.seed, len(vocab), vocab.specials.pad, config=opts.denoise).drop("task")
    return M.shuffle_position(rows, opts.seed, "row_key")


def prepare_eval(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """Validation rows with the training chain."""
    return kept(spark, "eval", opts, vocab, lambda: _eval_rows(spark, opts, vocab))


def _eval_rows(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    rows = R.read_parallel(spark, opts.parallel_root, opts.directions, ("valid",))
    rows = M.take_first(rows, opts.max_eval, "seq", ("pair",))
    encoded = _model_rows(encode_parallel(rows, opts, vocab), "valid", "pair", "seq", "ord")
    return M.shuffle_position(encoded, opts.seed, "row_key")


def segments_to_translate(spark: SparkSession, opts: Options) -> DataFrame:
    """(direction, seg_id, src, tgt, src_text, tgt_text) of the test sets of all requested directions."""
    if opts.text_test_file:
        rows = R.read_source_text(spark, opts.text_test_file, opts.directions)
        rows = rows.withColumn("pair", F.concat_ws("-", "lang_a", "lang_b"))
    else:
        rows = R.read_parallel(spark, opts.parallel_root, opts.directions, ("test",))
        rows = R.override_test(rows, opts.override_test, opts.directions)
    rows = M.take_first(rows, opts.max_test, "seq", ("pair",))
    # the file name gives the direction; the sides may be stored in either order
    src = F.split_part("pair", F.lit("-"), F.lit(1))
    forward = F.col("lang_a") == src
    return rows.select(
        F.col("pair").alias("direction"),
        F.col("seq").alias("seg_id"),
        src.alias("src"),
        F.split_part("pair", F.lit("-"), F.lit(2)).alias("tgt"),
        F.when(forward, F.col("text_a")).otherwise(F.col("text_b")).alias("src_text"),
        F.when(forward, F.col("text_b")).otherwise(F.col("text_a")).alias("tgt_text"),
    )


def prompts_to_translate(spark: SparkSession, opts: Options) -> DataFrame:
    """Test rows with their prompt: few-shot, localized, encoder-decoder, chat or plain."""
    rows = segments_to_translate(spark, opts)
    if opts.encdec:
        prompted = P.render_encdec(rows, opts.encdec)
    elif opts.shots:
        prompted = P.render_few_shot(rows, R.read_shots(spark, opts.shots, opts.directions))
    elif opts.local_prompts:
        prompted = P.render_prompt_local(rows)
    else:
        prompted = P.render_prompt(rows)
    return prompted.withColumn("prompt", TEMPLATE.prompt(F.col("prompt"))) if opts.chat else prompted


def prepare_test(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """Left-padded test prompts."""
    return T.encode_test(prompts_to_translate(spark, opts), vocab, opts.src_len, opts.chat, opts.prefix_lm)


def instruction_prompts(spark: SparkSession, opts: Options) -> DataFrame:
    """(lang, seq, inputs, prompt): instruction test rows per language, chat-wrapped if asked for."""
    rows = R.read_instructions(spark, opts.instructions, opts.directions, test=True, numbered=True)
    rows = M.take_first(rows, opts.max_test, "seq", ("lang",))
    return rows.select("lang", "seq", "inputs", (TEMPLATE.prompt(F.col("inputs")) if opts.chat else F.col("inputs")).alias("prompt"))


def prepare_stream(spark: SparkSession, opts: Options, vocab: Encoder, shards: int, last: str | None = None) -> DataFrame:
    """The training rows of the web source as an unbounded stream: prepared row by row, packed per language and shard."""
    from ..streaming.streams import MONO, stream_pack, stream_prepare, stream_source

    schema = MONO + (f", {last} boolean" if last else "")
    texts = stream_source(spark, "web", opts.web_mono, schema, opts.web_format).filter(F.col("lang").isin(opts.web_langs))
    prepared = stream_prepare(texts, vocab, max_tokens=opts.max_text_tokens)
    return stream_pack(prepared, "input_ids", "doc_id", opts.src_len + opts.new_len, ("lang",), shards=shards, last=last)


def packable(rows: DataFrame, source: str, ids: Column, *key: str) -> DataFrame:
    """(source, order, ids) of a finite or streamed source; a stream has no line numbers, so texts order themselves by hash."""
    return rows.select(F.lit(source).alias("source"), F.xxhash64(*key).alias("order"), ids.alias("ids"))


def web_pair_ids(rows: DataFrame, opts: Options, vocab: Encoder) -> DataFrame:
    """Streamed or finite web pairs, both sides in one text in random order."""
    joined = join_sides_random(rows.withColumn("__id", F.xxhash64("text_a", "text_b")), opts.seed, "__id")
    return packable(joined, "web_parallel", mono_ids(vocab, F.col("raw_text"), opts.max_text_tokens), "text_a", "text_b")


def prepare_streams(spark: SparkSession, opts: Options, vocab: Encoder, shards: int) -> DataFrame:
    """All streamable sources of `opts` as one stream of (source, block_no, model columns).

    Parallel rows are the training rows of the finite plan, one by one, with no block number. The other sources are
    packed per source and shard by one stateful operator; the tail of a shard, less than a block, waits in the state.
    Sources are neither mixed nor shuffled here (see `stream_interleave` and `stream_shuffle_buffer`), and row limits,
    which need line numbers, do not apply.
    """
    from ..streaming.streams import stream_pack, stream_source

    packed: list[DataFrame] = []
    for path in opts.mono:
        rows = stream_source(spark, "mono", path)
        packed.append(packable(rows, "mono", two_sided_ids(vocab, [F.col("text_a"), F.col("text_b")], opts.max_text_tokens), "text_a", "text_b"))
    if opts.web_mono:
        rows = stream_source(spark, "web", opts.web_mono, "lang string, text string", opts.web_format).filter(F.col("lang").isin(opts.web_langs))
        packed.append(packable(rows, "web", mono_ids(vocab, F.col("text"), opts.max_text_tokens), "lang", "text"))
    if opts.web_parallel:
        for folder in R.web_parallel_paths(opts.web_parallel, opts.directions, opts.web_fallback).values():
            if path_exists(spark, folder):
                packed.append(web_pair_ids(stream_source(spark, "parallel", folder), opts, vocab))
    parts: list[DataFrame] = []
    if packed:
        block = opts.src_len + opts.new_len
        blocks = stream_pack(reduce(DataFrame.unionByName, packed), "ids", "order", block, ("source",), shards=shards)
        full = blocks.withColumn("attention_mask", repeat(1, F.lit(block))).withColumn("labels", F.col("input_ids"))
        parts.append(full.withColumn("prefix_mask", repeat(0, F.lit(block))) if opts.prefix_lm else full)
    if opts.parallel_root:
        names = [p[len(opts.parallel_root) + 1 :] for p in R.parallel_paths(opts.parallel_root, opts.directions, ("train",), opts.parallel_suffix)]
        # a pattern of exactly the files asked for; those that are not there match nothing
        rows = stream_source(spark, "parallel", f"{opts.parallel_root}/{{{','.join(names)}}}")
        encoded = encode_parallel(rows, opts, vocab)
        parts.append(encoded.select(F.lit("parallel").alias("source"), *[c for c in MODEL_COLUMNS if c in encoded.columns]))
    if not parts:
        raise ValueError("no streamable source given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prepare_instruction_test(spark: SparkSession, opts: Options, vocab: Encoder) -> DataFrame:
    """Instruction test prompts per language."""
    rows = R.read_instructions(spark, opts.instructions, opts.directions, test=True, numbered=True)
    rows = M.take_first(rows, opts.max_test, "seq", ("lang",))
    return T.encode_instruction_test(rows, vocab, TEMPLATE if opts.chat else None, opts.src_len)
