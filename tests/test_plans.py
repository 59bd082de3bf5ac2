"""Whole preparation plans over files written from the given tables, and partition independence."""

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import arrays as A
from corpuswright.operators import denoise as U
from corpuswright.operators import evaluate as E
from corpuswright.operators import mixing as M
from corpuswright.operators.ordering import MOST_BLOCKS, with_key_block, with_key_position
from corpuswright.operators.packing import pack_blocks
from corpuswright.operators.denoise import DenoiseConfig
from corpuswright.operators.vocab import TokenizerEncoder, Vocabulary, build_vocab, shared_vocabulary, vocabulary_of
from corpuswright.plans import evaluation as PE
from corpuswright.plans import preference as PP
from corpuswright.plans import training as PT
from corpuswright.plans.options import Options
from corpuswright.queries import fixtures as X
from corpuswright.queries import files as QF
from corpuswright.session import work_dir
from corpuswright.sources import readers as R
from corpuswright.sources import sinks as K


@pytest.fixture(scope="module")
def vocab(spark, sf):
    return X.vocabulary(spark, sf)


@pytest.fixture(scope="module")
def root(spark, sf):
    """Parallel, web, instruction and preference files."""
    path = work_dir(spark, "plans")
    rows = X.parallel(spark, sf)
    pair = QF._translation((F.col("lang_a"), F.col("text_a")), (F.col("lang_b"), F.col("text_b")))
    for split in ("train", "valid", "test"):
        QF._write_json(rows.filter("lang_a = 'de'").select("seq", pair), f"{path}/deen/{split}.de-en.json", "seq")
    QF._write_json(rows.select("seq", pair), f"{path}/mono.json", "seq")
    QF._write_json(rows.filter("lang_a = 'de'").select("seq", pair), f"{path}/pairs/deu_Latn-eng_Latn", "seq")
    X.mono(spark, sf).select("lang", F.col("raw_text").alias("text")).write.partitionBy("lang").parquet(f"{path}/web")
    X.instructions(spark, sf).withColumn("user_id", F.lit("u")).write.json(f"{path}/instr")
    return path


def test_training_plan(spark, sf, vocab, root):
    opts = Options(
        "de-en,en-de", parallel_root=root, instructions=f"{root}/instr", mono=[f"{root}/mono.json"], web_mono=f"{root}/web",
        web_langs=["de", "en"], web_probs=[0.3, 0.7], web_parallel=f"{root}/pairs", max_train=20, src_len=32, new_len=32,
        ignore_prompt=True, batch_rows=10,
    )
    rows = PT.prepare_training(spark, opts, vocab).cache()
    kinds = {r[0]: r[1] for r in rows.groupBy(F.split_part("row_key", F.lit(":"), F.lit(1))).count().collect()}
    assert set(kinds) == {"parallel", "instruction", "mono", "web"}
    assert kinds["parallel"] == 40
    sizes = {r[0] for r in rows.select(F.size("input_ids")).distinct().collect()}
    assert sizes <= {63, 64}
    positions = rows.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.count("*")).first()
    assert positions[0] == 0 and positions[1] + 1 == positions[2] == positions[3]
    assert rows.select("row_key").distinct().count() == positions[3]


def test_plans_take_any_encoder(spark, sf, root):
    """Literal vocabulary, shared vocabulary and external tokenizer give the same rows."""
    table = build_vocab(X.mono(spark, sf), "raw_text", 300)
    literal, shared = Vocabulary.from_table(table), shared_vocabulary(table)
    ids = dict(zip(literal.tokens, range(literal.specials.first_word, len(literal))))

    def tokenizer():
        return lambda texts: [[ids.get(w, 3) for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for t in texts]

    outside = TokenizerEncoder(tokenizer, len(literal))
    opts = Options("de-en,en-de", parallel_root=root, mono=[f"{root}/mono.json"], max_train=4, max_test=4, src_len=32, new_len=32)
    for prepare, key in ((PT.prepare_training, "row_key"), (PT.prepare_test, "seg_id")):
        results = []
        for encoder in (literal, shared, outside):
            rows = prepare(spark, opts, encoder)
            results.append(sorted((str(r[key]), r.input_ids, r.attention_mask) for r in rows.select(key, "input_ids", "attention_mask").collect()))
        assert results[0] and results[0] == results[1] == results[2]


def test_long_vocabularies_are_shared(spark):
    table = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    df = spark.createDataFrame([("w0 w199999 other",), (None,)], "t string")
    got = df.select(shared_vocabulary(table).encode(F.col("t"), bos=True).alias("v")).collect()
    assert [r.v for r in got] == [[1, 4, 200_003, 3], None]


def test_too_long_vocabularies_are_refused(spark):
    table = spark.range(11).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    for make, instead in ((Vocabulary.from_table, "shared_vocabulary"), (shared_vocabulary, "encode_by_join")):
        assert len(make(table, most=11)) == 15
        with pytest.raises(ValueError, match=instead):
            make(table, most=10)


def test_limits_reach_the_backend(spark, root):
    class Limits:
        def __call__(self, prompts, settings, codes):
            return [f"{p} {s}/{n}" for p, s, n in zip(prompts, settings["max_source_length"], settings["max_new_tokens"])]

    out = PE.translate(spark, Options("de-en", parallel_root=root, max_test=3), Limits, retry={"de-en": (512, 384)})
    assert [r.output for r in out.collect()] == ["512/384"] * 3


def test_denoising_is_part_of_the_training_plan(spark, vocab, root):
    opts = Options("de-en", mono=[f"{root}/mono.json"], max_train=40, src_len=32, new_len=32, denoise=DenoiseConfig())
    rows = PT.prepare_training(spark, opts, vocab)
    assert "prefix_mask" in rows.columns and rows.count() > 0


def test_eval_and_test_plans(spark, vocab, root):
    opts = Options("de-en,en-de", parallel_root=root, max_eval=5, max_test=7, src_len=32, new_len=32)
    assert PT.prepare_eval(spark, opts, vocab).count() == 10
    rows = PT.prepare_test(spark, opts, vocab)
    assert rows.groupBy("direction").count().collect() == [("de-en", 7)]
    chat = Options("de-en", instructions=f"{root}/instr", chat=True, src_len=32)
    langs = {r.lang for r in PT.prepare_instruction_test(spark, chat, vocab).select("lang").distinct().collect()}
    assert langs <= {"de", "en"} and langs


def test_translate_plan(spark, root):
    class Copy:
        def __call__(self, prompts, settings, codes):
            return [p + " done" for p in prompts]

    out = PE.translate(spark, Options("de-en", parallel_root=root, max_test=3), Copy)
    assert {(r.direction, r.output) for r in out.collect()} == {("de-en", "done")}


def test_evaluation_plan(spark, sf):
    report, board = PE.evaluate(X.aligned(spark, sf), X.scores(spark, sf), X.DIRECTIONS, list(X.SCORERS))
    rows = report.collect()
    assert {r.direction for r in rows} == set(X.DIRECTIONS)
    assert {r.bleu for r in rows if r.system == "sysC"} == {100.0}
    assert all(r.system == "sysC" for r in board.filter("metric = 'bleu' AND rank = 1").collect())


def test_preference_plan(spark, sf, vocab):
    path = work_dir(spark, "prefs")
    rows = X.preferences(spark, sf).filter("lang_a = 'de'")
    entry = [(F.lit("language_pair"), F.lit("de-en"))]
    for s, lang in (("a", "de"), ("b", "en")):
        entry += [(F.lit(lang), F.col(f"text_{s}"))]
        entry += [(F.lit(f"{n}_{lang}"), F.col(f"{n}_{s}")) for n in ("sys1", "sys2")]
        entry += [(F.lit(f"{n}_{lang}_kiwi"), F.col(f"{n}_score_{s}").cast("string")) for n in ("ref", "sys1", "sys2")]
    rows.select(QF._translation(*entry), F.lit("de-en").alias("lang_pair")).write.partitionBy("lang_pair").json(path)
    opts = Options("de-en,en-de", preferences=path, scorer="kiwi", max_train=9, max_length=64, max_prompt=32)
    out = PP.prepare_preferences(spark, opts, vocab).collect()
    assert len(out) == 18 and all(len(r.chosen_input_ids) == len(r.chosen_labels) <= 64 for r in out)


def test_missing_shots_are_an_error(spark, root):
    with pytest.raises(FileNotFoundError, match="few-shot"):
        R.read_shots(spark, root, "de-en")


def test_source_text_needs_one_direction(spark):
    with pytest.raises(ValueError):
        R.read_source_text(spark, "/nowhere", "de-en,en-de")


def test_lines_with_odd_separators(spark):
    path = work_dir(spark, "lines")
    lines = ["first", "", "a b", "　", "c\rd", "last"]
    import os

    os.makedirs(path)
    with open(f"{path}/x.txt", "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + "\n")
    got = R.read_source_text(spark, f"{path}/x.txt", "de-en").orderBy("seq").collect()
    assert [(r.seq, r.text_a) for r in got] == list(enumerate(lines))


def test_line_numbers_over_many_splits(spark):
    path = work_dir(spark, "split")
    spark.range(20_000).select(F.concat(F.lit("line "), F.col("id").cast("string"))).coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = R.read_source_text(spark, path, "de-en")
        wrong = rows.filter(F.col("text_a") != F.concat(F.lit("line "), F.col("seq").cast("string")))
        assert rows.count() == 20_000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cached_data_is_reused_unless_overwritten(spark):
    path = work_dir(spark, "cache")
    one, other = K.fingerprint(Options("de-en"), ["a"]), K.fingerprint(Options("de-en", seed=1), ["a"])
    assert one != other and one == K.fingerprint(Options("de-en"), ["a"])
    assert K.cache_prepared(spark.range(3), path, one).count() == 3
    assert K.cache_prepared(spark.range(5), path, one).count() == 3
    assert K.cache_prepared(spark.range(4), path, other).count() == 4
    assert K.cache_prepared(spark.range(5), path, one, overwrite=True).count() == 5


def test_stream_of_all_sources(spark, vocab, root):
    """Parallel rows as in the finite plan; packed sources against their texts' ids cut in plain Python."""
    from corpuswright.streaming.streams import run_to_table

    opts = Options(
        "de-en,en-de", parallel_root=root, mono=[f"{root}/mono.json"], web_mono=f"{root}/web", web_langs=["de", "en"],
        web_parallel=f"{root}/pairs", src_len=32, new_len=32,
    )
    got = spark.read.parquet(run_to_table(PT.prepare_streams(spark, opts, vocab, 1), "all")).collect()
    rows = PT.encode_parallel(R.read_parallel(spark, root, opts.directions, ("train",)), opts, vocab).collect()
    plain = lambda rs: sorted((r.input_ids, r.attention_mask, r.labels) for r in rs)
    assert rows and plain(r for r in got if r.source == "parallel") == plain(rows)
    sides = [F.col("text_a"), F.col("text_b")]
    finite = {
        "mono": PT.packable(R.read_mono_json(spark, opts.mono), "mono", PT.two_sided_ids(vocab, sides), "text_a", "text_b"),
        "web": PT.packable(R.read_web_mono(spark, opts.web_mono, opts.web_langs), "web", PT.mono_ids(vocab, F.col("raw_text")), "lang", "raw_text"),
        "web_parallel": PT.web_pair_ids(R.read_web_parallel(spark, opts.web_parallel, opts.directions), opts, vocab),
    }
    for source, texts in finite.items():
        stretch = [i for r in sorted(texts.collect(), key=lambda r: r.order) for i in r.ids]
        want = [stretch[i : i + 64] for i in range(0, len(stretch) - 63, 64)]
        blocks = sorted((r for r in got if r.source == source), key=lambda r: r.block_no)
        assert want and [r.input_ids for r in blocks] == want
        assert all(r.labels == r.input_ids and r.attention_mask == [1] * 64 for r in blocks)


def test_writers_that_meet_leave_one_result(spark):
    """Together, one writes and the others wait; without patience all write, and all read the same version."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    for wait in (60.0, 0.0):
        folder, made, begun, go = work_dir(spark, "once"), [], Event(), Event()

        def make(i, made=made, begun=begun, go=go):
            made.append(i)
            begun.set()
            assert go.wait(60)
            return spark.range(1000).select("id", F.lit(i).alias("writer"))

        def ask(i, make=make, folder=folder, wait=wait):
            return K.prepare_once(spark, lambda: make(i), folder, False, wait, 0.05)

        with ThreadPoolExecutor(3) as pool:
            first = pool.submit(ask, 0)
            assert begun.wait(60)
            others = [pool.submit(ask, i) for i in (1, 2)]
            while not wait and len(made) < 3:
                Event().wait(0.05)
            go.set()
            assert [f.result().count() for f in (first, *others)] == [1000] * 3
        assert sorted(made) == ([0] if wait else [0, 1, 2])
        results = {K.prepare_once(spark, lambda: make(9), folder).agg(F.count("*"), F.min("writer"), F.max("writer")).first()[:] for _ in range(3)}
        (rows, low, high), = results
        assert rows == 1000 and low == high != 9


def test_failed_and_stale_writers_are_replaced(spark):
    folder = work_dir(spark, "once")

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))

    with pytest.raises(Exception, match="broken"):
        K.prepare_once(spark, broken, folder)
    assert K.finished_versions(spark, folder) == []
    assert K.create_file(spark, f"{folder}/_claim-0")  # of a writer that died
    assert K.prepare_once(spark, lambda: spark.range(4), folder, wait_seconds=0.2, poll_seconds=0.05).count() == 4
    old = K.prepare_once(spark, broken, folder)
    assert K.prepare_once(spark, lambda: spark.range(6), folder, overwrite=True).count() == 6
    assert old.count() == 4 and K.prepare_once(spark, broken, folder).count() == 6


def test_plans_keep_prepared_data(spark, vocab, root):
    import os
    from dataclasses import replace

    where = work_dir(spark, "kept")
    opts = Options("de-en,en-de", parallel_root=root, max_train=5, max_eval=5, src_len=32, new_len=32, prepared=where)
    for prepare in (PT.prepare_training, PT.prepare_eval):
        plain = prepare(spark, replace(opts, prepared=None), vocab)
        first = prepare(spark, opts, vocab)
        assert first.columns == plain.columns
        assert sorted(map(str, first.collect())) == sorted(map(str, plain.collect()))
        folders = set(os.listdir(where))
        again = prepare(spark, opts, vocab)
        assert again.inputFiles() == first.inputFiles() and set(os.listdir(where)) == folders
    assert prepare(spark, replace(opts, seed=7), vocab).inputFiles() != first.inputFiles()
    with pytest.raises(ValueError, match="prepared_tag"):
        PT.prepare_eval(spark, opts, TokenizerEncoder(lambda: None, 9))


def test_stored_references_do_not_move(spark, sf):
    rows, path = X.aligned(spark, sf), work_dir(spark, "refs")
    refs = rows.filter("system = 'sysA'").select("direction", "seg_id", "reference")
    stored = E.store_reference_stats(refs, path.rsplit("/", 1)[1].replace("-", "_"), path, 8)
    outputs = spark.createDataFrame([("s", "de-en", 1, "x"), ("s", "de-xx", -5, None)], "system string, direction string, seg_id long, hypothesis string")
    known = refs.first()
    outputs = outputs.union(spark.createDataFrame([("s", known.direction, known.seg_id, None)], outputs.schema))
    hinted = E.ngram_stats_stored(outputs, stored.hint("merge"))
    plan = hinted._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or plan.count("Exchange hashpartitioning") == 1
    got = {(r.direction, r.seg_id): r for r in hinted.collect()}
    assert ("de-xx", -5) not in got and got[(known.direction, known.seg_id)].hyp_len == 0
    assert got[(known.direction, known.seg_id)].ref_len > 0


# --- properties -------------------------------------------------------------------------------------------


def naive_interleave(sizes, probs, seed):
    """Brute force of the all-exhausted mixture."""
    import hashlib

    names, total = list(sizes), sum(probs)
    bounds, acc = [], 0.0
    for p in probs:
        acc += p
        bounds.append(acc / total)
    taken, done, out, i = {n: 0 for n in names}, set(), [], 0
    while len(done) < len(names):
        u = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0
        name = next((n for n, b in zip(names[:-1], bounds) if u < b), names[-1])
        out.append((i, name, taken[name] % sizes[name]))
        taken[name] += 1
        if taken[name] == sizes[name]:
            done.add(name)
        i += 1
    return out


def test_interleave_equals_simulation(spark):
    sizes, probs = {"a": 45, "b": 29, "c": 6}, [0.2, 0.3, 0.5]
    got = M.mixture_schedule(spark, sizes, list(sizes), probs, 42).orderBy("draw").collect()
    assert [tuple(r)[:3] for r in got] == naive_interleave(sizes, probs, 42)


def test_small_hot_source_is_salted(spark):
    """Two rows that make up nine tenths of the draws, under many salts."""
    rows = spark.range(202).select("id", F.when(F.col("id") < 2, "tiny").otherwise("large").alias("source"))
    want = naive_interleave({"tiny": 2, "large": 200}, [0.9, 0.1], 5)
    for repeats in (1, 7, 10_000):
        mixed = M.interleave(rows, "id", ["tiny", "large"], [0.9, 0.1], 5, repeats=repeats).orderBy("draw").collect()
        assert [(r.draw, r.source, r.id - (0 if r.source == "tiny" else 2)) for r in mixed] == want


def test_streamed_packing_carries_tails(spark):
    """Several micro-batches lose less than a block per shard, and nothing else."""
    from corpuswright.session import work_dir
    from corpuswright.streaming import streams as S

    path = work_dir(spark, "packstream")
    data = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (F.col("id") * 10 + i).cast("int")).alias("ids"))
    data.repartition(6).write.parquet(path)
    stream = S.stream_source(spark, "web", path, "id long, ids array<int>", files_per_trigger=2)
    out = spark.read.parquet(S.run_to_table(S.stream_pack(stream, "ids", "id", 32, (), shards=2), "packed")).collect()
    assert all(len(r.input_ids) == 32 for r in out)
    ids = [x for r in out for x in r.input_ids]
    assert len(ids) == len(set(ids)) and 1500 - len(ids) < 2 * 32
    assert len({(r.shard, r.block_no) for r in out}) == len(out)


def test_streams_refuse_instructions(spark):
    from corpuswright.streaming import streams as S

    with pytest.raises(ValueError):
        S.stream_source(spark, "instructions", "/nowhere")


def naive_pack(rows, batch, block):
    out = []
    for b in range(0, len(rows), batch):
        ids = [x for r in rows[b : b + batch] for x in r]
        out += [(b // batch, i // block, ids[i : i + block]) for i in range(0, len(ids) - block + 1, block)]
    return out


@pytest.mark.parametrize("step", [3, 10**12 + 7])
def test_pack_equals_simulation(spark, step):
    data = [list(range(100 * i, 100 * i + (i * 7) % 23)) for i in range(95)]
    df = spark.createDataFrame([(i * step, d) for i, d in enumerate(data)], "k long, ids array<int>").repartition(5)
    got = pack_blocks(df, "ids", "k", 16, (), 10).orderBy("batch", "block_no").collect()
    assert [(r.batch, r.block_no, r.input_ids) for r in got] == naive_pack(data, 10, 16)
    whole = pack_blocks(df, "ids", "k", 16).orderBy("block_no").collect()
    assert [(r.batch, r.block_no, r.input_ids) for r in whole] == naive_pack(data, len(data), 16)


def test_results_do_not_depend_on_partitioning(spark, sf):
    rows = X.mono(spark, sf).select("doc_id", "lang")
    for f in (
        lambda d: M.shuffle_position(d, 1, "doc_id"),
        lambda d: with_key_position(d, "doc_id", ("lang",)),
        lambda d: M.random_rows(d, 9, 1, "doc_id"),
        lambda d: M.interleave(d, "doc_id", ["de", "en"], [0.4, 0.6], 1, "lang"),
    ):
        one, many = (sorted(map(tuple, f(rows.repartition(n)).collect())) for n in (1, 8))
        assert one == many


@pytest.mark.parametrize("key", ["id", "xxhash64(id)", "CASE WHEN id < 9 THEN id * 1000000000000 ELSE id END", "CASE WHEN id > 0 THEN id END", "md5(string(id))"])
def test_blocks_are_even_and_bounded(spark, key):
    rows = spark.range(20_000).select(F.expr(key).alias("k"), F.when(F.col("id") % 3 == 0, F.lit("a")).alias("g"))
    blocks = with_key_block(rows, "k", ("g",), block_rows=200).groupBy("g", "__blk").count().collect()
    assert len(blocks) <= min(MOST_BLOCKS, 20_000 / 200 * 1.5) + 2 and max(r["count"] for r in blocks) < 800
    got = with_key_position(rows, "k", ("g",)).collect()
    for g in ("a", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own)))
        keys = [r.k for r in own]
        assert None not in keys[1:] and keys[1:] == sorted(keys[1:])


def test_take_first_is_one_way_for_all_keys(spark):
    for keys in ([None, 1, 2], [None, "b", "a"]):
        kind = "long" if 1 in keys else "string"
        df = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
        order = [None, *sorted(k for k in keys if k is not None)]
        for n in (1, 3, 2000):
            assert [r.k for r in M.take_first(df, n, "k").orderBy("k").collect()] == order[:n]


def test_hot_group_is_numbered_by_block(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    hot = with_key_position(rows, "id", ("g",)).filter("g = 'hot'").orderBy("id").collect()
    assert [r.pos for r in hot] == list(range(len(hot)))


def test_r_denoise_reassembles(spark):
    """Corrupted text and target together hold the input."""
    width, n_words = 48, 1000
    rows = spark.range(40).select(
        F.col("id").alias("k"),
        A.pad_to(F.transform(F.sequence(F.lit(1), 5 + F.col("id").cast("int")), lambda i: (i + 10).cast("int")), width, 0).alias("input_ids"),
    )
    rows = rows.withColumn("labels", F.col("input_ids")).withColumn("attention_mask", F.col("input_ids"))
    for r in U.r_denoise(rows, "k", 42, n_words).collect():
        n = sum(r.prefix_mask)
        corrupted, target = r.input_ids[:n], [x for x in r.input_ids[n:] if x]
        spans, current = {}, None
        for t in target:
            if t >= n_words - 100:
                current, spans[t] = t, []
            elif current is not None:
                spans[current].append(t)
        # sentinels of the target stand for kept text, those of the corrupted part for masked text
        kept = [x for x in corrupted if x < n_words - 100]
        masked = [x for s in spans.values() for x in s] + [x for x in target[: next((i for i, t in enumerate(target) if t >= n_words - 100), 0)]]
        assert sorted(kept + masked) == list(range(11, 16 + r.k))


def test_bleu_of_itself(spark, sf):
    rows = X.aligned(spark, sf).withColumn("hypothesis", F.col("reference"))
    assert {r.bleu for r in E.bleu(rows).collect()} == {100.0}


def naive_bleu_stats(hyp, ref):
    from collections import Counter

    out = []
    for n in range(1, 5):
        h, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (hyp, ref))
        out += [sum((h & r).values()), sum(h.values())]
    return out


def test_ngram_stats_equal_counters(spark, sf):
    rows = E.tokenize_aligned(X.aligned(spark, sf))
    tokens = {(r.system, r.seg_id): (r.hyp_tokens, r.ref_tokens) for r in rows.collect()}
    for r in E.ngram_stats(X.aligned(spark, sf)).collect():
        got = [r[f"{k}{n}"] for n in range(1, 5) for k in ("match", "total")]
        assert got == naive_bleu_stats(*tokens[(r.system, r.seg_id)])


def test_vocabulary_bounds(spark):
    v = vocabulary_of(spark, [f"w{i}" for i in range(300)])
    df = spark.createDataFrame([("w0 w299 w300 w1",)], "t string")
    assert df.select(v.encode(F.col("t")).alias("v")).first().v == [4, 303, 3, 5]
