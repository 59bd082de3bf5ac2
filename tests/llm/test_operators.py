"""The operators against plain Python versions, over hard tables."""

from __future__ import annotations

import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402

import corpuswright  # noqa: E402
from corpuswright.llm import langmodel, linededup, minhash, mixing, quality, queries, rules, samples, secrets, texts, toxicity, urlfilter  # noqa: E402
from corpuswright.llm.components import components  # noqa: E402
from corpuswright.llm.decontaminate import Phrases, mark_contamination, remove_contamination, search_texts  # noqa: E402
from corpuswright.llm.eliasfano import EliasFano, Trie  # noqa: E402
from corpuswright.llm.fmindex import FMIndex  # noqa: E402

cloudpickle.register_pickle_by_value(corpuswright)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(fx.hard_rows(), fx.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


ROWS = [(r[0], r[1]) for r in fx.hard_rows()]


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# words ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table,pattern,lower", [(texts.LOWER, fx.BLANK_WORD, True), (texts.PLAIN, fx.BLANK_WORD, False), (texts.ALNUM, fx.ALNUM_WORD, True)])
def test_words_are_cut_as_the_pattern_says(table, pattern, lower):
    values = [t for _, t in ROWS] + ["x" * 1000 + " " + "x" * 1001, "\x00 a\x0bB\x0c\x1fC", "é" * 300]
    column = pa.array(["skipped", *values]).slice(1)  # with an offset
    for limit in (1, 64, 1 << 21):
        got = []
        for piece in texts.words(column, table, limit):
            for a, b in zip(piece.bounds[:-1], piece.bounds[1:]):
                got.append([(piece.buffer[s:e].tobytes().decode(), int(h)) for s, e, h in zip(piece.starts[a:b], piece.ends[a:b], piece.hashes[a:b])])
        assert [[w for w, _ in row] for row in got] == [fx.words(v, pattern, lower) for v in values]
        by_word = defaultdict(set)
        for row in got:
            for w, h in row:
                by_word[w].add(h)
        assert all(len(h) == 1 for h in by_word.values())
        assert len({h for s in by_word.values() for h in s}) == len(by_word)


# 8: near duplicates --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_hard_rows(hard, percent):
    want = [(i, len(fx.shingles(t)), c) for (i, t), c in zip(ROWS, fx.components(ROWS, percent))]
    got = minhash.near_duplicates(hard, percent)
    # a text without words is its own component
    want = [(i, n, c if n else i) for i, n, c in want]
    assert pairs(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_borderline_chains(spark):
    rng = random.Random(3)
    rows = []
    for family in range(12):
        base = fx.sentence(100 + family, 60 + 20 * family).split()
        for k in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((family * 100 + k, " ".join(own[rng.randrange(0, 4):])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, 85)
    assert pairs(got, "doc_id", "component_id") == sorted(((i, c) for (i, _), c in zip(rows, fx.components(rows, 85))), key=repr)


def test_drop_near_duplicates(hard, empty):
    left = minhash.drop_near_duplicates(hard, 80)
    assert left.columns == hard.columns
    got = pairs(left, "doc_id", "text")
    want = [ROWS[k] for k in fx.one_of_each(ROWS, 80)]
    assert Counter(t for _, t in got) == Counter(t for _, t in want)
    assert minhash.drop_near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(40)] + [("x", f"y{k}") for k in range(50)] + [("z", "z"), ("p", "q"), ("q", "p")]
    got = dict(pairs(components(spark.createDataFrame(edges, "a string, b string")), "node", "root"))
    assert {v for k, v in got.items() if k[0].isdigit()} == {"000"}
    assert got["y7"] == "x" and got["q"] == "p" and "z" not in got and len(got) == 41 + 51 + 2
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# 1: lines ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("min_words", [1, 4, 50])
def test_line_dedup_hard_rows(hard, min_words):
    rows = [r for r in ROWS if r[0] != 10 or min_words == 50]  # two texts of one id have no set order among themselves
    df = hard.where("doc_id is null or doc_id <> 10") if min_words != 50 else hard
    want = fx.cut_lines(rows, min_words)
    got = linededup.drop_repeated_lines(df, min_words)
    assert got.drop("__cw_cut").columns == hard.columns
    nulls = [r for r in rows if r[0] is None]
    assert pairs(got.where("doc_id is not null"), "doc_id", "text") == sorted(((i, want[(i, t)]) for i, t in rows if i is not None), key=repr)
    assert got.where("doc_id is null").count() == len(nulls)


def test_line_dedup_random_runs(spark):
    rng = random.Random(5)
    lines = [fx.sentence(s, rng.randrange(1, 9)) for s in range(25)]
    rows = [(i, "\n".join(rng.choice(["", *lines]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_words in (3, 10, 25):
        want = fx.cut_lines(rows, min_words)
        got = linededup.drop_repeated_lines(df, min_words)
        assert pairs(got, "doc_id", "text") == sorted(((i, want[(i, t)]) for i, t in rows), key=repr)


def test_line_dedup_empty(empty):
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_suffix_ranks_sort_suffixes(spark):
    rng = random.Random(9)
    docs = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    table = spark.createDataFrame([((k, 0), d) for k, d in enumerate(docs)], "doc struct<id:long,digest:long>, lines array<long>")
    got = linededup.suffix_ranks(table, 8).collect()
    all_ = [(k, i) for k, d in enumerate(docs) for i in range(len(d))]
    for depth in (1, 2, 4, 8):
        prefix = {(k, i): tuple(docs[k][i : i + depth]) for k, i in all_ if i + depth <= len(docs[k])}
        often = Counter(prefix.values())
        ranks = {(r["doc"]["id"], r["i"]): r["rank"] for r in got if r["depth"] == depth}
        assert set(ranks) == {p for p, x in prefix.items() if often[x] > 1}
        order = sorted(ranks, key=lambda p: ranks[p])
        assert [prefix[p] for p in order] == sorted(prefix[p] for p in order)
        assert all((ranks[p] == ranks[q]) == (prefix[p] == prefix[q]) for p, q in zip(order, order[1:]))


# 2: decontamination --------------------------------------------------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    for top, n in ((2, 300), (5, 1000), (900, 4000), (1, 50)):
        text = rng.integers(1, top + 1, n)
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        index = FMIndex(text)
        for size in (1, 2, 3, 7):
            cuts = np.stack([text[k : k + size] for k in range(0, n - size, 7)] + [np.full(size, top + 3)])
            lo, hi = index.search(cuts)
            for c, a, b in zip(cuts, lo, hi):
                want = [k for k in range(n - size + 1) if (text[k : k + size] == c).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


BENCH = [("i1", fx.sentence(7, 25)), ("i2", fx.sentence(3, 8)), ("i3", None), ("i4", ""), ("i5", fx.sentence(1, 40)), ("i6", "code"), ("i6", "X"), (None, fx.sentence(1, 12)), ("i5", fx.sentence(1, 40))]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_contamination_hard_rows(spark, hard, block):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    got = mark_contamination(hard, bench, out="f", block_items=block).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, hit, names = fx.contaminated(r["text"], BENCH)
        assert r["f"]["n_words"] == n and r["f"]["items"] == names
        assert {k for s in r["f"]["spans"] for k in range(s["lo"], s["hi"])} == hit


def test_shards_of_any_size_find_the_same():
    phrases, column = Phrases([b for b in BENCH if None not in b]), pa.array([t for _, t in ROWS], pa.string())
    want = search_texts(column, phrases).column()
    assert any(f["spans"] for f in want.to_pylist())
    for size in (1, 50, 1000):
        assert search_texts(column, phrases, size).column().equals(want)


def test_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(1, fx.sentence(7, 25), "mine"), (2, None, None)], "doc_id long, text string, __cw_found string")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    for block in (1, 1000):
        assert sorted(r[:] for r in remove_contamination(docs, bench, block_items=block).collect()) == [(1, "", "mine"), (2, None, None)]
        marked = mark_contamination(docs, bench, block_items=block)
        assert marked.columns == [*docs.columns, "found"] and {r["__cw_found"] for r in marked.collect()} == {"mine", None}


@pytest.mark.parametrize("block", [1, 1000])
def test_remove_contamination(spark, hard, empty, block):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    out = remove_contamination(hard, bench, block_items=block)
    assert out.columns == hard.columns and out.count() == len(ROWS)
    before = Counter()
    for _, t in ROWS:
        n, hit, _ = fx.contaminated(t, BENCH)
        w = fx.words(t, fx.ALNUM_WORD)
        before[t if not hit else tuple(x for k, x in enumerate(w) if k not in hit)] += 1
    after = Counter()
    for r in out.collect():
        after[r["text"] if r["text"] in before else tuple(fx.words(r["text"], fx.ALNUM_WORD))] += 1
    assert after == before
    none = bench.limit(0)
    assert pairs(remove_contamination(hard, none), "doc_id", "text") == pairs(hard, "doc_id", "text")
    assert remove_contamination(empty, bench).count() == 0


# 3: language model ---------------------------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (1000, 1 << 62), (5000, 6000), (300, 1 << 48)):
        values = np.sort(rng.integers(0, top, n))
        ef = EliasFano.of(values, top)
        assert (ef.access(np.arange(n)) == values).all()
        ask = np.concatenate((values, rng.integers(0, top, 200)))
        assert (ef.successor(ask) == np.searchsorted(values, ask)).all()
        assert ((ef.find(ask) >= 0) == np.isin(ask, values)).all()


def test_trie_view_of_its_buffers():
    rng = np.random.default_rng(2)
    pair = np.unique(rng.integers(0, 500, (3000, 2)), axis=0).astype(np.int64) * 12345
    nodes = np.unique(pair[:, 0])
    trie = Trie.build(pair[:, 0], pair[:, 1], -rng.random(len(pair)), nodes, -rng.random(len(nodes)))
    again = Trie.view(trie.levels())
    ask = rng.integers(0, 520, (2000, 2)).astype(np.int64) * 12345
    known, found, log = trie.query(ask[:, 0], ask[:, 1])
    assert all((x == y).all() for x, y in zip((known, found, log), again.query(ask[:, 0], ask[:, 1])))
    have = {tuple(p) for p in pair.tolist()}
    assert found.tolist() == [tuple(a) in have for a in ask.tolist()] and known.tolist() == np.isin(ask[:, 0], nodes).tolist()


def plain_bigram(texts_, learn, top, shard_tokens):
    """Witten-Bell bigrams without hashing, sharding or quantising."""
    uni, bi = Counter(), Counter()
    for t, use in zip(texts_, learn):
        if use:
            seq = [*fx.words(t), "<end>"]
            uni.update(seq)
            bi.update(zip(["<begin>", *seq], seq))
    n, v = sum(uni.values()), len(uni)
    context, types = Counter(), Counter()
    for (a, _), c in bi.items():
        context[a] += c
        types[a] += 1
    assert v <= top
    shards = max(1, -(-n // shard_tokens))
    hot = {w for w, c in context.items() if c * 4 * shards > n}

    def score(t):
        seq, out = [*fx.words(t), "<end>"], 0.0
        for a, b in zip(["<begin>", *seq], seq):
            p0 = (uni[b] if uni[b] else 1) / (n + 1)
            lam = (langmodel.HOT_BACKOFF if a in hot else types[a] / (types[a] + context[a])) if context[a] else 1.0
            out += math.log10((1 - lam) * bi[(a, b)] / context[a] + lam * p0 if bi[(a, b)] else lam * p0)
        return out

    return score


@pytest.mark.parametrize("shard_tokens", [500, 1 << 20])
def test_language_model_hard_rows(hard, shard_tokens):
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in ROWS]
    all_texts = [t for _, t in ROWS]
    got = langmodel.score_texts(hard, shard_tokens=shard_tokens).collect()
    score = plain_bigram(all_texts, learn, langmodel.TOP, shard_tokens)
    want = []
    for (i, t), use in zip(ROWS, learn):
        base, tokens, known = fx.base_score(all_texts, learn, t)
        want.append((i, not use, tokens, known, base, score(t)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[4], 3))
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=0.02, abs=0.05)  # 256 levels
    n = sum(r[2] for r in want if not r[1])
    assert {r["train_tokens"] for r in got} == {n}


def test_language_model_prefers_what_it_knows(spark, sf):
    got = langmodel.score_texts(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.where("score > 0 or n_known > n_tokens").count() == 0
    r = got.where("not held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_language_model_empty_and_tries(spark, hard, empty):
    assert langmodel.score_texts(empty).count() == 0
    rows = langmodel.build_tries(hard, shard_tokens=500).collect()
    assert len(rows) > 1
    assert sum(Trie.view(r.asDict()).successors.size for r in rows) > 100


# 4: mixing -----------------------------------------------------------------------------------------------------------


def test_targets_are_shared_by_weight(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 30):
        sizes = {f"s{k:02}": rng.choice([0, 1, 10, 1000, 50_000]) for k in range(n)} | {None: 100}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
        while open_:
            rate = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if rate * weight[s] >= 2 * sizes[s]}
            for s in over or open_:
                want[s] = 2.0 * sizes[s] if over else rate * weight[s]
            left -= sum(want[s] for s in over)
            open_ = open_ - over if over else set()
        assert set(got) == set(want)
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def test_mix_hard_rows(hard, empty):
    plan = mixing.mix_plan(hard)
    rows = plan.collect()
    assert len(rows) == len(ROWS)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(fx.words(t))) for i, t in ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.mix_documents(hard)
    assert out.columns == hard.columns
    want = Counter()
    for r in rows:
        want[(r["doc_id"], r["size"], r["source"])] += r["copies"]
    got = Counter((r["doc_id"], len(fx.words(r["text"])), r["source"]) for r in out.collect())
    assert got == +want
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(int(rng.lognormvariate(5, 1)))), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)
    assert pairs(mixing.mix_plan(df), "doc_id", "taken") == pairs(mixing.mix_plan(df.repartition(7)), "doc_id", "taken")


# 5, 6, 10: classifiers and rules -------------------------------------------------------------------------------------


def graded(spark, n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = [fx.sentence(s, 1) for s in range(3000)]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        toxic, good = k % 6 == 0, k % 5 != 0
        if not good:
            w = [x.upper() + "!!" for x in w] if k % 2 else [y for x in w for y in (x, "|")]
        if toxic:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["vilword", "nastything", "uglyname"])
        rows.append((k, " ".join(w), ["en", "de"][k % 2], "s"))
        labels.append((k, int(good), int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels + [(None, 1, 1), (10**9, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int"),
    )


def test_classifiers_on_rows_held_out(spark):
    docs, labels = graded(spark)
    held = {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    net = toxicity.fit(docs, labels, per_class=200)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.toxicity_score(F.col("text"), net, spark).alias("s")).collect()}
    assert np.mean([(got[k] >= 0.7) == (k % 6 == 0) for k in held]) > 0.97
    model = quality.fit(docs, labels, per_class=200)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_score(F.col("text"), model, spark).alias("s")).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 5 != 0) for k in held]) > 0.97
    # what is learnt does not depend on how the table is cut
    again = toxicity.fit(docs.repartition(5), labels, per_class=200)
    assert (net.table == again.table).all() and net.thresholds == again.thresholds
    assert (model.weights == quality.fit(docs.repartition(5), labels, per_class=200).weights).all()


def test_classifiers_hard_rows(spark, hard, empty):
    docs, labels = graded(spark, 200)
    net, model = toxicity.fit(docs, labels), quality.fit(docs, labels)
    got = hard.select("text", toxicity.toxicity_score(F.col("text"), net, spark).alias("t"), quality.quality_score(F.col("text"), model, spark).alias("q")).collect()
    assert len(got) == len(ROWS) and all(0 <= r["t"] <= 1 and 0 <= r["q"] <= 1 for r in got)
    assert len({r["t"] for r in got if not fx.words(r["text"])}) == 1 and len({r["q"] for r in got if not fx.words(r["text"])}) == 1
    left = toxicity.drop_toxic(hard, net)
    assert left.columns == hard.columns
    no_labels = labels.limit(0)
    assert toxicity.drop_toxic(hard, toxicity.fit(hard, no_labels)).count() == len(ROWS)
    assert quality.fit(hard, no_labels).shift == 0
    assert toxicity.drop_toxic(empty, toxicity.fit(empty, no_labels)).count() == 0


def plain_toxicity(net, text):
    """The network's score of a text, word by word."""
    entries = []
    for w in fx.words(text):
        raw = w.encode()
        for _ in range(3):
            if len(raw) > 1 and raw[-1] < 128 and raw[-1] > 0x20 and not chr(raw[-1]).isalnum() and raw[-1] != 0x7F:
                raw = raw[:-1]
        forms = [raw, *(raw[:n] for n in toxicity.PREFIX_BYTES)]
        hashes = texts.byte_hash(forms)
        places = [((int(h) * (0x9E3779B97F4A7C15 + 2 * k)) % 2**64 >> 20) % (toxicity.BUCKETS - 1) + 1 for k, h in enumerate(hashes)]
        entries.append(sum(net.table[k].astype(float) for k in places))
    logit = float(net.shift)
    for k, (f, bias) in enumerate(zip(net.filters, net.bias)):
        for j in range(toxicity.FILTERS):
            at = [sum(entries[i + o] @ f[o, :, j] for o in range(len(f)) if i + o < len(entries)) + bias[j] for i in range(len(entries))]
            if at:
                logit += max(0.0, max(at)) * float(net.out[k * toxicity.FILTERS + j])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit * net.scale))))


def test_toxicity_is_the_plain_forward_pass(spark, hard):
    docs, labels = graded(spark, 120)
    net = toxicity.fit(docs, labels)
    rows = hard.where("length(text) < 5000").unionByName(docs.limit(20), allowMissingColumns=True)
    for r in rows.select("text", toxicity.toxicity_score(F.col("text"), net, spark).alias("s")).collect():
        assert r["s"] == pytest.approx(plain_toxicity(net, r["text"]), abs=1e-4)


def test_the_best_cut():
    z, y, w = np.array([5.0, 4.0, 4.0, 1.0, -1.0, -1.0]), np.array([1, 1, 1, 0, 0, 0]), np.ones(6)
    assert toxicity.best_cut(z, y, w, 0.0) == 2.5 and toxicity.best_cut(z, y, w, 2.0) == 2.0
    assert toxicity.best_cut(z, np.zeros(6, int), w, 0.3) == 0.3 and toxicity.best_cut(z, np.ones(6, int), w, 9.0) < -1


def test_best_cuts_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 3000)
    # ties, crowded and empty stretches, logits beyond the last stretch
    z = np.round(rng.normal(0, 1, 3000) + 1.5 * y, 2) * np.where(rng.random(3000) < 0.01, 90, 1)
    scope = rng.choice(["a", "b", "c"], 3000, p=[0.6, 0.39, 0.01])
    rows = [(str(s), int(c), float(v)) for s, c, v in zip(scope, y, z)] + [("none", 0, 1.0), ("none", 0, 2.0), ("one", 1, 3.0)]
    df = spark.createDataFrame(rows, "scope string, y int, z double").repartition(3)
    for weights in ([1.0, 1.0], [3.5, 1.0]):
        for fallback in (0.3, 2.0, 50.0):
            got = toxicity.best_cuts(df, np.array(weights), fallback)
            assert set(got) == {"a", "b", "c", "none", "one"}
            for name, (cut, rare) in got.items():
                own = [r for r in rows if r[0] == name]
                oy, oz = np.array([r[1] for r in own]), np.array([r[2] for r in own])
                assert cut == toxicity.best_cut(oz, oy, np.array(weights)[oy], fallback) and rare == min((oy == 0).sum(), (oy == 1).sum())


def test_toxicity_learns_from_every_labelled_text(spark):
    ids = [k for k in range(8000) if zlib.crc32(str(k).encode()) % 3 != 1][:5100]
    # each marker stands in three texts; some texts have more than 20 000 words
    rows = [(k, ("vilword " if n % 10 == 0 else "plain ") + f"marker{n // 3}x", "en" if n % 2 else "de") for n, k in enumerate(ids)]
    rows += [(-k, "long " * 20_500 + "farmarker", "en") for k in range(1, 40) if zlib.crc32(str(-k).encode()) % 3 != 1][:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[1].startswith("vil"))) for r in rows], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    words = sorted({w for r in rows for w in r[1].split()})
    piece = next(texts.words(pa.array([" ".join(words)]), texts.LOWER))
    assert net.table[toxicity.word_ids(piece)[:, 0]].any(axis=1).all()
    again = toxicity.fit(docs.repartition(7), labels)
    assert (net.table == again.table).all() and (net.rest() == again.rest()).all() and net.thresholds == again.thresholds


def test_texts_that_teach_do_not_pass_through_the_driver(spark):
    import tracemalloc

    ids = [k for k in range(800) if zlib.crc32(str(k).encode()) % 3 != 1][:500]
    docs = spark.createDataFrame([(k,) for k in ids], "doc_id long").repartition(8).select("doc_id", F.concat(F.when(F.col("doc_id") % 9 == 0, "vilword ").otherwise("plain "), F.repeat(F.lit("many words "), 9900)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    tracemalloc.start()
    toxicity.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the places of these words take 80 MB


@pytest.mark.parametrize("scale,least,most,auc", [("sf0.1", 0.9, 0.02, 0.95), ("sf0.01", 0.7, 0.05, 0.9)])
def test_toxicity_of_held_out_documents(spark, scale, least, most, auc):
    sf = f"/root/testdata/{scale}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) >= least
    assert np.mean([r["predicted"] for r in clean]) <= most
    good, bad = (np.array([r["score"] for r in rows]) for rows in (clean, toxic))
    assert np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good)) >= auc


def test_one_text_of_an_id_teaches(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, y int")
    got = sorted((r["key"], r["y"]) for r in samples.labelled_sample(docs, labels, "y", 10, lambda c: F.lit(True)).collect())
    assert got == [(1, 1), (2, 0), (3, 0)]


def test_rules_hard_rows(spark, hard, empty):
    _, labels = graded(spark, 5)
    got = rules.judge_quality(hard, labels)
    want = Counter()
    for i, t in ROWS:
        w = fx.words(t, lower=False)
        lines = [x for x in (t or "").split("\n") if fx.BLANK_WORD.search(x)]
        repeats = fx.repeat_words(w)
        want[(i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, len(w) < 50 or 100 * repeats > 50 * len(w))] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == want
    assert got.where("kept and base_failed").count() == 0
    assert rules.judge_quality(empty, labels).count() == 0


def test_repeated_words_by_either_sort(spark, monkeypatch):
    """Windows and places as one long, and as two where there are too many places for it."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("abcd", k=rng.randrange(0, 60)))) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, text string")
    for bits in (rules.PLACE_BITS, 3):
        monkeypatch.setattr(rules, "PLACE_BITS", bits)
        count = rules.let(rules.cut(F.col("text")), lambda x: rules.repeated_words(x["pairs"], x["hashes"]))
        assert {r["k"]: r["n"] for r in df.select("k", count.alias("n")).collect()} == {k: fx.repeat_words(t.split()) for k, t in rows}


def plain_buckets(text):
    """The hashed n-grams of a text, by the public XXH64."""

    def chained(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
        return seed

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    raw = lambda h: h.to_bytes(8, "little")
    words_ = fx.words(text, lower=False)
    shapes = [re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z\x80-\U0010FFFF]+", "a", w))) for w in words_]
    h, s = ([chained(w.encode()) for w in own] for own in (words_, shapes))
    out = h + [chained(raw(a), raw(b)) for own in (h, s) for a, b in zip(own, own[1:])]
    return [signed(x) % rules.BUCKETS for x in out]


def test_ngrams_are_counted_without_a_lambda(spark, hard):
    """A lambda is interpreted, word by word; what is counted over the whole corpus is compiled."""
    grams = rules.buckets(hard.repartition(2))
    assert "lambda" not in grams._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(r["b"] for r in grams.collect()) == Counter(b for _, t in ROWS for b in plain_buckets(t))


def test_repeated_words_whose_short_hashes_agree(spark, monkeypatch):
    """Four bits of the hash do not tell the windows apart: neighbours that agree in them must not count as the same."""
    monkeypatch.setattr(rules, "PLACE_BITS", 60)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("abcdef", k=rng.randrange(0, 60)))) for k in range(200)] + [(200, ""), (201, None)]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("x", rules.cut(F.col("text")))
    df = df.withColumn("w", rules.windows_of(F.col("x.pairs"), F.col("x.hashes"))).withColumn("again", rules.repetitions(F.col("w")))
    got = {r["k"]: r["n"] for r in df.select("k", rules.covered_words(F.col("w"), F.col("again")).alias("n")).collect()}
    assert got == {k: fx.repeat_words((t or "").split()) for k, t in rows}


def test_ratio_scores_are_the_plain_ones(spark):
    docs, labels = graded(spark, 90)
    hard_docs = spark.createDataFrame([(10**6 + k, t, None, None) for k, (_, t) in enumerate(ROWS)], docs.schema)
    docs = docs.unionByName(hard_docs)
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect()}
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect() if r["doc_id"] in texts_ and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    raw = Counter(b for t in texts_.values() for b in plain_buckets(t))
    good = Counter(b for k in trusted for b in plain_buckets(texts_[k]))
    total, own = sum(raw.values()) + rules.BUCKETS, sum(good.values()) + rules.BUCKETS
    ratio = [round(math.log((good[b] + 1) / own) - math.log((raw[b] + 1) / total), 6) for b in range(rules.BUCKETS)]
    for r in rules.judge_quality(docs, labels).collect():
        grams = plain_buckets(texts_[r["doc_id"]])
        want = sum(ratio[b] for b in grams) / len(grams) if grams else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-5)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= rules.THRESHOLD)


def test_ratio_keeps_clean_texts_and_drops_junk(spark):
    docs, labels = graded(spark)
    got = {r["doc_id"]: r for r in rules.judge_quality(docs, labels).collect()}
    assert np.mean([r["kept"] == (k % 5 != 0) for k, r in got.items()]) > 0.97


# 7: URLs -------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?q#f", "http://example.org/en/1", "http://example.org/en/2", "http://badexample.org/es/",
    "https://x.com/fr/", "https://x.com/FR/", "https://x.com?/fr/", "https://com/de/a/b", "ftp://user@h.net:80/p#?", "http://a.org://b/c", "http://x.com/de/\nrest", "http://x.com/fr/", "http://x.com/fr/",
]


def judged(url, rule_list):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:end].translate(fx.LOWER)
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rule_list if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules(spark):
    rule_list = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "block"), ("x.com", "", "allow"), ("net", "/", "block")]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[4], None)], "page_id long, url string, host string")
    got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rule_list)).collect()
    want = [(k, *judged(u, rule_list)) for k, u in enumerate(URLS)] + [(None, *judged(URLS[4], rule_list))]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    none = urlfilter.rule_table(spark, rule_list).limit(0)
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, none).collect()} == {"allow"}
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.rule_table(spark, rule_list)).count() == 0


# 9: secrets ----------------------------------------------------------------------------------------------------------


def with_secrets(spark, n=600):
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, truth = [], {}
    for k in range(n):
        kind = k % 6
        before, after = fx.sentence(k, 20), fx.sentence(k + 10**6, 20)
        value = [
            "AKIA" + "".join(rng.choice(chars) for _ in range(16)), "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
            'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', "http://host/path/" + str(rng.randrange(10**12, 10**13)),
            "release-2024-" + str(rng.randrange(10**6)), "order" + str(rng.randrange(10**9)) + "number",
        ][kind]
        rows.append((k, f"{before} {value} {after}"))
        truth[k] = kind < 3
    return spark.createDataFrame(rows, "doc_id long, text string"), truth


def test_secrets_on_rows_held_out(spark):
    docs, truth = with_secrets(spark)
    got = secrets.scan_secrets(docs).collect()
    found = defaultdict(bool)
    for r in got:
        found[r["doc_id"]] |= r["secret"]
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([found[k] == truth[k] for k in held]) > 0.97


def test_secrets_hard_rows(spark, hard, empty):
    assert secrets.scan_secrets(hard).columns == ["doc_id", "word_no", "value", "score", "secret"]
    assert secrets.scan_secrets(hard).where("secret").count() == 0
    assert secrets.scan_secrets(empty).count() == 0
    docs, _ = with_secrets(spark, 12)
    odd = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "AKIA" + "B7" * 8), (5, None), (6, "")], "doc_id long, text string"))
    assert secrets.candidates(odd).count() == 25
