"""Word counts, limits and texts of id arrays against plain Python, and that they take no work per element in vain."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from corpuswright.functions import arrays as A
from corpuswright.operators import tokens as T
from corpuswright.operators import vocab as V
from corpuswright.queries.fixtures import joined

TEXTS = ["a b  a", " b\tc\n\r\nd ", "", " \n", None, "é é é", "a b \x0b a\x0cb", "x" * 300 + " x", "null nul"]


def test_vocabulary_counts_every_word(spark, monkeypatch):
    words = Counter(w for t in TEXTS * 3 for w in re.split("[ \n\t\r]+", t or "") if w)
    want = [(t, n, 4 + i) for i, (t, n) in enumerate(sorted(words.items(), key=lambda e: (-e[1], e[0].encode())))]
    for most in (V.COUNTED_BYTES, 1):
        monkeypatch.setattr(V, "COUNTED_BYTES", most)
        df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(3)
        plan = V.build_vocab(df, "text", 100)
        assert sorted((tuple(r) for r in plan.collect()), key=lambda r: r[2]) == want
    assert "Generate explode" not in plan._jdf.queryExecution().executedPlan().toString()


def test_words_beyond_a_limit_are_cut_before_they_are_looked_up(spark):
    v = V.vocabulary_of(spark, ["a", "b"])
    df = spark.createDataFrame([(t, n) for t in TEXTS for n in (0, 1, 2, 9)], "text string, n int")
    ids = v.encode(F.col("text"))
    for bos in (False, True):
        whole = F.concat(F.array(A.int_lit(v.specials.bos)), ids) if bos else ids
        for r in df.select(v.encode(F.col("text"), F.col("n"), bos=bos).alias("got"), F.slice(whole, F.lit(1), F.col("n")).alias("want")).collect():
            assert r["got"] == r["want"]
    cut = df.select(v.encode(F.col("text"), 2))._jdf.queryExecution().analyzed().toString()
    assert "transform(slice(" in cut  # words, before the ids with what frames them


def test_prompt_length_of_train_rows(spark):
    v = V.vocabulary_of(spark, ["a", "b"])
    df = spark.createDataFrame([("a b a b a", "a b a b a b"), ("a", "a b"), ("", "b")], "prompt string, full_text string")
    got = T.encode_train_left(df, v, 3, 5, ignore_prompt=True).collect()
    assert [sum(x == A.IGNORE for x in r["labels"]) - r["attention_mask"].count(0) for r in got] == [3, 1, 0]


def test_put_at_of_every_position(spark):
    df = spark.createDataFrame([([7, 8, 9], i) for i in (-2, -1, 0, 1, 2, 3, 9, None)] + [([], 0), (None, 0)], "a array<int>, i int")
    for r in df.select("*", A.put_at(F.col("a"), F.col("i"), 1).alias("got")).collect():
        assert r["got"] == (None if r["a"] is None else [1 if k == r["i"] else x for k, x in enumerate(r["a"])])
    assert "CASE WHEN (namedlambda" not in df.select(A.put_at(F.col("a"), F.col("i"), 1))._jdf.queryExecution().analyzed().toString()


def test_joined_is_the_text_of_an_id_array(spark):
    df = spark.createDataFrame([([1, -100, 0],), ([5],), ([],), (None,), ([None, 3, None],), ([None],)], "a array<int>")
    assert [r[0] for r in df.select(joined("a")).collect()] == ["1,-100,0", "5", "", None, "3", ""]
    for a in (F.col("a"), F.transform("a", lambda x: x + 1)):
        for r in df.select(joined(a).alias("got"), F.array_join(a.cast("array<string>"), ",").alias("want")).collect():
            assert r["got"] == r["want"]


def test_pad_to_max_encodes_once(spark, tmp_path, monkeypatch):
    from corpuswright.queries import tokens as Q

    written = []
    monkeypatch.setattr(Q, "cut_lineage", lambda df, label: written.append(label) or df)
    spark.createDataFrame([(0, "de", "a b a"), (1, "de", "a"), (2, "en", None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in Q.pad_to_max(spark, str(tmp_path)).collect()}
    assert got[0] == "4,5,4" and got[1] == "4,0,0" and written == ["pad-to-max"]
