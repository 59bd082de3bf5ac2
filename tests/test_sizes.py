"""What larger tables bring: tables that are folders of files, and groups that are cut short or empty."""

import pytest

from corpuswright.queries import REGISTRY
from tools.check import compare, duck


def same(spark, name, sf, tables):
    """The query over `sf` against its twin, with the named tables in place of the given ones."""
    con = duck("/root/testdata/sf0.001")
    for table in tables:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet/*.parquet')")
    df = REGISTRY[name].run(spark, str(sf))
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(REGISTRY[name].sql)
    cols = [d[0] for d in cur.description]
    assert compare(rows, df.columns, cur.fetchall(), cols) is None
    return len(rows)


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """`documents` as a folder of several files, and `embeddings` whose last pairs lack a side or counted labels."""
    path = tmp_path_factory.mktemp("folders")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "doc_id").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 442 AND NOT vec_id BETWEEN 300 AND 399").write.parquet(f"{path}/embeddings.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id BETWEEN 300 AND 399 AND vec_id % 10 < 3").write.mode("append").parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_source", "stream_prepare", "stream_shuffle", "stream_mix"])
def test_streams_read_a_table_that_is_a_folder(spark, folders, name):
    assert same(spark, name, folders, ["documents"])


@pytest.mark.parametrize("name", ["adaptive_penalty", "preference_loss", "total_loss", "nll", "batch_metrics", "rewards"])
def test_losses_of_pairs_without_counted_labels(spark, folders, name):
    assert same(spark, name, folders, ["embeddings"])


def test_grams_are_cut_by_the_rules_of_the_tokenizer():
    """The 13a rules as positions of bytes, against the regular expressions; rows of one piece do not see each other."""
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from corpuswright.functions import mt_tokens as M
    from corpuswright.functions.bytewords import column_bytes
    from corpuswright.functions.ngrams import Grams

    draw = random.Random(5)
    texts = ["".join(draw.choices("5.,-a' é\u3000\x85/$\n7", k=draw.randrange(0, 14))) for _ in range(20000)]
    cut = np.array([draw.random() < 0.8 for _ in texts])
    got = Grams(*column_bytes(pa.array(texts)), cut).lengths
    for text, n, by_rules in zip(texts, got, cut):
        text = f" {text} "
        for pattern, kind in M.RULES if by_rules else ():
            text = re.sub(pattern, M.replacement(kind, "\\"), text)
        assert n == len(text.split()), text


def test_matches_are_clipped_over_any_pieces(spark, monkeypatch):
    """Rows with and without outputs, copies, Unicode blanks and empty texts, against counters; one row a piece and all in one."""
    from collections import Counter

    from pyspark.sql import functions as F

    from corpuswright.functions import ngrams as N

    rows = [(0, "a a b a a b c", ["a a b", "a a a a a a", ""]), (1, "", ["x"]), (2, "x　y z w " * 50, ["x y z w " * 20]), (3, "q", [])]
    for bound in (1, 1 << 20):
        monkeypatch.setattr(N, "PIECE_BYTES", bound)
        df = spark.createDataFrame(rows, "k int, r string, o array<string>").coalesce(1)
        both = df.select("k", N.statistics(F.col("r"), F.col("o"), F.lit(True)).alias("s"))
        got = {r.k: [tuple(s) for s in r.s] for r in both.collect()}
        kept = df.select("k", "r", "o", N.reference_grams(F.col("r"), F.lit(True)).alias("ref")).withColumn("t", F.explode("o"))
        alone = sorted((r.k, tuple(r.s)) for r in kept.select("k", N.statistics_stored(F.col("t"), F.col("ref"), F.lit(True)).alias("s")).collect())
        want = {}
        for k, ref, outputs in rows:
            want[k] = []
            grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
            for o in outputs:
                h, r = o.split(), ref.split()
                per = [(sum((grams(h, n) & grams(r, n)).values()), max(len(h) - n + 1, 0)) for n in range(1, 5)]
                want[k].append((len(h), len(r), *[x for p in per for x in p]))
        assert got == want
        assert alone == sorted((k, s) for k, ss in want.items() for s in ss)


def test_buckets_of_references_follow_their_bytes(spark, monkeypatch):
    from corpuswright.operators import evaluate as E
    from corpuswright.session import work_dir

    monkeypatch.setattr(E, "BUCKET_BYTES", 100)
    rows = spark.range(200).selectExpr("'de-en' AS direction", "id AS seg_id", "'0123456789' AS reference")
    path = work_dir(spark, "refs")
    E.store_reference_stats(rows, path.rsplit("/", 1)[1].replace("-", "_"), path)
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {path.rsplit('/', 1)[1].replace('-', '_')}").collect()}
    assert described["Num Buckets"] == "20"


def test_stored_references_take_less_than_their_hashes(spark, sf, tmp_path):
    """Four orders of 64-bit hashes are 32 bytes a token, which no codec shrinks."""
    from pyspark.sql import functions as F

    from corpuswright.operators import evaluate as E
    from corpuswright.queries import fixtures as X

    path = tmp_path / "refs"
    segments = X.aligned(spark, sf).filter("system = 'sysA'").select("direction", "seg_id", "reference")
    stored = E.store_reference_stats(segments, f"refs_{tmp_path.name}".replace("-", "_"), f"file://{path}", 8)
    tokens = stored.agg(F.sum("ref.ref_len")).first()[0]
    assert tokens > 10_000
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 20 * tokens


def test_systems_and_references_read_segments_written_once(spark, sf, monkeypatch):
    """The store and every system would otherwise join the pairs anew, and each join's shuffles stay on disk."""
    from corpuswright.queries import evaluation, fixtures

    calls, written, let_go = [], [], []
    whole, cut = fixtures.parallel, evaluation.cut_lineage
    monkeypatch.setattr(fixtures, "parallel", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(evaluation, "cut_lineage", lambda df, label: written.append((label, df.columns)) or cut(df, label))
    monkeypatch.setattr(evaluation, "release", lambda spark: let_go.append(1))
    df = REGISTRY["ngram_stats_stored"].run(spark, sf)
    assert len(calls) == 1 and written == [("segments", ["direction", "seg_id", "reference"])] and len(let_go) == 2
    assert not any("documents" in f for f in df.inputFiles())


def test_pairs_deal_out_one_side(spark, sf):
    """The join deals out the other by its own key; a text would move twice."""
    from corpuswright.queries import fixtures as X

    plan = X.parallel(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1


def test_files_are_made_of_tables_written_once(spark, sf, monkeypatch):
    """Every file of a query would otherwise join the pairs anew."""
    from corpuswright.queries import files, fixtures

    calls = []
    whole = fixtures.parallel
    monkeypatch.setattr(fixtures, "parallel", lambda *a: calls.append(1) or whole(*a))
    pairs = []
    monkeypatch.setattr(files, "cut_lineage", lambda df, label, cut=files.cut_lineage: pairs.append(label) or cut(df, label))
    for name, label in (("override_test", "pairs"), ("read_shots", "shot-table"), ("read_aligned_ragged", "numbered-pairs"), ("read_aligned", "numbered-pairs")):
        calls.clear()
        pairs.clear()
        REGISTRY[name].run(spark, sf)
        assert pairs == [label] and len(calls) == 1


def test_join_encoding_moves_no_places(spark):
    """A row's words meet the vocabulary once each: what is joined holds no places."""
    from corpuswright.operators import vocab as V

    docs = spark.createDataFrame([(0, "a b a\tc  a"), (1, ""), (2, None), (3, "x x")], "k int, t string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    rows = V.encode_by_join(docs, "k", "t", vocab)
    assert {r.k: r.ids for r in rows.collect()} == {0: [4, 5, 4, 3, 4], 1: [], 2: [], 3: [3, 3]}
    assert "posexplode" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_more_rows_are_more_micro_batches(spark, sf, monkeypatch, tmp_path):
    """A state function holds a micro-batch's rows of its key, so a micro-batch may not grow with the table."""
    from corpuswright.queries import streams

    monkeypatch.setattr(streams, "BATCH_BYTES", 40_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    size = sum(len(r.text.encode()) for r in docs.collect())
    path = f"file://{tmp_path}/arrived"
    streams.arrive(spark, docs, "doc_id", path)
    files = sorted(tmp_path.glob("arrived/*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) > streams.PARTS * streams.FILES and len(files) >= size // 40_000
    assert spark.read.parquet(path).count() == docs.count()
