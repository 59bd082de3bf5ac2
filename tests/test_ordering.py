"""Blocks, positions, limits and line numbers on keys of every kind, with blocks small enough to matter."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import ordering as O
from corpuswright.operators.mixing import take_first
from corpuswright.operators.packing import pack_blocks
from corpuswright.sources.files import with_file_columns, with_line_number

N = 3000


def _keys(kind):
    rng = random.Random(5)
    return {
        "dense": list(range(N)),
        "sparse": [(1 << 61) - rng.getrandbits(62) for _ in range(N)],
        "urls": [f"https://www.example.org/articles/2024/doc-{k:09}" for k in range(N)],
        "times": [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * k) for k in range(N)],
        "days": [dt.date(1990, 1, 1) + dt.timedelta(days=k) for k in range(N)],
        "bytes": [k.to_bytes(4, "big") for k in range(N)],
        "pairs": [(k // 7, f"x{k % 7}") for k in range(N)],
    }[kind]


TYPES = {"dense": "long", "sparse": "long", "urls": "string", "times": "timestamp", "days": "date", "bytes": "binary", "pairs": "struct<a: long, b: string>"}


def _table(spark, kind):
    rows = [(("hot" if k % 3 else [None, "b", "c"][k // 3 % 3]), key, k) for k, key in enumerate(_keys(kind))]
    rows[10] = (None, None, 10)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"g string, key {TYPES[kind]}, n long").repartition(7), rows


def _order(key):
    return (key is not None, key if key is not None else 0)


@pytest.mark.parametrize("kind", list(TYPES))
def test_blocks_are_even_and_ordered_for_every_type(spark, kind):
    df, _ = _table(spark, kind)
    blocks = O.with_key_block(df, "key", ("g",), block_rows=100).groupBy("__blk").agg(
        F.count("*").alias("n"), F.min(F.struct("g", "key")).alias("lo"), F.max(F.struct("g", "key")).alias("hi")).orderBy("__blk").collect()
    assert 10 <= len(blocks) <= 90 and max(r["n"] for r in blocks) < 600
    spans = [((r[e]["g"] is not None, r[e]["g"] or ""), _order(r[e]["key"])) for r in blocks for e in ("lo", "hi")]
    assert spans == sorted(spans)


@pytest.mark.parametrize("kind", ["sparse", "urls", "times", "pairs"])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_positions_and_limits_over_many_blocks(spark, monkeypatch, kind, by):
    monkeypatch.setattr(O, "BLOCK_ROWS", 100)
    monkeypatch.setattr(O.with_key_block, "__defaults__", ((), "__blk", 100))
    df, rows = _table(spark, kind)
    groups = {}
    for g, key, n in rows:
        groups.setdefault(g if by else 0, []).append((_order(key), n))
    want = {n: k for own in groups.values() for k, (_, n) in enumerate(sorted(own))}
    assert {r["n"]: r["pos"] for r in O.with_key_position(df, "key", by).collect()} == want
    for limit in (0, 1, 250, 10**8):
        assert {r["n"] for r in take_first(df, limit, "key", by).collect()} == {n for n, k in want.items() if k < limit}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_limits_and_numbers_shuffle_little(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for by in ((), ("lang",)):
        plan = _plan(take_first(docs, 20, "doc_id", by))
        assert plan.count("Exchange hashpartitioning") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan
        plan = _plan(O.with_key_position(docs, "doc_id", by))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    docs.select("text").write.option("lineSep", "\x01").text(str(tmp_path / "t"))
    raw = with_file_columns(spark.read.option("lineSep", "\x01").text(str(tmp_path / "t")))
    plan = _plan(with_line_number(raw))
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_line_numbers_of_split_files(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) if k % 9 else "" for k in range(4000)]
    for name, own in (("b.txt", lines[1500:]), ("a.txt", lines[:1500])):
        (tmp_path / name).write_text("\n".join(own) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        raw = with_file_columns(spark.read.option("lineSep", "\n").text(str(tmp_path)))
        assert raw.rdd.getNumPartitions() > 5
        got = with_line_number(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [r["value"] for r in sorted(got, key=lambda r: r["seg_id"])] == lines


def test_ids_move_once(spark, monkeypatch):
    monkeypatch.setattr(O.with_key_block, "__defaults__", ((), "__blk", 20))
    rng = random.Random(2)
    rows = [(g, k, [rng.randrange(100) for _ in range(rng.randrange(0, 40))]) for g in ("a", None) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, ids array<int>").repartition(5)
    packed = pack_blocks(df, "ids", "k", 16, ("g",))
    got = {(r["g"], r["block_no"]): r["input_ids"] for r in packed.collect()}
    for g in ("a", None):
        stream = [i for h, _, ids in rows if h == g for i in ids]
        full = len(stream) // 16
        assert {k[1]: v for k, v in got.items() if k[0] == g} == {b: stream[b * 16 : (b + 1) * 16] for b in range(full)}
