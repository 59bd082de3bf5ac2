"""Cuts of noise masks against plain Python."""

from __future__ import annotations

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import denoise as U


def plain_cut(prefix, items, segments):
    order = sorted(range(1, items), key=lambda i: (md5(f"{prefix}:{i}".encode()).hexdigest()[:8], i))
    ends = [*sorted(order[: segments - 1]), items]
    return [b - a for a, b in zip([0, *ends], ends)]


def test_segmentation_is_the_order_of_hashes(spark):
    rows = [("k", 10, 3), ("é", 54, 3), (None, 54, 20), ("k", 1, 1), ("k", 2, 2), ("k", None, 2), ("k", 5, None), ("k", 200, 200)]
    df = spark.createDataFrame(rows, "key string, items int, segments int")
    got = df.select("*", U.segmentation(F.col("items"), F.col("segments"), 42, F.col("key"), F.lit("kept")).alias("cut")).collect()
    for r in got:
        prefix = ":".join(x for x in ("42", r["key"], "kept") if x is not None)
        want = None if None in (r["items"], r["segments"]) else plain_cut(prefix, r["items"], r["segments"])
        assert r["cut"] == want, r


def test_rows_without_a_cut_are_not_hashed(monkeypatch):
    monkeypatch.setattr(U, "md5", None)
    assert U._cut("42:k", 64, 1) == [64]
    with pytest.raises(TypeError):
        U._cut("42:k", 64, 2)
