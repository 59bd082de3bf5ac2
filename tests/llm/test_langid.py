"""Language identification: gradients, a plain forward pass, hard rows, held-out accuracy."""

import zlib

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import langid as L
from corpuswright.llm.queries import op12_language_id


def softsign(x):
    return x / (1 + abs(x))


def plain_labels(net, text: bytes):
    """Distribution at every byte of a text of one stretch, one cell at a time."""
    padded = bytes(L.CONTEXT) + text + bytes(L.STRETCH + L.CONTEXT - len(text))
    states = []
    for way, order in ((0, range(len(padded))), (1, range(len(padded) - 1, -1, -1))):
        h, own = np.zeros(L.HIDDEN), {}
        for k in order:
            x, g = net.byte_gates[way][:, padded[k]].astype(float), net.state_gates[way].astype(float) @ h
            r, u = ((softsign(x[i * L.HIDDEN : (i + 1) * L.HIDDEN] + g[i * L.HIDDEN : (i + 1) * L.HIDDEN]) + 1) / 2 for i in (0, 1))
            c = softsign(x[2 * L.HIDDEN :] + r * (g[2 * L.HIDDEN :] + net.state_shift[way][:, 0]))
            h = (1 - u) * c + u * h
            own[k] = h
        states.append(own)
    out = []
    for k in range(L.CONTEXT, L.CONTEXT + len(text)):
        z = net.out[0] @ states[0][k] + net.out[1] @ states[1][k] + net.out_shift[:, 0]
        p = np.exp(z - z.max())
        out.append(p / p.sum())
    return np.array(out)


def test_pooling_is_the_mean_over_labelled_letters():
    net = L.Network.fresh(["a", "b", "c"])
    texts = [b"", b"12 .", "Größe, 3 Äpfel".encode(), b"one two three", b"z"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, row in zip(texts, got):
        letters = [k for k, b in enumerate(text) if chr(b).isalpha() and b < 128 or b >= 128]
        want = plain_labels(net, text)[letters].mean(axis=0) if letters else np.zeros(3)
        assert np.allclose(row, want, atol=1e-4)


def test_long_texts_are_labelled_to_their_end():
    net = L.Network.fresh(["a", "b"])
    start, end = b"abc " * 5000, b"xyz " * 5000
    raw = np.frombuffer(start + end, np.uint8)
    both = net.pooled(raw, np.array([0, len(raw)]))[0]
    halves = net.pooled(raw, np.array([0, len(start), len(raw)]))
    assert np.allclose(both, halves.mean(axis=0), atol=1e-3) and not np.allclose(halves[0], halves[1], atol=1e-3)


def test_gradients_are_those_of_the_loss():
    net = L.Network.fresh(["a", "b", "c"])
    net = L.Network(net.langs, *(p.astype(np.float64) for p in net.parameters()))
    rng = np.random.default_rng(1)
    lanes, y = rng.integers(60, 130, (12, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    counted = L._LETTER[lanes]
    grads = net.gradients(lanes, y, counted)[1]
    for p, g in zip(net.parameters(), grads):
        for _ in range(8):
            at = tuple(int(rng.integers(0, n)) for n in p.shape)
            if p.shape[-1] == 256:
                at = (*at[:2], int(lanes[rng.integers(0, 12), 0]))
            kept = p[at]
            p[at] = kept + 1e-3
            up = net.gradients(lanes, y, counted)[0]
            p[at] = kept - 1e-3
            down = net.gradients(lanes, y, counted)[0]
            p[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 2e-5


def test_windows_come_from_the_whole_text():
    text = np.frombuffer(b"".join(b"%05d " % k for k in range(5000)), np.uint8)
    cut = L.cut_windows(text, 12345, 400, 48)
    seen = sorted(int(w.tobytes()[6:11].decode()) for w in cut[::2] if w.tobytes()[6:11].isdigit())
    assert seen[0] < 500 and seen[-1] > 4500
    assert all(b"\0" in w.tobytes() for w in L.cut_windows(np.frombuffer(b"ab c", np.uint8), 1, 6, 48))


def test_hard_rows(spark):
    docs = spark.createDataFrame(fx.hard_rows(), fx.SCHEMA).repartition(3)
    net = L.fit(docs, steps=20)
    assert net.langs == ["de", "en"]
    rows = docs.select("text", L.predict_language(F.col("text"), net, spark).alias("f")).select("text", "f.*").collect()
    assert len(rows) == len(fx.hard_rows())
    by_text = {}
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] in (net.langs if letter else [L.UNKNOWN]) and 0 <= r["score"] <= 1
        lang, score = by_text.setdefault(r["text"], (r["lang_pred"], r["score"]))
        assert lang == r["lang_pred"] and abs(score - r["score"]) < 3e-5


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], fx.SCHEMA)
    assert L.fit(none) is None
    docs = spark.createDataFrame(fx.hard_rows(), fx.SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    assert L.fit(docs) is None
    assert {tuple(r[0]) for r in docs.select(L.predict_language(F.col("text"), None, spark)).collect()} == {(L.UNKNOWN, 0.0)}


def test_the_sample_is_bounded_by_texts_whatever_repeats(spark):
    rows = [(1, f"word{k} text" if k % 2 else "same words", "en", None, 1, "x", None, "s", None, 3, None, 1) for k in range(300)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    seen = []

    class Stop(Exception):
        pass

    def train(self, windows, y, steps):
        seen.append(len(windows))
        raise Stop

    keep, L.Network.train = L.Network.train, train
    try:
        with pytest.raises(Stop):
            L.fit(docs, texts_per_lang=20)
    finally:
        L.Network.train = keep
    assert seen == [20 * L.WINDOWS_PER_TEXT]


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) > 100
