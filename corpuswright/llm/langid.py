"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Two gated recurrent units run over the bytes of a text, one forwards and one backwards. At every position their two states give
a distribution over languages, so every position is labelled; a document's distribution is the mean over the positions of its
letters (ASCII letters and all bytes beyond ASCII), and the prediction is its largest entry.

Texts are cut into stretches of `STRETCH` bytes, each read with `CONTEXT` bytes on either side that are not counted, so that no
labelled position is without context except at the ends of a text. All bytes of every text are labelled; time and memory of a
stretch are the same wherever it stands, and stretches of many texts run side by side as one matrix. Training is
backpropagation through time over windows of such stretches, cut at hashed places of a bounded sample of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .samples import crc_of
from .shared import restore, share
from .texts import column_bytes, column_udf, pieces

HIDDEN = 8
STRETCH, CONTEXT = 224, 16
#: stretches that run side by side
LANES = 2048
#: bounds of the training sample: texts of a language, windows of a text, their bytes, and languages (the most frequent)
TEXTS_PER_LANG = 200
WINDOWS_PER_TEXT = 8
WINDOW = 48
MOST_LANGS = 256
STEPS, LANES_TRAINED, RATE, CLIP = 500, 128, 0.02, 1.0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PAD = 0


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the cells' squashing function, a seventh of the cost of tanh; its slope is (1 − |y|)²."""
    return np.divide(x, np.abs(x) + np.float32(1), out=x)


def _open(x: np.ndarray) -> np.ndarray:
    """How far gates stand open, (squash + 1) / 2, in place; the slope is (1 − |2y − 1|)² / 2."""
    x = _squash(x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Per direction, gates of a byte and of a state (rows: reset, update, candidate, H each); output over both states."""

    langs: list[str]
    byte_gates: np.ndarray  # 2 × 3H × 256
    state_gates: np.ndarray  # 2 × 3H × H
    state_shift: np.ndarray  # 2 × H × 1: of the candidate's recurrent part
    out: np.ndarray  # 2 × languages × H
    out_shift: np.ndarray  # languages × 1

    @staticmethod
    def fresh(langs: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return Network(
            langs, normal(0.5, 2, 3 * HIDDEN, 256), normal(0.5, 2, 3 * HIDDEN, HIDDEN), np.zeros((2, HIDDEN, 1), np.float32),
            normal(0.3, 2, len(langs), HIDDEN), np.zeros((len(langs), 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.byte_gates, self.state_gates, self.state_shift, self.out, self.out_shift]

    def _step(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gates, candidate's recurrent part, candidate) of a step from the byte's and the state's parts of the gates."""
        gate = _open(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        inner = g[:, 2 * HIDDEN :] + self.state_shift
        fresh = _squash(inner * gate[:, :HIDDEN] + x[:, 2 * HIDDEN :])
        return gate, inner, fresh

    def states(self, lanes: np.ndarray) -> np.ndarray:
        """(2, time, H, lanes) states after each byte of (time, lanes); of the backward unit, after reading back to it."""
        steps, n = lanes.shape
        h = np.zeros((2, HIDDEN, n), np.float32)
        out = np.empty((2, steps, HIDDEN, n), np.float32)
        x, g = np.empty((2, 3 * HIDDEN, n), np.float32), np.empty((2, 3 * HIDDEN, n), np.float32)
        for t in range(steps):
            np.take(self.byte_gates[0], lanes[t], axis=1, out=x[0], mode="clip")
            np.take(self.byte_gates[1], lanes[steps - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(self.state_gates, h, out=g)
            gate, _, fresh = self._step(x, g, h)
            h -= fresh
            h *= gate[:, HIDDEN:]
            h += fresh
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """(time, languages, lanes) distribution of every position."""
        z = self.out[0] @ states[0]
        z += self.out[1] @ states[1]
        z += self.out_shift
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, lanes: np.ndarray, y: np.ndarray, counted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(mean log loss, gradients of `parameters`) over counted positions of (time, lanes), by backpropagation through time."""
        steps, n = lanes.shape
        both = np.stack((lanes, lanes[::-1]))
        hs = np.zeros((2, steps + 1, HIDDEN, n), np.float32)
        gates, inners, candidates = np.empty((2, steps, 2 * HIDDEN, n), np.float32), *np.empty((2, 2, steps, HIDDEN, n), np.float32)
        for t in range(steps):
            x = np.stack((self.byte_gates[0][:, both[0, t]], self.byte_gates[1][:, both[1, t]]))
            gates[:, t], inners[:, t], candidates[:, t] = self._step(x, self.state_gates @ hs[:, t], hs[:, t])
            hs[:, t + 1] = candidates[:, t] + gates[:, t, HIDDEN:] * (hs[:, t] - candidates[:, t])
        seen = np.stack((hs[0, 1:], hs[1, 1:][::-1]))
        dz = self.labels(seen)
        total, lane = max(1, int(counted.sum())), np.arange(n)
        loss = float(-(np.log(np.maximum(dz[:, y, lane], 1e-12)) * counted).sum() / total)
        dz[:, y, lane] -= 1
        dz *= (counted / total)[:, None, :].astype(np.float32)
        d_out = np.stack([(dz @ seen[k].transpose(0, 2, 1)).sum(axis=0) for k in (0, 1)])
        d_shift = dz.sum(axis=(0, 2))[:, None]
        from_out = np.stack((self.out[0].T @ dz, (self.out[1].T @ dz)[::-1]))
        d_state, d_inner = np.zeros_like(self.state_gates), np.zeros_like(self.state_shift)
        d_x = np.empty((2, steps, 3 * HIDDEN, n), np.float32)
        d_g = np.empty((2, 3 * HIDDEN, n), np.float32)
        dh = np.zeros((2, HIDDEN, n), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = dh + from_out[:, t]
            reset, update, fresh, before = gates[:, t, :HIDDEN], gates[:, t, HIDDEN:], candidates[:, t], hs[:, t]
            d_fresh = dh * (1 - update) * np.square(1 - np.abs(fresh))
            d_x[:, t, :HIDDEN] = d_fresh * inners[:, t] * np.square(1 - np.abs(2 * reset - 1)) * 0.5
            d_x[:, t, HIDDEN : 2 * HIDDEN] = dh * (before - fresh) * np.square(1 - np.abs(2 * update - 1)) * 0.5
            d_x[:, t, 2 * HIDDEN :] = d_fresh
            d_g[:, : 2 * HIDDEN] = d_x[:, t, : 2 * HIDDEN]
            d_g[:, 2 * HIDDEN :] = d_fresh * reset
            d_inner += d_g[:, 2 * HIDDEN :].sum(axis=2, keepdims=True)
            d_state += d_g @ before.transpose(0, 2, 1)
            dh = dh * update + self.state_gates.transpose(0, 2, 1) @ d_g
        one_hot = np.zeros((2, steps * n, 256), np.float32)
        for k in (0, 1):
            one_hot[k, np.arange(steps * n), both[k].ravel()] = 1
        d_byte = d_x.transpose(0, 2, 1, 3).reshape(2, 3 * HIDDEN, steps * n) @ one_hot
        return loss, [d_byte, d_state, d_inner, d_out, d_shift]

    def train(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam on batches with the same number of windows of each language; windows are (n, bytes)."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.parameters()]
        square = [np.zeros_like(p) for p in self.parameters()]
        of_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        per = max(1, LANES_TRAINED // len(self.langs))
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(own, per) for own in of_lang])
            lanes = windows[chosen].T
            _, grads = self.gradients(lanes, y[chosen], _LETTER[lanes])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), grads, mean, square):
                g = g * min(1.0, CLIP / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages) mean distribution over the letters of every row; zeros for rows without any."""
        sums = np.zeros((len(offsets) - 1, len(self.langs)))
        letters = np.zeros(len(offsets) - 1)
        size = np.diff(offsets)
        count = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        for a in range(0, len(row), LANES):
            own, first = row[a : a + LANES], nth[a : a + LANES] * STRETCH
            place = first[None, :] - CONTEXT + np.arange(STRETCH + 2 * CONTEXT)[:, None]
            inside = (place >= 0) & (place < size[own][None, :])
            lanes = np.where(inside, raw[np.clip(place + offsets[own][None, :], 0, len(raw) - 1)], _PAD)
            counted = (_LETTER[lanes] & inside)[CONTEXT : CONTEXT + STRETCH]
            p = self.labels(self.states(lanes)[:, CONTEXT : CONTEXT + STRETCH])
            np.add.at(sums, own, (p * counted[:, None, :]).sum(axis=0, dtype=np.float64).T)
            np.add.at(letters, own, counted.sum(axis=0))
        return sums / np.maximum(letters, 1)[:, None]


def cut_windows(text: np.ndarray, key: int, windows: int, width: int) -> np.ndarray:
    """Windows of a text's bytes at places that follow from its key, all over the text.

    Every other window is a short text: a few words from a word's start, alone between padding.
    """
    rng = np.random.default_rng(key & ((1 << 63) - 1))
    starts = np.concatenate(([0], np.flatnonzero(text == 0x20) + 1))
    out = np.full((windows, width), _PAD, np.uint8)
    for nth in range(windows):
        if nth % 2:
            size = int(rng.integers(4, width + 1))
            start, at = int(rng.choice(starts)), int(rng.integers(0, width - size + 1))
        else:
            size, at = width, 0
            start = int(rng.integers(0, max(1, len(text) - width + 1)))
        part = text[start : start + size]
        out[nth, at : at + len(part)] = part
    return out


def _windows(windows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column(0))
            keys = batch.column(2).to_pylist()
            cut = [cut_windows(raw[a:b], key, windows, width).tobytes() for a, b, key in zip(offsets[:-1], offsets[1:], keys)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), batch.column(1), batch.column(2)], names=["bytes", "lang", "key"])

    return run


def learnable(column: Column) -> Column:
    """Documents whose language may be learnt: crc32(doc_id) mod 5 is not 0."""
    return crc_of(column) % 5 != 0


def fit(docs: DataFrame, learn=learnable, texts_per_lang: int = TEXTS_PER_LANG, most_langs: int = MOST_LANGS, steps: int = STEPS,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most `texts_per_lang` texts of each of the `most_langs` most frequent languages, or None without any.

    Texts are chosen by a digest of the text, equal ones once, so repeated ids and rows do not widen the sample. A text with two
    languages teaches the lesser name. Texts without a letter and rows without language or text teach nothing.
    """
    col = lambda name: F.col(f"`{name}`")
    known = docs.where(learn(col(id_col))).select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null").where(has_letter(F.col("text")))
    keyed = known.select("text", "lang", F.xxhash64("text").alias("key"))
    per_text = keyed.groupBy("key").agg(F.min("lang").alias("lang"))
    langs = per_text.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    chosen = per_text.withColumn("nth", nth).where(F.col("nth") <= texts_per_lang).drop("nth")
    chosen = cut_lineage(chosen.join(F.broadcast(langs.select("lang")), "lang"), "language-sample")
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not names:
        return None
    # at most texts_per_lang · most_langs keys, so they may be broadcast
    wanted = keyed.join(F.broadcast(chosen.select("key", "lang")), ["key", "lang"]).select("text", "lang", "key")
    cut = wanted.mapInArrow(_windows(WINDOWS_PER_TEXT, WINDOW), "bytes binary, lang string, key long").distinct().collect()
    rows = sorted((r["lang"], r["key"], bytes(r["bytes"])) for r in cut)
    net = Network.fresh(names)
    windows = np.frombuffer(b"".join(b for *_, b in rows), np.uint8).reshape(len(rows) * WINDOWS_PER_TEXT, WINDOW)
    net.train(windows, np.repeat([names.index(lang) for lang, *_ in rows], WINDOWS_PER_TEXT), steps)
    return net


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def predict_language(text: Column, net: Network | None, spark) -> Column:
    """Struct (lang_pred, score) of a text column: the language of the largest pooled share, and that share.

    `und` with score 0 for null, for texts without a letter, and if nothing was learnt. Scores have five decimals: the last bits of
    a matrix product depend on how many stretches run side by side. Repeated rows and ids are predicted row by row.
    """
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing
    shared = share(spark, net)

    def predict(column: pa.Array) -> pa.Array:
        net, best, score = restore(Network, shared), np.zeros(len(column), np.int64), np.zeros(len(column))
        for first, raw, offsets in pieces(column):
            pooled = net.pooled(raw, offsets)
            own = slice(first, first + len(pooled))
            best[own], score[own] = pooled.argmax(axis=1), pooled.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(net.langs).take(pa.array(best)), pa.array(np.minimum(np.round(score, 5), 1.0))], names=["lang_pred", "score"])

    found = column_udf(predict, "struct<lang_pred: string, score: double>")(text.cast("string"))
    return F.when(F.coalesce(has_letter(text), F.lit(False)), found).otherwise(nothing)
