"""Quality by logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader updates.

The features of a text are its words, pairs of neighbouring words, and the n-grams (1 to 3) of the words' shapes, hashed
into one space of `BUCKETS` weights. A shape is what is left of a word when its letters are folded: case pattern,
marks at its end, and whether it repeats the word in front. A feature's value is its share of its kind in the text, so
texts of all lengths compare. Training is FTRL-proximal (per-coordinate rates, L1 and L2) in numpy on a bounded sample;
scoring is one sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .samples import labelled_sample, learnable
from .shared import restore, share
from .texts import PLAIN, Words, chain, column_udf, mix, words

BUCKETS = 1 << 18
#: bound of the training sample: about so many labelled documents of each class
SAMPLE_PER_CLASS = 2000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
#: the kinds of features and their weights: words, word pairs, shapes, shape pairs, shape triples
KINDS = (1.0, 1.0, 3.0, 3.0, 3.0)

_UPPER, _LOWER, _DIGIT, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x61:0x7B] = _LOWER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x80:] = _LOWER


def shapes(piece: Words) -> np.ndarray:
    """One hash per word: class of its first, second and last bytes, its last byte if a mark, length class, repetition."""
    starts, ends, buffer = piece.starts, piece.ends, piece.buffer
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    last = buffer[ends - 1]
    before = buffer[np.maximum(ends - 2, starts)]
    mark = np.where(_CLASS[last] == _OTHER, last, 0).astype(np.uint64)
    mark2 = np.where((_CLASS[before] == _OTHER) & (mark > 0), before, 0).astype(np.uint64)
    second = _CLASS[buffer[np.minimum(starts + 1, ends - 1)]].astype(np.uint64)
    length = np.minimum(np.log2(size).astype(np.int64), 6).astype(np.uint64)
    repeat = np.zeros(len(starts), np.uint64)
    repeat[1:] = piece.hashes[1:] == piece.hashes[:-1]
    repeat[piece.bounds[:-1][piece.bounds[:-1] < len(repeat)]] = 0
    code = _CLASS[buffer[starts]].astype(np.uint64)
    for part, room in ((second, 8), (mark, 256), (mark2, 256), (length, 8), (repeat, 2)):
        code = code * np.uint64(room) + part
    return mix(code)


def features(piece: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every n-gram occurrence of a piece."""
    counts = piece.counts()
    row = np.repeat(np.arange(len(counts)), counts)
    form = shapes(piece)
    rows, buckets, values = [], [], []
    for kind, (base, n, weight) in enumerate(zip((piece.hashes, piece.hashes, form, form, form), (1, 2, 1, 2, 3), KINDS)):
        grams = mix(chain(base, n) + np.uint64(kind + 1))
        own = row[: len(grams)]
        inside = own == row[n - 1 :][: len(grams)] if n > 1 else np.ones(len(grams), bool)
        total = np.maximum(counts - n + 1, 1).astype(np.float32)
        rows.append(own[inside])
        buckets.append(((grams >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int32)[inside])
        values.append((np.float32(weight) / total)[own[inside]])
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def _pooled(buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(buckets, return_inverse=True)
    return distinct, np.sqrt(np.bincount(which, values)).astype(np.float32)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in words(batch.column(1), PLAIN):
            row, bucket, value = features(piece)
            order = np.argsort(row, kind="stable")
            row, bucket, value = row[order], bucket[order], value[order]
            at = np.searchsorted(row, np.arange(piece.rows + 1))
            pairs = [_pooled(bucket[a:b], value[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(piece.first, piece.rows),
                    pa.array([p.tobytes() for p, _ in pairs], pa.binary()),
                    pa.array([v.tobytes() for _, v in pairs], pa.binary()),
                    batch.column(2).slice(piece.first, piece.rows),
                ],
                names=["key", "ids", "values", "y"],
            )


@dataclass
class Model:
    weights: np.ndarray
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit + self.shift, -30, 30)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """FTRL-proximal: weights follow in closed form from the sums z of shifted gradients and n of squared ones."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last coordinate is the constant
    sparse = np.full(BUCKETS + 1, L1)
    sparse[-1] = 0
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))

    def solve(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * sparse[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= sparse[i], 0.0, w)

    for _ in range(epochs):
        for t in rng.permutation(len(rows)):
            i = np.append(rows[t][0], BUCKETS)
            x = np.append(rows[t][1], 1.0)
            w = solve(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[t]) * weight[t] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = solve(np.arange(BUCKETS + 1))
    return Model(every[:-1].astype(np.float32), float(every[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, learn=learnable,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on about `per_class` labelled documents of each class. Without rows of both classes every score is 0.5."""
    sample = labelled_sample(docs, labels, label, per_class, learn, id_col, text_col)
    id_type = sample.schema["key"].dataType.simpleString()
    rows = sample.mapInArrow(_coded, f"key {id_type}, ids binary, values binary, y int").collect()
    rows = sorted(rows, key=lambda r: (str(r["key"]), bytes(r["ids"])))
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return ftrl([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], y)


def score_piece(piece: Words, model: Model) -> np.ndarray:
    """Logits without the constant of each row: values of equal features are pooled as in training."""
    row, bucket, value = features(piece)
    used = model.weights[bucket] != 0
    row, bucket, value = row[used], bucket[used], value[used]
    key = row.astype(np.int64) * BUCKETS + bucket
    order = np.argsort(key)
    key, value = key[order], value[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    pooled = np.sqrt(np.add.reduceat(value, heads)) if len(heads) else np.zeros(0, np.float32)
    return np.bincount(key[heads] // BUCKETS, pooled * model.weights[key[heads] % BUCKETS], minlength=piece.rows)


def quality_score(text, model: Model, spark):
    """A column of scores in (0, 1), higher for label 1; null and empty texts have no features."""
    shared = share(spark, model)

    def score(column: pa.Array) -> pa.Array:
        model, out = restore(Model, shared), np.zeros(len(column))
        for piece in words(column, PLAIN, 1 << 20):
            out[piece.first : piece.first + piece.rows] = score_piece(piece, model)
        return pa.array(model.probability(out))

    return column_udf(score, "double")(text)
