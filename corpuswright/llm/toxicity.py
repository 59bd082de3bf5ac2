"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word is the sum of a few entries of one embedding table: of its own hash and of the hashes of its first letters, so that words
of one stem share what is learnt. Filters of the widths 1, 2 and 3 slide over the words of the whole text; the maximum of each
filter feeds a logistic output. All labelled texts teach. The first coordinate of an entry starts as the shrunken log odds of
the class among the texts that hold it, counted over all of them; entries held by fewer than `LEAST_TEXTS` texts stay zero, so
that words of a single text cannot be learnt by heart. From there every shard, a bounded number of texts picked by a digest
of the id, trains a copy of the network in numpy, and what the shards have learnt is averaged: an entry over the shards that
changed it, the rest over all.

Scale and thresholds come from texts that the network did not see: `FOLDS` networks, trained in the same way, each leave a part
of the texts out. The logit is shifted so that the cut which separates these best is the score `DEFAULT_THRESHOLD`, and stretched
as a ridge-bound logistic fit asks. Each language has a cut of its own, shrunk towards the common one as if `SHRINK` texts
spoke for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .samples import labelled_sample, learnable
from .shared import restore, share
from .texts import LOWER, Words, column_udf, hash_spans, words

BUCKETS = 1 << 16
PREFIX_BYTES = (4, 6, 8)
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 12
EPOCHS = 3
RATE = 0.02
FOLDS = 2
#: width of the filter of each pooled unit; of each step of a filter its unit and its offset
UNIT_WIDTHS = np.repeat(WIDTHS, FILTERS)
STEP_UNITS = np.concatenate([np.tile(np.arange(FILTERS) + k * FILTERS, w) for k, w in enumerate(WIDTHS)])
STEP_OFFSETS = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
#: how many times as much as precision recall weighs where a cut is chosen
RECALL = 2.0
#: texts whose loss has a smaller slope than this teach nothing in an epoch
SETTLED = 0.1
DROPPED = 0.2
LEAST_TEXTS = 3
#: texts that the common share of a class counts for in an entry's first coordinate
PRIOR_TEXTS = 8.0
#: texts and bytes of a shard, about: what one task trains a copy of the network on
SHARD_TEXTS = 4000
SHARD_BYTES = 1 << 24
#: entries of the table that are averaged together
BLOCK = 512
#: words of a text that are filtered at once in training
STRETCH = 1 << 14
#: logits are rounded to so many parts of 1 for the scale, and cut at so many for the sums above them
FINE, COARSE, FAR = 256, 16, 64
#: labelled documents of the rarer class that the common threshold counts for in a language's own
SHRINK = 50.0
DEFAULT_THRESHOLD = 0.7

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_ids(piece: Words) -> np.ndarray:
    """(words, entries) table places: of the word without marks behind it, and of its first bytes. Place 0 is for none."""
    starts, ends = piece.starts, piece.ends.copy()
    for _ in range(3):
        marked = _PUNCT[piece.buffer[np.maximum(ends - 1, 0)]] & (ends - starts > 1) if len(starts) else np.zeros(0, bool)
        ends -= marked
    out = np.empty((len(starts), 1 + len(PREFIX_BYTES)), np.uint16)
    for k, size in enumerate((None, *PREFIX_BYTES)):
        hashes = hash_spans(piece.buffer, starts, ends if size is None else np.minimum(ends, starts + size)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        out[:, k] = (hashes >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and table places of the words of each text."""
    for piece in words(column, LOWER):
        ids = word_ids(piece)
        for k in range(piece.rows):
            yield piece.first + k, ids[piece.bounds[k] : piece.bounds[k + 1]]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a fold and class each entry stands."""
    held = np.zeros((FOLDS, 2, BUCKETS), np.int64)
    for batch in batches:
        y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for row, ids in _texts(batch.column(0)):
            held[fold[row], y[row], np.unique(ids)] += 1
    fold, y, place = (a.astype(np.int32) for a in np.nonzero(held))
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (fold, y, place, held[fold, y, place])], names=["fold", "y", "place", "n"])


@dataclass
class Network:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = DEFAULT_THRESHOLD

    scale: float = 1.0

    @staticmethod
    def fresh(held: np.ndarray, counts: np.ndarray, seed: int = 7) -> Network:
        """An untrained network whose table knows the log odds of the entries, held by `held[y]` of `counts[y]` texts."""
        rng = np.random.default_rng(seed)
        total = held.sum(axis=0)
        share = max(1, int(counts[1])) / max(2, int(counts.sum()))
        known = total >= LEAST_TEXTS
        known[0] = False
        table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        odds = lambda p: np.log(p) - np.log1p(-p)
        table[:, 0] = odds((held[1] + PRIOR_TEXTS * share) / (total + PRIOR_TEXTS)) - odds(np.float64(share))
        table[~known] = 0
        filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = 0.5 / len(f)
        out = np.full(len(WIDTHS) * FILTERS, 1.0 / (len(WIDTHS) * FILTERS), np.float32)
        return Network(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, -1.0)

    def copy(self) -> Network:
        return Network(self.table.copy(), [f.copy() for f in self.filters], [b.copy() for b in self.bias], self.out.copy(), self.shift)

    def rest(self) -> np.ndarray:
        """All that is learnt but the table, in one row."""
        return np.concatenate([*(f.ravel() for f in self.filters), *self.bias, self.out, [self.shift]]).astype(np.float64)

    def move(self, change: np.ndarray) -> None:
        """Add to what `rest` returns."""
        at = 0
        for part in (*self.filters, *self.bias, self.out):
            part += change[at : at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
        self.shift += float(change[at])

    def known(self) -> np.ndarray:
        return self.table.any(axis=1)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = self.table.take(ids[:, 0], axis=0)
        for column in ids.T[1:]:
            out += self.table.take(column, axis=0)
        return out

    def flat(self) -> np.ndarray:
        """All steps of all filters side by side."""
        return np.concatenate([step for f in self.filters for step in f], axis=1)

    def pool(self, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled activations of one text without biases, and where each maximum stands first; beyond the last word filters see padding."""
        pad = max(WIDTHS) - 1
        best, at = np.full(len(UNIT_WIDTHS), -np.inf, np.float32), np.zeros(len(UNIT_WIDTHS), np.int64)
        for start in range(0, len(ids), STRETCH):
            vectors = self.vectors(ids[start : start + STRETCH + pad])
            n = min(STRETCH, len(ids) - start)
            parts = np.zeros((n + pad, weights.shape[1]), np.float32)
            np.matmul(vectors, weights, out=parts[: len(vectors)])
            tops, values, column = [], [], 0
            for w in WIDTHS:
                z = parts[:n, column : column + FILTERS]
                for o in range(1, w):
                    z = z + parts[o : o + n, column + o * FILTERS : column + (o + 1) * FILTERS]
                column += w * FILTERS
                tops.append(z.argmax(axis=0))
                values.append(z[tops[-1], np.arange(FILTERS)])
            top, value = np.concatenate(tops), np.concatenate(values)
            higher = value > best
            best[higher], at[higher] = value[higher], top[higher] + start
        return best, at

    def train(self, texts: list[np.ndarray], y: np.ndarray, balance: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adagrad on the log loss, one text at a time, a text of class c weighing `balance[c]`; texts without words teach nothing."""
        rng = np.random.default_rng(seed)
        weight = balance[y]
        eps = np.float32(1e-6)
        weights, bias = self.flat(), np.concatenate(self.bias)
        g_table, g_weights, g_bias = np.full(BUCKETS, eps), np.full_like(weights, eps), np.full_like(bias, eps)
        g_out, g_shift = np.full_like(self.out, eps), 1e-6
        # entries that too few texts hold are none, in training as in scoring
        known = self.known()
        texts = [np.where(known[t], t, np.uint16(0)) for t in texts]
        for _ in range(epochs):
            for t in rng.permutation(len(texts)):
                if not len(texts[t]):
                    continue
                ids = texts[t].copy()
                ids[rng.random(len(ids), np.float32) < DROPPED] = 0
                z, at = self.pool(ids, weights)
                z += bias
                h = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(h @ self.out) + self.shift))))
                d = np.float32((p - y[t]) * weight[t])
                if abs(d) < SETTLED:
                    continue
                dz = d * self.out * (z > 0)
                grad = d * h
                g_out += grad * grad
                self.out -= RATE * grad / np.sqrt(g_out)
                g_shift += float(d * d)
                self.shift -= RATE * float(d) / np.sqrt(g_shift)
                g_bias += dz * dz
                bias -= RATE * dz / np.sqrt(g_bias)
                place = at[STEP_UNITS] + STEP_OFFSETS
                entries = ids[np.minimum(place, len(ids) - 1)]
                entries[place >= len(ids)] = 0
                part = dz[STEP_UNITS]
                change = weights.T * part[:, None]
                grad = self.vectors(entries).T * part
                g_weights += grad * grad
                weights -= RATE * grad / np.sqrt(g_weights)
                step, column = np.nonzero(entries)
                rows, squares = entries[step, column], (change * change).mean(axis=1)
                np.add.at(g_table, rows, squares[step])
                np.add.at(self.table, rows, (-RATE / np.sqrt(g_table[rows]))[:, None] * change[step])
        steps = np.split(weights, sum(WIDTHS), axis=1)
        self.filters = [np.stack([steps.pop(0) for _ in range(w)]) for w in WIDTHS]
        self.bias = np.split(bias, len(WIDTHS))

    def calibrate(self, scored: DataFrame, counts: np.ndarray, weights: np.ndarray) -> None:
        """Shift, scale and thresholds from (lang, y, z) of texts that were not learnt from: `counts` of each class, each
        text standing for `weights` labelled rows of its class."""
        found = best_cuts(scored.select(F.lit("").alias("scope"), "y", "z"), weights, 0.0)
        common = found[""][0] if found else 0.0
        goal = np.log(DEFAULT_THRESHOLD / (1 - DEFAULT_THRESHOLD))
        # the slope a of sigmoid(a (z − cut) + goal), by Newton steps on the log loss with a ridge that pulls it to 1
        step = F.greatest(F.least(F.round((F.col("z") - common) * FINE), F.lit(float(FAR * FINE))), F.lit(float(-FAR * FINE))).cast("int")
        bins = scored.groupBy(step.alias("step"), "y").agg(F.count("*").alias("n")).orderBy("step", "y").toArrow()
        away, y, n = bins["step"].to_numpy() / FINE, bins["y"].to_numpy(), bins["n"].to_numpy()
        balance, a = (0.5 * counts.sum() / np.maximum(1, counts))[y] * n, 1.0
        for _ in range(20):
            p = _sigmoid(a * away + goal)
            slope = (balance * (p - y) * away).sum() + (a - 1)
            bend = (balance * p * (1 - p) * away * away).sum() + 1
            a = float(np.clip(a - slope / bend, 0.2, 5.0))
        self.scale = a
        self.shift += float(goal / a - common)
        self.default = DEFAULT_THRESHOLD
        own = best_cuts(scored.where("lang is not null").select(F.col("lang").alias("scope"), "y", "z"), weights, common)
        for name, (cut, rare) in sorted(own.items()):
            cut = (rare * cut + SHRINK * common) / (rare + SHRINK)
            self.thresholds[name] = float(_sigmoid(np.array(a * (cut - common) + goal)))

    def logits(self, piece: Words) -> np.ndarray:
        """Scores before the sigmoid of every row of a piece."""
        counts = piece.counts()
        full = np.flatnonzero(counts)
        score = np.full(len(counts), self.shift, np.float64)
        if len(full):
            ids = word_ids(piece)
            vectors = self.table[ids[:, 0]]
            for column in ids.T[1:]:
                vectors += self.table[column]
            at = piece.bounds[full]
            # words left in the row from each word on: beyond them a filter sees padding
            left = np.repeat(piece.bounds[1:][full], counts[full]) - np.arange(len(ids))
            for k, f in enumerate(self.filters):
                z = np.zeros((len(ids), FILTERS), np.float32)
                for o in range(len(f)):
                    step = vectors[o:] @ f[o]
                    if o:
                        step[left[: len(step)] <= o] = 0
                    z[: len(step)] += step
                top = np.maximum(np.maximum.reduceat(z, at, axis=0) + self.bias[k], 0)
                score[full] += top @ self.out[k * FILTERS : (k + 1) * FILTERS].astype(np.float64)
        return score * self.scale


def _balance(counts: np.ndarray) -> np.ndarray:
    """Weights by which both classes weigh the same."""
    return counts.sum() / (2 * np.maximum(1, counts))


def _learn(nets: dict[int, tuple[Broadcast, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    """What one shard changes in each network, which leaves the fold of its number out: table rows by block, and the rest (-1)."""

    def learn(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_pylist()
        rows = rows.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
        y, fold = rows["y"].to_numpy(), rows["fold"].to_numpy()
        texts = [ids for _, ids in _texts(rows["text"].combine_chunks())]
        out = []
        for k, (shared, balance) in nets.items():
            own = np.flatnonzero(fold != k)
            if not len(own):
                continue
            start = restore(Network, shared)
            net = start.copy()
            net.train([texts[t] for t in own], y[own], balance)
            change = net.table - start.table
            moved = np.flatnonzero(change.any(axis=1))
            for block in np.unique(moved // BLOCK):
                at = moved[moved // BLOCK == block]
                out.append((k, int(block), (at % BLOCK).astype(np.int32).tobytes(), change[at].tobytes()))
            out.append((k, -1, b"", (net.rest() - start.rest()).tobytes()))
        shard = rows["shard"][0].as_py() if len(rows) else 0
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([shard] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["shard", "net", "block", "places", "change"])

    return learn


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of what the shards changed in one block; a table row counts for the shards that changed it."""
    rows = rows.sort_by("shard")
    net, block = rows["net"][0].as_py(), rows["block"][0].as_py()
    total, times = np.zeros((BLOCK, DIM)), np.zeros(BLOCK)
    if block < 0:
        places, change = b"", (sum(np.frombuffer(c.as_py(), np.float64) for c in rows["change"]) / len(rows)).tobytes()
    else:
        for at, c in zip(rows["places"], rows["change"]):
            at = np.frombuffer(at.as_py(), np.int32)
            total[at] += np.frombuffer(c.as_py(), np.float32).reshape(-1, DIM)
            times[at] += 1
        at = np.flatnonzero(times)
        places, change = at.astype(np.int32).tobytes(), (total[at] / times[at, None]).astype(np.float32).tobytes()
    return pa.table([pa.array([net], pa.int32()), pa.array([block], pa.int32()), pa.array([places], pa.binary()), pa.array([change], pa.binary())], names=["net", "block", "places", "change"])


def _train(rows: DataFrame, nets: dict[int, Network], balances: dict[int, np.ndarray], shards: int) -> None:
    """Train the networks on all rows, shard by shard."""
    spark = rows.sparkSession
    shared = {k: (share(spark, net), balances[k]) for k, net in nets.items()}
    placed = rows.select(F.col("key").cast("string").alias("key"), "text", "y", "fold", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    learnt = placed.groupBy("shard").applyInArrow(_learn(shared), "shard int, net int, block int, places binary, change binary")
    means = learnt.groupBy("net", "block").applyInArrow(_mean, "net int, block int, places binary, change binary").toArrow()
    for k, block, places, change in zip(*(means[c].to_pylist() for c in ("net", "block", "places", "change"))):
        if block < 0:
            nets[k].move(np.frombuffer(change, np.float64))
        else:
            nets[k].table[block * BLOCK + np.frombuffer(places, np.int32)] += np.frombuffer(change, np.float32).reshape(-1, DIM)
    for handle, _ in shared.values():
        handle.destroy()


def _left_out(nets: dict[int, Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Logits of texts by the network that has not seen them; 0 if there is none."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = {k: restore(Network, shared) for k, shared in nets.items()}
        others = {k: (net, net.flat()) for k, net in others.items()}
        for batch in batches:
            fold = batch.column(2).to_numpy()
            z = np.zeros(len(fold))
            for row, ids in _texts(batch.column(0)):
                if fold[row] in others:
                    z[row] = _logit(*others[fold[row]], ids)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), pa.array(z)], names=["lang", "y", "z"])

    return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", lang_col: str = "lang", per_class: int | None = None,
        learn=learnable, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on all labelled rows, one text of each id, with score and thresholds calibrated on texts left out in turn.

    With `per_class` only about so many documents of each class teach. Without rows of both classes the network stays
    untrained and scores everything by one constant below the default threshold.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = labelled_sample(docs.withColumn("__cw_lang", lang), labels, label, per_class, learn, id_col, text_col, ("__cw_lang",))
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = cut_lineage(rows.select("key", "text", "y", "weight", F.col("__cw_lang").alias("lang"), fold.alias("fold")), "toxicity-rows")
    sizes = rows.groupBy("fold", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("weight").alias("weight")).collect()
    counts, weights = np.zeros((FOLDS, 2), np.int64), np.ones(2)
    for r in sizes:
        counts[r["fold"], r["y"]], weights[r["y"]] = r["n"], r["weight"]
    every = counts.sum(axis=0)
    if not every.all():
        net = Network.fresh(np.zeros((2, BUCKETS)), np.zeros(2))
        net.out[:] = 0
        return net
    held = np.zeros((FOLDS, 2, BUCKETS), np.int64)
    found = rows.select("text", "y", "fold").mapInArrow(_held, "fold int, y int, place int, n long").groupBy("fold", "y", "place").agg(F.sum("n").alias("n")).toArrow()
    held[tuple(found[c].to_numpy() for c in ("fold", "y", "place"))] = found["n"].to_numpy()
    # a network that has not seen a text says what new texts will look like; number FOLDS leaves none out
    parts = {k: np.arange(FOLDS) != k for k in range(FOLDS + 1)}
    parts = {k: p for k, p in parts.items() if counts[p].sum(axis=0).all()}
    nets = {k: Network.fresh(held[p].sum(axis=0), counts[p].sum(axis=0)) for k, p in parts.items()}
    size = sum(r["bytes"] or 0 for r in sizes)
    shards = max(-(-int(every.sum()) // SHARD_TEXTS), -(-size // SHARD_BYTES))
    _train(rows, nets, {k: _balance(counts[p].sum(axis=0)) for k, p in parts.items()}, shards)
    net = nets.pop(FOLDS)
    shared = {k: share(docs.sparkSession, other) for k, other in nets.items()}
    scored = cut_lineage(rows.select("text", "y", "fold", "lang").mapInArrow(_left_out(shared), "lang string, y int, z double"), "toxicity-logits")
    for handle in shared.values():
        handle.destroy()
    net.calibrate(scored, every, weights)
    return net


def _logit(net: Network, weights: np.ndarray, ids: np.ndarray) -> float:
    return float(np.maximum(net.pool(ids, weights)[0] + np.concatenate(net.bias), 0) @ net.out + net.shift) if len(ids) else net.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray, fallback: float) -> float:
    """The cut of the best F measure, in the middle of the widest such gap between logits; the fallback if it is as good.

    `weight` gives clean documents their real share, which the sample does not have.
    """
    if not y.any():
        return fallback
    order = np.argsort(-z, kind="stable")
    hit, all_hit = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f = (1 + RECALL**2) * hit / (all_hit + RECALL**2 * (weight * y).sum())
    ordered = z[order]
    # a cut lies below the last of equal logits
    below = np.append(ordered[1:], ordered[-1] - 1)
    places = np.flatnonzero(ordered > below)
    at_fallback = np.flatnonzero(ordered >= fallback)
    if len(at_fallback) and f[at_fallback[-1]] >= f[places].max():
        return fallback
    good = places[f[places] >= f[places].max()]
    best = good[np.argmax(ordered[good] - below[good])]
    return float((ordered[best] + below[best]) / 2)


def best_cuts(scored: DataFrame, weights: np.ndarray, fallback: float) -> dict[str, tuple[float, int]]:
    """`best_cut` of every scope over all rows (scope, y, z), and the size of its rarer class.

    A text of class c weighs `weights[c]`. Sums over the logits above are taken in two levels, over stretches of logits and inside one.
    """
    stretch = F.floor(F.greatest(F.least(F.col("z") * COARSE, F.lit(float(FAR * COARSE))), F.lit(float(-FAR * COARSE))))
    steps = scored.groupBy("scope", "z").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).withColumn("stretch", stretch)
    falling = Window.partitionBy("scope").orderBy(F.desc("stretch"))
    before, whole = falling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("scope")
    sums = steps.groupBy("scope", "stretch").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"), F.max("z").alias("top")).select(
        "scope", "stretch", *(F.coalesce(F.sum(f"s{c}").over(before), F.lit(0)).alias(f"b{c}") for c in (0, 1)),
        *(F.sum(f"s{c}").over(whole).alias(f"t{c}") for c in (0, 1)), F.lead("top").over(falling).alias("next"))
    inside = Window.partitionBy("scope", "stretch").orderBy(F.desc("z"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.join(sums, ["scope", "stretch"]).select(
        "scope", "z", "t0", "t1", *((F.col(f"b{c}") + F.sum(f"n{c}").over(upto)).alias(f"h{c}") for c in (0, 1)),
        F.coalesce(F.lead("z").over(inside), "next", F.col("z") - 1).alias("below"))
    w0, w1 = (F.lit(float(w)) for w in weights)
    hit = w1 * F.col("h1")
    curve = curve.withColumn("f", (1 + RECALL**2) * hit / (hit + w0 * F.col("h0") + RECALL**2 * w1 * F.col("t1")))
    best = curve.groupBy("scope").agg(
        F.max(F.struct("f", (F.col("z") - F.col("below")).alias("gap"), "z", "below")).alias("best"),
        F.max(F.when(F.col("z") >= fallback, F.struct(-F.col("z"), "f"))).alias("kept"), F.first("t0").alias("t0"), F.first("t1").alias("t1")).collect()
    out = {}
    for r in best:
        stay = not r["t1"] or r["kept"] is not None and r["kept"]["f"] >= r["best"]["f"]
        out[r["scope"]] = (fallback if stay else (r["best"]["z"] + r["best"]["below"]) / 2, min(r["t0"], r["t1"]))
    return out


def toxicity_score(text, net: Network, spark):
    """A column of scores in (0, 1); null and empty texts get the score of a text without words."""
    shared = share(spark, net)

    def score(column: pa.Array) -> pa.Array:
        net, out = restore(Network, shared), np.zeros(len(column))
        for piece in words(column, LOWER, 1 << 19):
            out[piece.first : piece.first + piece.rows] = net.logits(piece)
        return pa.array(_sigmoid(out))

    return column_udf(score, "double")(text)


def threshold_of(lang, net: Network):
    """The calibrated threshold of a language column; unknown and null languages get the common one."""
    out = F.lit(net.default)
    for name, value in sorted(net.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose score lies below the threshold of their language; all columns stay.

    Rows are judged one by one: repeated rows share their fate, nulls are texts without words.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.where(toxicity_score(F.col(f"`{text_col}`"), net, docs.sparkSession) < threshold_of(lang, net))
