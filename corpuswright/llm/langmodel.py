"""Language-model scoring with an Elias-Fano n-gram trie that is spread over shards by context.

The model is a bigram model with Witten-Bell smoothing: p(w | v) = (1 - L(v)) c(v w) / c(v) + L(v) p0(w), where
L(v) = t(v) / (t(v) + c(v)) and t(v) is the number of different successors of v. p0(w) = c(w) / (N + 1), with
c(w) = 1 for one unknown word. A context so frequent
that it would fill a shard is hot: it is split by its successor, and its counts are added up over all shards first, so that
its L is that of any context. Training and scoring are one flow:

1. the exact count of every training word, shuffled as one row per block and word, gives N, V, the hot contexts and the `TOP` most
   frequent words, which all tasks know;
2. every block asks for the counts of its other words: it sends each word with its count and the shards it is needed in to the
   shard of the word, which answers these shards. The distinct pairs of hot contexts go the same way and give t(v) of each;
3. every block of documents sends to each shard the distinct pairs (context, successor) that belong there, with the
   documents they occur in;
4. a shard adds up the counts, builds its trie, queries it for all pairs, and returns sums per document;
5. the sums of a block meet in one small group, next to the block's ids.

A block is at most `BLOCK_BYTES` of text (or one longer text). A shard holds about `SHARD_TOKENS` tokens, so the
number of shards follows the corpus. Nothing but the most frequent words and the hot contexts, both of bounded size, is
sent to all tasks; which words these are changes the way of a count, not the count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .eliasfano import Trie
from .samples import crc_of
from .shared import restore, share
from .texts import LOWER, Words, mix, words

TOP = 1 << 16
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 2_000_000

_CONTEXT = np.uint64((1 << 62) - 1)
_WORD = np.uint64((1 << 48) - 1)
#: the end of a text, and what stands in front of its first word, as hashes
END, BEGIN = (int(x) for x in mix(np.array([0xE0D, 0xB0B], np.uint64)))


@dataclass
class Counts:
    """What all tasks know of the training words."""

    tokens: int  # N
    types: int  # V
    texts: int
    top: np.ndarray  # word hashes (48 bits), ascending
    top_log: np.ndarray  # log10 of p0 of these
    once_log: float  # log10 of p0 of a word that occurs once or never
    hot: np.ndarray  # context hashes (62 bits), ascending
    hot_count: np.ndarray
    hot_types: np.ndarray  # different successors of each
    shards: int


def held_out_rows(column):
    """Texts that the model does not learn from: crc32 of the id as text, mod 7, is 2."""
    return crc_of(column) % 7 == 2


def _sequence(piece: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with one end per row, bounds, row of each token)."""
    bounds = piece.bounds + np.arange(piece.rows + 1)
    tokens = np.empty(bounds[-1], np.uint64)
    end = np.zeros(bounds[-1], bool)
    end[bounds[1:] - 1] = True
    tokens[end] = END
    tokens[~end] = piece.hashes
    return tokens, bounds, np.repeat(np.arange(piece.rows), np.diff(bounds))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        learn = ~np.asarray(batch.column(0))
        for piece in words(batch.column(1), LOWER, BLOCK_BYTES):
            tokens, _, row = _sequence(piece)
            own, n = np.unique(tokens[learn[piece.first : piece.first + piece.rows][row]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["h", "n"])


def word_counts(source: DataFrame, shard_tokens: int = SHARD_TOKENS, top: int = TOP) -> Counts:
    counted = source.select("held_out", "text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted, "lm-words")
    types, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-tokens // shard_tokens))
    # frequencies in eighths of an octave; the least bin from which on no more than `top` words are found
    bin_ = F.floor(F.log2("n") * 8).cast("int")
    rest, least = top, 0
    for r in sorted(counted.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["bin"]):
        rest -= r["words"]
        if rest < 0:
            least = r["bin"] + 1
            break
    best = counted.where(bin_ >= least).collect()
    hashes = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in best], np.float64)
    ends = counted.where(F.col("h") == int(np.array(END, np.uint64).view(np.int64))).first()
    short = hashes & _WORD
    order = np.argsort(short)
    texts = ends["n"] if ends else 0
    # fewer than 4 * shards words; an end is no context
    hot = (n * 4 * shards > max(1, tokens)) & (hashes != np.uint64(END))
    ids, hot_n = hashes[hot] & _CONTEXT, n[hot]
    if texts * 4 * shards > max(1, tokens):  # the border in front of a text is a context too
        ids, hot_n = np.append(ids, np.uint64(BEGIN) & _CONTEXT), np.append(hot_n, texts)
    by = np.argsort(ids)
    return Counts(
        tokens, types, texts, short[order].astype(np.int64), np.log10(n[order] / (tokens + 1)) if len(n) else n,
        float(-np.log10(tokens + 1)), ids[by].astype(np.int64), hot_n[by].astype(np.int64), np.zeros(len(ids), np.int64), shards,
    )


def _shard_of(context: np.ndarray, successor: np.ndarray, counts: Counts) -> np.ndarray:
    key = context.astype(np.uint64)
    hot = _place(counts.hot, context) >= 0
    if hot.any():
        key[hot] = mix(key[hot] ^ mix(successor[hot].astype(np.uint64)))
    return (mix(key) % np.uint64(counts.shards)).astype(np.int32)


def _place(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _zip(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.dtype.str.encode().ljust(8) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 16].strip().decode())
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of 64-bit numbers, byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _widen(planes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<i8").reshape(-1)


def _contexts(piece: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, successor, row of each token, bounds)."""
    tokens, bounds, row = _sequence(piece)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[bounds[:-1]] = BEGIN
    return (context & _CONTEXT).astype(np.int64), (tokens & _WORD).astype(np.int64), row, bounds


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination starts in sorted arrays, and the end."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new) if len(keys[0]) else np.zeros(1, np.int64)


_ASKED = "shard int, data binary"


def _ask(counts_shared):
    """Per block and shard: the distinct learnt pairs of hot contexts, and words with their counts and the shards that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = restore(Counts, counts_shared)
        for batch in batches:
            held = np.asarray(batch.column(0))
            for piece in words(batch.column(1), LOWER, BLOCK_BYTES):
                context, successor, row, _ = _contexts(piece)
                learn = ~held[piece.first : piece.first + piece.rows][row]
                use = learn & (_place(counts.hot, context) >= 0)
                pair, follows = _distinct(context[use], successor[use])
                pair_shard = _shard_of(pair, follows, counts)
                use = _place(counts.top, successor) < 0
                word, learn, target = successor[use], learn[use], _shard_of(context[use], successor[use], counts)
                home = _home(word, counts)
                order = np.lexsort((target, word, home))
                word, learn, target, home = word[order], learn[order], target[order], home[order]
                by = np.argsort(pair_shard, kind="stable")
                pair, follows, pair_shard = _place(counts.hot, pair[by]).astype(np.uint32), follows[by], pair_shard[by]
                rows = np.union1d(pair_shard, home)
                left, right = (np.searchsorted(x, rows, side="left").tolist() for x in (pair_shard, home))
                left_end, right_end = (np.searchsorted(x, rows, side="right").tolist() for x in (pair_shard, home))
                data = []
                for a, b, c, d in zip(left, left_end, right, right_end):
                    w, t = word[c:d], target[c:d]
                    cells, heads = _groups(w, t), _groups(w)
                    learnt = np.add.reduceat(learn[c:d].astype(np.int64), heads[:-1]) if d > c else np.zeros(0, np.int64)
                    data.append(_zip(
                        pair[a:b], _narrow(follows[a:b], 6), _narrow(w[heads[:-1]], 6), learnt.astype(np.uint32),
                        np.diff(np.searchsorted(cells, heads)).astype(np.uint32), t[cells[:-1]].astype(np.uint32),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

    return run


_ANSWERED = "context long, types long, shard int, data binary"


def _answer(counts_shared):
    """Different successors of hot contexts, and for each shard the counts it asked for; a word without an answer occurs once or never."""

    def run(table: pa.Table) -> pa.Table:
        counts = restore(Counts, counts_shared)
        parts = [_unzip(d.as_py()) for d in table["data"]]
        hot, _ = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([_widen(p[1], 6) for p in parts]))
        at, types = np.unique(hot, return_counts=True)
        word = np.concatenate([_widen(p[2], 6) for p in parts])
        known, own = np.unique(word, return_inverse=True)
        n = np.bincount(own, np.concatenate([p[3] for p in parts]), len(known)).astype(np.int64)
        asker = np.repeat(own, np.concatenate([p[4] for p in parts]))
        target = np.concatenate([p[5] for p in parts])
        often = n[asker] > 1
        target, asker = _distinct(target[often], asker[often])
        cuts = _groups(target).tolist()
        data = [_zip(_narrow(known[asker[a:b]], 6), n[asker[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        none = len(at)
        return pa.table({
            "context": pa.array([*counts.hot[at].tolist(), *[None] * len(data)], pa.int64()), "types": pa.array([*types.tolist(), *[None] * len(data)], pa.int64()),
            "shard": pa.array([*[None] * none, *target[cuts[:-1]].tolist()], pa.int32()), "data": pa.array([*[None] * none, *data], pa.binary()),
        })

    return run


def _home(word: np.ndarray, counts: Counts) -> np.ndarray:
    """The shard that adds up a word's count."""
    return (mix(word.astype(np.uint64)) % np.uint64(counts.shards)).astype(np.int32)


def count_words(source: DataFrame, counts: Counts) -> DataFrame:
    """(shard, data): the counts of words that a shard needs and that are not in `top`. Sets `hot_types`; a pair lies in one shard, so the shards' counts add up."""
    shared = share(source.sparkSession, counts)
    asked = source.select("held_out", "text").mapInArrow(_ask(shared), _ASKED)
    answered = cut_lineage(asked.groupBy("shard").applyInArrow(_answer(shared), _ANSWERED), "lm-answers")
    if len(counts.hot):
        for r in answered.where("context is not null").groupBy("context").agg(F.sum("types").alias("types")).collect():
            counts.hot_types[np.searchsorted(counts.hot, r["context"])] = r["types"]
    return answered.where("shard is not null").select("shard", "data")


_SENT = "shard int, block string, head boolean, data binary"


def _send(counts_shared):
    """Per block: one row of ids, and for each shard the pairs it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = restore(Counts, counts_shared), 0
        for batch in batches:
            held = np.asarray(batch.column(1))
            for piece in words(batch.column(2), LOWER, BLOCK_BYTES):
                # the same rows get the same name if the task runs again
                block = f"{TaskContext.get().partitionId()}-{done}"
                done += 1
                context, successor, row, bounds = _contexts(piece)
                part = held[piece.first : piece.first + piece.rows]
                row = row * 2 + part[row]  # the last bit says that the text is held out
                order = np.lexsort((row, successor, context))
                context, successor, row = context[order], successor[order], row[order]
                shard = _shard_of(context, successor, counts)
                by = np.argsort(shard, kind="stable")
                context, successor, row, shard = context[by], successor[by], row[by], shard[by]
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                rows, data = [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    c, s = context[a:b], successor[a:b]
                    new_c = np.concatenate(([True], c[1:] != c[:-1]))
                    new = new_c | np.concatenate(([True], s[1:] != s[:-1]))
                    heads = np.flatnonzero(new)
                    uses = np.diff(np.append(heads, b - a))
                    pairs = np.diff(np.append(np.flatnonzero(new_c[heads]), len(heads)))
                    rows.append(int(shard[a]))
                    data.append(_zip(
                        _narrow(c[new_c], 8), pairs.astype(np.uint32), _narrow(s[heads], 6), uses.astype(np.uint32),
                        row[a:b].astype(np.uint32 if piece.rows > 32768 else np.uint16),
                    ))
                sink = pa.BufferOutputStream()
                head = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.rows), pa.array(part), pa.array(np.diff(bounds))], names=["id", "held_out", "n_tokens"]
                )
                with pa.ipc.new_stream(sink, head.schema) as writer:
                    writer.write_batch(head)
                rows.append(int(mix(bounds[-1:].astype(np.uint64))[0] % np.uint64(counts.shards)))
                data.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int32()), pa.array([block] * len(rows)), pa.array([False] * (len(rows) - 1) + [True]), pa.array(data, pa.binary())],
                    names=["shard", "block", "head", "data"],
                )

    return run


@dataclass
class _Shard:
    """What one shard received, pairs of all blocks end to end, and the counts of words that it asked for."""

    blocks: list[str]
    context: np.ndarray
    successor: np.ndarray
    uses: np.ndarray
    learnt: np.ndarray  # training uses of each pair of each block
    at: np.ndarray  # pairs of block k: at[k] .. at[k + 1]
    rows: list[np.ndarray]
    words: np.ndarray
    word_log: np.ndarray  # log10 of p0 of these

    @staticmethod
    def of(table: pa.Table, counts: Counts) -> _Shard:
        answers = table.filter(pa.compute.is_null(table["block"]))
        table = table.filter(pa.compute.and_(pa.compute.is_valid(table["block"]), pa.compute.invert(table["head"])))
        blocks, data = table["block"].to_pylist(), [x.as_py() for x in table["data"]]
        contexts, successors, uses, learnt, rows = [], [], [], [], []
        for d in data:
            c, pairs, s, u, row = _unzip(d)
            contexts.append(np.repeat(_widen(c, 8), pairs))
            successors.append(_widen(s, 6))
            uses.append(u)
            own = np.repeat(np.arange(len(u)), u)
            learnt.append(np.bincount(own[row & 1 == 0], minlength=len(u)))
            rows.append(row >> 1)
        at = np.concatenate(([0], np.cumsum([len(u) for u in uses]))).astype(np.int64)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        told = [_unzip(x.as_py()) for x in answers["data"]]
        known, n = join([_widen(w, 6) for w, _ in told]), join([n for _, n in told])
        order = np.argsort(known)
        log = np.log10(n[order] / (counts.tokens + 1))
        return _Shard(blocks, join(contexts), join(successors), join(uses), join(learnt), at, rows, known[order], log)

    def plain_log(self, successor: np.ndarray, counts: Counts) -> np.ndarray:
        """log10 of p0."""
        log = np.full(len(successor), counts.once_log)
        for known, logs in ((self.words, self.word_log), (counts.top, counts.top_log)):
            at = _place(known, successor)
            log[at >= 0] = logs[at[at >= 0]]
        return log

    def trie(self, counts: Counts) -> tuple[Trie, np.ndarray, np.ndarray]:
        """The trie of this shard, its contexts and their counts."""
        seen = np.flatnonzero(self.learnt)
        order = seen[np.lexsort((self.successor[seen], self.context[seen]))]
        c, s, n = self.context[order], self.successor[order], self.learnt[order]
        new_c = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
        heads = np.flatnonzero(new_c | np.concatenate(([True], s[1:] != s[:-1]))) if len(c) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, heads) if len(heads) else n
        c, s = c[heads], s[heads]
        starts = np.flatnonzero(new_c[heads]) if len(heads) else heads
        own = np.diff(np.append(starts, len(c)))
        # a shard knows every hot context, be it without a pair of it
        nodes = np.union1d(c[starts], counts.hot)
        types, size = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        at = np.searchsorted(nodes, c[starts])
        types[at] = own
        size[at] = np.add.reduceat(total, starts) if len(starts) else total
        hot = np.searchsorted(nodes, counts.hot)
        types[hot], size[hot] = counts.hot_types, counts.hot_count
        lam = types / np.maximum(1, types + size)
        node = np.repeat(at, own)
        p = (1 - lam[node]) * total / size[node] + lam[node] * 10 ** self.plain_log(s, counts)
        return Trie.build(c, s, np.log10(p), nodes, np.log10(lam)), nodes, size


_RETURNED = "block string, head boolean, data binary"


def _score(counts_shared):
    def run(table: pa.Table) -> pa.Table:
        counts = restore(Counts, counts_shared)
        heads = table.filter(table["head"]).select(["block", "head", "data"])
        shard = _Shard.of(table, counts)
        trie, nodes, size = shard.trie(counts)
        blocks, data = [], []
        for k, block in enumerate(shard.blocks):
            span = slice(shard.at[k], shard.at[k + 1])
            c, s, uses, row = shard.context[span], shard.successor[span], shard.uses[span], shard.rows[k]
            known, pair, log = trie.query(c, s)
            log = np.where(pair, log, log + shard.plain_log(s, counts))
            at = _place(nodes, c)
            n = np.where(at >= 0, size[np.maximum(at, 0)] if len(size) else 0, 0)
            # a context is a token of the text, unless it is the border in front
            token = c != int(np.uint64(BEGIN) & _CONTEXT)
            per = lambda x: np.bincount(row, np.repeat(x, uses))
            hits = np.flatnonzero(np.bincount(row))
            blocks.append(block)
            data.append(_zip(
                hits.astype(np.uint32), per((n > 0) & token)[hits].astype(np.uint32), per(np.where(token, np.log10(n + 1), 0.0))[hits], per(log)[hits].astype(np.float32),
            ))
        back = pa.table({"block": pa.array(blocks, pa.string()), "head": pa.array([False] * len(blocks), pa.bool_()), "data": pa.array(data, pa.binary())})
        return pa.concat_tables([heads.cast(back.schema), back])

    return run


def _gather(counts_shared, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        counts = restore(Counts, counts_shared)
        head = next(d for d, h in zip(table["data"], table["head"]) if h.as_py()).as_py()
        ids = pa.ipc.open_stream(head).read_all()
        n_tokens = ids["n_tokens"].to_numpy()
        known, base, score = (np.zeros(len(ids)) for _ in range(3))
        parts = [_unzip(d.as_py()) for d, h in zip(table["data"], table["head"]) if not h.as_py()]
        # sums of fractions depend on their order, and rows come in any: fix it
        for rows, k, b, s in sorted(parts, key=lambda p: (len(p[0]), p[2].tobytes())):
            known[rows] += k
            base[rows] += b
            score[rows] += s
        ends = counts.texts
        known += ends > 0
        base += np.log10(ends + 1) - n_tokens * np.log10(counts.tokens + counts.types + 1)
        return pa.table({
            "id": ids["id"].cast(id_type), "held_out": ids["held_out"], "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), counts.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def _exchange(docs: DataFrame, held_out, id_col: str, text_col: str, shard_tokens: int, top: int):
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = word_counts(source, shard_tokens, top)
    answers = count_words(source, counts).select("shard", F.lit(None).cast("string").alias("block"), F.lit(False).alias("head"), "data")
    shared = share(docs.sparkSession, counts)
    return source, shared, source.mapInArrow(_send(shared), _SENT).unionByName(answers)


def score_texts(docs: DataFrame, held_out=held_out_rows, id_col: str = "doc_id", text_col: str = "text",
                shard_tokens: int = SHARD_TOKENS, top: int = TOP) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. The model learns from all rows that
    are not `held_out`. Null and empty texts are an end alone; repeated rows count as often as they occur. base_score
    sums log10((c + 1) / (N + V + 1)) over the tokens. Without any training text every word is unknown.
    """
    source, shared, sent = _exchange(docs, held_out, id_col, text_col, shard_tokens, top)
    id_field = source.schema["id"].dataType.simpleString()
    returned = sent.groupBy("shard").applyInArrow(_score(shared), _RETURNED)
    out = returned.groupBy("block").applyInArrow(
        _gather(shared, to_arrow_type(source.schema["id"].dataType)),
        f"id {id_field}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", "doc_id")


def _levels(counts_shared):
    def run(table: pa.Table) -> pa.Table:
        counts = restore(Counts, counts_shared)
        trie, _, _ = _Shard.of(table, counts).trie(counts)
        return pa.table({"shard": table["shard"].combine_chunks()[:1]} | {k: pa.array([v], pa.binary()) for k, v in trie.levels().items()})

    return run


def build_tries(docs: DataFrame, held_out=held_out_rows, id_col: str = "doc_id", text_col: str = "text",
                shard_tokens: int = SHARD_TOKENS, top: int = TOP) -> DataFrame:
    """The model as a table: one row per shard with the buffers of its trie, for `Trie.view`."""
    _, shared, sent = _exchange(docs, held_out, id_col, text_col, shard_tokens, top)
    names = ("contexts", "pointers", "vocabulary", "successors", "codes", "book", "backoff_codes", "backoff_book")
    return sent.groupBy("shard").applyInArrow(_levels(shared), "shard int, " + ", ".join(f"{n} binary" for n in names))
