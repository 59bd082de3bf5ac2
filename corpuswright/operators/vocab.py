"""Corpus vocabulary: built by aggregation, applied inside a projection.

The vocabulary is bounded by its `size` parameter, so it may live on the driver. It is shipped as one
literal: a table of hash buckets. Looking a word up is `bucket[xxhash64(word) mod n]` plus a comparison
inside a bucket of about one entry, all JVM-side; encoding therefore needs no token-level explode, no join and
no shuffle, and one row may be encoded several times (prompt, prompt + answer) in one pass.

An `Encoder` is what the plans take: `Vocabulary` (the literal), `shared_vocabulary` (a dictionary sent once to every
executor, for vocabularies too long for a plan), or `TokenizerEncoder` (any tokenizer, as an Arrow function). They
give the same ids for the same words. Both tables of words are refused beyond a stated length, before they reach the
driver whole; `encode_by_join` serves a vocabulary that no executor can hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE, int_lit, truncate
from ..functions.bytewords import pieces
from ..functions.text import py_strip, words
from ..session import local_table


#: words that a plan, and a dictionary on every executor, may hold
LITERAL_WORDS, SHARED_WORDS = 1_000_000, 10_000_000
#: bytes of texts whose words are counted at a time
COUNTED_BYTES = 1 << 23
_TO_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")


def _bounded(vocab: DataFrame, most: int, instead: str) -> list[Row]:
    """The rows of a vocabulary table of at most `most` words; no more than one row beyond that comes to the driver."""
    rows = vocab.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} words: use {instead}")
    return rows


@dataclass(frozen=True)
class Specials:
    """Ids of the special tokens; word ids follow them."""

    pad: int = 0
    bos: int = 1
    eos: int = 2
    unk: int = 3

    @property
    def first_word(self) -> int:
        return max(self.pad, self.bos, self.eos, self.unk) + 1

    def ids(self) -> list[int]:
        return sorted({self.pad, self.bos, self.eos, self.unk})


def build_vocab(df: DataFrame, col: str, size: int, specials: Specials = Specials()) -> DataFrame:
    """The `size` most frequent words: (token, n, id), ties by token.

    Words are counted in Arrow batches, a piece of the texts at a time, and once more on the map side; the ranking window sees the
    bounded top-k only.
    """
    counts = df.select(F.col(col).cast("string")).mapInArrow(_word_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    return top.select("token", "n", (rank + F.lit(specials.first_word - 1)).cast("int").alias("id"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the words of `functions.text.words` in each piece of a text column."""
    for batch in batches:
        for _, raw, offsets in pieces(batch.column(0), COUNTED_BYTES):
            blank = pa.py_buffer(raw.tobytes().translate(_TO_BLANKS))
            texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), blank)
            token, n = pc.list_flatten(pc.split_pattern(texts, " ")).value_counts().flatten()
            word = pc.not_equal(token, "")
            yield pa.RecordBatch.from_arrays([token.filter(word).cast(pa.string()), n.filter(word)], ["token", "n"])


class Encoder(Protocol):
    """Turns a text column into ids inside a projection."""

    specials: Specials

    def __len__(self) -> int: ...

    def encode(self, text: Column, max_len: int | Column | None = None, bos: bool = False, eos: bool = False) -> Column: ...


def _framed(ids: Column, specials: Specials, max_len: int | Column | None, bos: bool, eos: bool) -> Column:
    """Optional BOS, cut to `max_len` (which counts the BOS but not the EOS), optional EOS."""
    if bos:
        ids = F.concat(F.array(int_lit(specials.bos)), ids)
    if max_len is not None:
        ids = truncate(ids, max_len)
    if eos:
        ids = F.concat(ids, F.array(int_lit(specials.eos)))
    return ids


@dataclass
class Vocabulary:
    """A vocabulary held on the driver, usable in column expressions."""

    tokens: list[str]
    specials: Specials = field(default_factory=Specials)
    buckets: list[list[tuple[str, int]]] = field(default_factory=list, repr=False)

    def __len__(self) -> int:
        """Number of ids, special ones included."""
        return self.specials.first_word + len(self.tokens)

    @classmethod
    def from_table(cls, vocab: DataFrame, specials: Specials = Specials(), most: int = LITERAL_WORDS) -> Vocabulary:
        """Collect a vocabulary table of at most `most` words together with Spark's own hash of each word."""
        rows = _bounded(vocab.select("token", "id", F.xxhash64("token").alias("hash")), most, "shared_vocabulary")
        buckets: list[list[tuple[str, int]]] = [[] for _ in range(max(len(rows), 1))]
        for r in rows:
            buckets[r.hash % len(buckets)].append((r.token, r.id))
        ordered = [r.token for r in sorted(rows, key=lambda r: r.id)]
        return cls(ordered, specials, buckets)

    def _bucket_table(self) -> Column:
        table = [[{"t": t, "i": i} for t, i in b] for b in self.buckets]
        return F.from_json(
            F.lit(json.dumps(table, ensure_ascii=False)), "array<array<struct<t:string,i:int>>>"
        )

    def encode(
        self, text: Column, max_len: int | Column | None = None, bos: bool = False, eos: bool = False
    ) -> Column:
        """Text → ids, with optional BOS and EOS; `max_len` counts the BOS but not the EOS."""
        table, n, unk = self._bucket_table(), len(self.buckets), int_lit(self.specials.unk)

        def lookup(word: Column) -> Column:
            # the table is one literal after constant folding
            bucket = F.get(table, F.pmod(F.xxhash64(word), F.lit(n)).cast("int"))
            return F.coalesce(F.get(F.filter(bucket, lambda e: e["t"] == word), F.lit(0))["i"], unk)

        found = words(text)
        if max_len is not None:
            # words beyond the limit are not looked up
            found = truncate(found, max_len)
        return _framed(F.transform(found, lookup), self.specials, max_len, bos, eos)

    def decode(self, ids: Column) -> Column:
        """Ids → text: ignored labels count as padding, special ids are dropped, ends are stripped."""
        first = self.specials.first_word
        names = F.split(F.lit("\n".join(self.tokens)), "\n")
        plain = F.transform(
            ids, lambda i: F.when(i == int_lit(IGNORE), int_lit(self.specials.pad)).otherwise(i)
        )
        kept = F.filter(plain, lambda i: i >= first)
        return py_strip(F.array_join(F.transform(kept, lambda i: F.get(names, i - first)), " "))


def load_vocabulary(
    df: DataFrame, col: str, size: int, specials: Specials = Specials()
) -> Vocabulary:
    return Vocabulary.from_table(build_vocab(df, col, size, specials), specials)


def encode_by_join(
    df: DataFrame, key: str, text: str, vocab: DataFrame, specials: Specials = Specials(), out: str = "ids"
) -> DataFrame:
    """The same encoding for a vocabulary of any size: the distinct words of a row meet the vocabulary, what is found comes back to the row.

    A frequent word costs one lookup per row; its places never move, and neither do words that the vocabulary lacks. `key` is unique.
    """
    types = df.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("token"))
    found = types.join(vocab.select("token", "id"), "token")
    per_row = found.groupBy(key).agg(F.collect_list("token").alias("__tokens"), F.collect_list("id").alias("__found"))
    unk = specials.unk

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array, tokens: pa.Array, ids: pa.Array) -> pa.Array:
        blanks, out = re.compile("[ \\n\\t\\r]+"), []
        for text, own, numbers in zip(texts, tokens, ids):
            known = dict(zip(own.as_py() or (), numbers.as_py() or ()))
            out.append([known.get(w, unk) for w in blanks.split(text.as_py() or "") if w])
        return pa.array(out, pa.list_(pa.int32()))

    rows = df.join(per_row, key, "left")
    return rows.withColumn(out, encoded(F.col(text), "__tokens", "__found")).drop("__tokens", "__found")


def encode_with(make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """An external tokenizer as an Arrow function.

    `make_tokenizer` runs once per Python worker and returns a batch function texts → id lists.
    """
    state: dict[str, Callable] = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if "tokenizer" not in state:
            state["tokenizer"] = make_tokenizer()
        return pd.Series(state["tokenizer"](texts.tolist()), index=texts.index)

    return encode


def vocabulary_of(spark: SparkSession, tokens: list[str], specials: Specials = Specials()) -> Vocabulary:
    """A vocabulary from a given word list, ids in list order."""
    rows = [(t, 0, specials.first_word + i) for i, t in enumerate(tokens)]
    return Vocabulary.from_table(local_table(spark, rows, "token string, n long, id int"), specials)


@dataclass
class TokenizerEncoder:
    """An `Encoder` around any tokenizer; `size` is its number of ids, special ones included.

    `make_tokenizer` runs once per Python worker and gives ids without special ones; NULL texts reach it as empty ones.
    """

    make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]
    size: int
    specials: Specials = field(default_factory=Specials)

    def __len__(self) -> int:
        return self.size

    def encode(self, text: Column, max_len: int | Column | None = None, bos: bool = False, eos: bool = False) -> Column:
        ids = F.when(text.isNotNull(), encode_with(self.make_tokenizer)(F.coalesce(text, F.lit(""))))
        return _framed(ids, self.specials, max_len, bos, eos)


def shared_vocabulary(vocab: DataFrame, specials: Specials = Specials(), most: int = SHARED_WORDS) -> TokenizerEncoder:
    """A vocabulary table (token, id) of at most `most` words as an `Encoder` that looks words up in a dictionary on every
    executor. The dictionary is sent once per executor and not once per plan.
    """
    table = {r["token"]: r["id"] for r in _bounded(vocab.select("token", "id"), most, "encode_by_join")}
    shared = vocab.sparkSession.sparkContext.broadcast(table)
    unk = specials.unk

    def make() -> Callable[[list[str]], list[list[int]]]:
        ids, blanks = shared.value, re.compile("[ \\n\\t\\r]+")
        return lambda texts: [[ids.get(w, unk) for w in blanks.split(t) if w] for t in texts]

    return TokenizerEncoder(make, specials.first_word + len(table), specials)
