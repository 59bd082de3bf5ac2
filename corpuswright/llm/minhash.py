"""Near duplicates by min-max hashing: both extremes of every permutation make the signature, in bands.

A document's set holds the hashes of its distinct word shingles. Equal sets form one class, found by a 128-bit
fingerprint, so exact copies of any number are one node. Classes that share a band are candidates. Links are confirmed
on the full sets:

1. every bucket tests its members against one centre (linear in the bucket);
2. members that already belong to one component need no further test;
3. for the rest, a pair inside a bucket is tested unless it cannot be a link: the sizes, together with the number of
   shingles that only one candidate has, bound the similarity from above, and sketches of minima and maxima (two bits of
   the signature in step 1, one bit of 2 * `WIDE` values here) must agree within `SKETCH_SIGMAS` standard deviations.

Nothing is capped. The chance that a pair at the threshold shares no band is at most `MISS`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .texts import LOWER, Words, chain, mix, words

SHINGLE = 5
PERMUTATIONS = 76  # each gives two signature values
MISS = 1e-5
SKETCH_SIGMAS = 4.5
SIZE_STEP = 1.05  # ratio of neighbouring size bins
WIDE = 1024  # permutations of the longer sketch that candidates of step 3 get

_ROUND = 1 << 18  # shingles hashed at a time
_PLANE = -(-2 * PERMUTATIONS // 64)
_MAP_BYTES = 3  # of a fingerprint; the bit map of candidates has 2 ** 24 bits whatever the corpus


def band_rows(percent: int, values: int = 2 * PERMUTATIONS, miss: float = MISS) -> int:
    """The most rows a band may have for a pair at the threshold to be missed with probability `miss` at most."""
    s = percent / 100
    fit = [r for r in range(1, 13) if (1 - s**r) ** (values // r) <= miss]
    return max(fit, default=1)


def shingle_sets(piece: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle, of none an empty set."""
    whole, bounds = chain(piece.hashes, n), piece.bounds
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(chain(piece.hashes[a:b], b - a) if b > a else whole[:0])
    return out


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def signatures(sets: list[np.ndarray], count: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of each set under each permutation, one row per set; no set may be empty."""
    factors, shifts = _permutations(count)
    out = np.empty((len(sets), 2 * count), np.uint64)
    sizes = np.array([len(s) for s in sets])
    row = 0
    while row < len(sets):
        end, total = row, 0
        while end < len(sets) and (end == row or total + sizes[end] <= _ROUND):
            total += int(sizes[end])
            end += 1
        flat = np.concatenate(sets[row:end])
        at = np.concatenate(([0], np.cumsum(sizes[row : end - 1]))).astype(np.int64)
        value = np.empty_like(flat)
        for p in range(count):
            np.multiply(flat, factors[p], out=value)
            np.add(value, shifts[p], out=value)
            out[row:end, p] = np.minimum.reduceat(value, at)
            out[row:end, count + p] = np.maximum.reduceat(value, at)
        row = end
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each signature value in two planes of 64-bit words; the bits left over are 0 in all."""
    bits = np.zeros((len(sig), 64 * _PLANE), np.uint8)
    planes = []
    for k in (13, 29):
        bits[:, : sig.shape[1]] = (sig >> np.uint64(k)) & np.uint64(1)
        planes.append(np.packbits(bits, axis=1).view(">u8").astype(np.int64))
    return np.concatenate(planes, axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


_SIGNED = "digest long, fp binary, n_shingles long, bands array<long>, sketch array<long>"


def _sign(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for piece in words(batch.column(2), LOWER):
                sets = shingle_sets(piece)
                full = [s for s in sets if len(s)]
                sig = signatures(full) if full else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
                count = sig.shape[1] // rows
                keys = np.empty((len(sig), count), np.int64)
                for b in range(count):
                    key = np.full(len(sig), b + 1, np.uint64)
                    for k in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + k])
                    keys[:, b] = key.view(np.int64)
                at = np.cumsum([bool(len(s)) for s in sets]) - 1
                has = np.array([bool(len(s)) for s in sets])
                take = pa.array(np.where(has, at, 0), mask=~has)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(piece.first, piece.rows),
                        batch.column(1).slice(piece.first, piece.rows),
                        pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _lists(keys).take(take),
                        _lists(_sketch(sig)).take(take),
                    ],
                    names=["id", "digest", "fp", "n_shingles", "bands", "sketch"],
                )

    return run


def _expand(shared):
    """Sets of the texts whose fingerprint's first bytes are marked, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = shared.value, set()
        for batch in batches:
            for piece in words(batch.column(0), LOWER):
                names, sets = [], []
                for s in shingle_sets(piece):
                    name = _fingerprint(s) if len(s) else None
                    if name and name not in seen and marked[int.from_bytes(name[:_MAP_BYTES], "big")]:
                        seen.add(name)
                        names.append(name)
                        sets.append(s)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                    names=["fp", "shingles"],
                )

    return run


def _marks(fps: DataFrame) -> np.ndarray:
    """Which first bytes of a fingerprint occur: a map of fixed size, gathered in at most 2 ** 18 words."""
    place = F.conv(F.hex(F.substring("fp", 1, _MAP_BYTES)), 16, 10).cast("long")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = fps.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words_ = np.zeros(1 << (8 * _MAP_BYTES - 6), np.int64)
    for r in rows:
        words_[r["word"]] = r["bits"]
    return np.unpackbits(words_.view(np.uint8), bitorder="little").astype(bool)


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of each of 2 * WIDE extremes of given sets."""
    for batch in batches:
        lists = batch.column(1)
        flat, at = np.asarray(lists.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
        sig = signatures([flat[a:b] for a, b in zip(at[:-1], at[1:])], WIDE) if len(batch) else np.zeros((0, 2 * WIDE), np.uint64)
        bits = np.packbits(((sig >> np.uint64(17)) & np.uint64(1)).astype(np.uint8), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bits.view(">u8").astype(np.int64))], names=["c", "wide"])


def _floor(values: int, chance: float, percent: int) -> int:
    """How many of the sketched values agree at least, if unlike values agree by `chance`."""
    p = chance + (1 - chance) * percent / 100
    return math.floor(values * p - SKETCH_SIGMAS * math.sqrt(values * p * (1 - p)))


def _agrees(a: str, b: str, percent: int):
    apart = sum(
        F.bit_count(F.expr(f"({a}[{k}] ^ {b}[{k}]) | ({a}[{k + _PLANE}] ^ {b}[{k + _PLANE}])")) for k in range(_PLANE)
    )
    return F.lit(2 * PERMUTATIONS) - apart >= _floor(2 * PERMUTATIONS, 0.25, percent)


def _agrees_wide(a: str, b: str, percent: int):
    apart = sum(F.bit_count(F.expr(f"{a}[{k}] ^ {b}[{k}]")) for k in range(2 * WIDE // 64))
    return F.lit(2 * WIDE) - apart >= _floor(2 * WIDE, 0.5, percent)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a joins first, so that a common b moves last."""
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("sa").cast("long") + F.size("sb")).alias("sum"))
        .where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
        .select("a", "b")
    )


def _bin(size):
    return F.floor(F.log(size.cast("double")) / math.log(SIZE_STEP)).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, digest (of the text), component (its key).

    Linked are documents whose sets of 5-word shingles have 100 * |intersection| >= percent * |union|. component_id is the
    smallest id reachable over links, kept says whether the row's id is that id. A null, empty or blank text has no
    component key, is linked with nothing and is its own component. Equal rows share their result; a null id is
    the smallest of none but null ids, and its component_id is null only if all its component's ids are (kept then).
    """
    rows = band_rows(percent)
    t = percent / 100
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    signed = cut_lineage(source.mapInArrow(_sign(rows), f"id {id_type}, {_SIGNED}"), "minhash-signed")

    # a class gets a number when it is written; what follows moves numbers and not fingerprints
    classes = cut_lineage(
        signed.where("fp is not null")
        .groupBy("fp")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("c", F.monotonically_increasing_id()),
        "minhash-classes",
    )
    keyed = classes.select("c", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = cut_lineage(keyed.join(crowded, "key"), "minhash-members")
    # the centre of a bucket is the member with the most neighbours in all its buckets, such as the text that copies come from
    known = members.groupBy("c").agg(F.sum("crowd").alias("known"))
    slim = cut_lineage(classes.join(known, "c").select("c", "fp", "id", "n", "sketch", "known"), "minhash-candidates")
    centres = members.join(slim.select("c", "known"), "c").groupBy("key").agg(F.max_by("c", F.struct("known", -F.col("c"))).alias("centre"))
    members = cut_lineage(members.select("key", "c").join(centres, "key"), "minhash-centres")

    shared = docs.sparkSession.sparkContext.broadcast(_marks(slim))
    sets = source.select("text").mapInArrow(_expand(shared), "fp binary, shingles array<long>")
    sets = sets.groupBy("fp").agg(F.first("shingles").alias("shingles")).join(slim.select("fp", "c"), "fp").select("c", "shingles")
    sets = cut_lineage(sets, "minhash-sets")

    look = slim.select("c", "n", "sketch")
    star = (
        members.where("c <> centre").select(F.col("c").alias("a"), F.col("centre").alias("b")).distinct()
        .join(look.toDF("a", "na", "ska"), "a")
        .join(look.toDF("b", "nb", "skb"), "b")
        .where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & _agrees("ska", "skb", percent))
        .select("a", "b")
    )
    links = cut_lineage(_confirm(star, sets, percent), "minhash-star")
    roots = cut_lineage(components(links), "minhash-roots")

    rest = members.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    torn = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = cut_lineage(rest.join(torn, "key", "left_semi").where("c <> centre"), "minhash-rest")
    left = rest.select("c").distinct()
    alone = (
        sets.join(left, "c", "left_semi")
        .select("c", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("df"), F.min("c").alias("c"))
        .where("df = 1")
        .groupBy("c").agg(F.count("*").alias("own"))
    )
    wide = sets.join(left, "c", "left_semi").mapInArrow(_widen, "c long, wide array<long>")
    bounds = cut_lineage(
        slim.select("c", "n").join(wide, "c").join(alone, "c", "left")
        .select("c", "n", "wide", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m")),
        "minhash-bounds",
    )
    # b, of size s >= n, is similar to a, of size n with m shared shingles, only if s <= m * (1 + 1 / t) - n
    most = F.floor(F.col("m") * (1 + 1 / t) - F.col("n") + 1e-6)
    member = lambda x: [F.col("key"), F.col("c").alias(x), *(F.col(k).alias(k[0] + x) for k in ("root", "n", "m", "wide"))]
    askers = bounds.withColumn("most", most).where("most >= n")
    asks = rest.join(askers, "c").select(*member("a"), F.explode(F.sequence(_bin(F.col("n")), _bin(F.col("most")))).alias("bin"))
    gives = rest.join(bounds, "c").select(*member("b"), _bin(F.col("n")).alias("bin"))
    top = F.least("ma", "mb")
    pairs = (
        asks.join(gives, ["key", "bin"])
        .where(
            (F.col("ra") != F.col("rb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
            & (top * 100 >= (F.col("na") + F.col("nb") - top) * percent) & _agrees_wide("wa", "wb", percent)
        )
        .select("a", "b").distinct()
    )
    more = cut_lineage(_confirm(pairs, sets, percent), "minhash-more")
    # what is linked already counts as one node
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    joined = (
        more.join(a, "a", "left").join(b, "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    )
    outer = components(joined).toDF("root", "top")
    final = roots.toDF("c", "root").join(outer, "root", "full").select(F.coalesce("c", "root").alias("c"), F.coalesce("top", "root").alias("top")).distinct()
    label = classes.select("fp", "id", "c").join(final, "c", "left").select("fp", "id", F.coalesce("top", "c").alias("top"))
    least = label.groupBy("top").agg(F.min("id").alias("component_id"))
    label = label.join(least, "top").select("fp", "top", "component_id")
    return (
        signed.select("id", "digest", "n_shingles", "fp").join(label, "fp", "left")
        .withColumn("component_id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(
            F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
            "digest", F.col("top").alias("component"),
        )
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: of the smallest id (null last), then of the smallest text digest.

    All columns stay. Of repeated rows one stays. Rows without a word are linked with nothing and all stay.
    """
    near = near_duplicates(docs, percent, id_col, text_col).where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    rows = near.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("rows"))
    best = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "digest", "rows"), order).alias("b")).select("b.*")
    best = best.toDF("__cw_id", "__cw_digest", "__cw_rows")
    wordless = F.coalesce(~F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    chosen = docs.where(~wordless).join(
        best, docs[id_col].eqNullSafe(best["__cw_id"]) & (F.xxhash64(docs[text_col]) == best["__cw_digest"])
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = chosen.where("__cw_rows = 1").select(*columns)
    equal = Window.partitionBy("__cw_id", "__cw_digest").orderBy("__cw_rows")
    first = chosen.where("__cw_rows > 1").withColumn("__cw_nth", F.row_number().over(equal)).where("__cw_nth = 1").select(*columns)
    return one.unionByName(first).unionByName(docs.where(wordless))
