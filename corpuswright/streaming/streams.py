"""Structured Streaming forms: lazy sources, row-local preparation, packing with carried tails, mixing, logging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rand import uniform
from ..operators.mixing import draws_of_ranks, interleave, scheduled, shuffle_position
from ..operators.ordering import block_starts, with_key_block, with_key_position
from ..operators.packing import mono_ids
from ..operators.vocab import Encoder
from ..session import cut_lineage, work_dir
from ..sources.readers import TRANSLATION, _sides

MONO = "doc_id long, lang string, text string"


def stream_source(
    spark: SparkSession,
    kind: str,
    path: str,
    schema: str = MONO,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """An unbounded read: 'parallel' (training rows) and 'mono' translation structs, or 'web' text rows.

    Instruction data cannot be streamed.
    """
    if kind == "instructions":
        raise ValueError("instruction data cannot be streamed")
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if kind in ("parallel", "mono"):
        return reader.schema(TRANSLATION).json(path).select(*_sides(F.col("translation")))
    if kind == "web":
        return reader.format(fmt).schema(schema).load(path)
    raise ValueError(f"unknown kind of source: {kind}")


def run_to_table(stream: DataFrame, label: str) -> str:
    """Drain what is available into a Parquet table in the shared folder; returns its path."""
    out = work_dir(_session(stream), label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{out}/data"


def _session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Drain by micro-batches; `each(batch, id, out)` must overwrite its own folder, so a retry is harmless."""
    out = work_dir(_session(stream), label)
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, i: each(batch, i, f"{out}/data"))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{out}/data"


def stream_prepare(stream: DataFrame, vocab: Encoder, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """Row-local preparation, the same expressions as for a finite table."""
    return stream.withColumn("input_ids", mono_ids(vocab, F.col(text), max_tokens)).drop(text)


def stream_pack(
    stream: DataFrame, ids: str, order: str, block: int, by: tuple[str, ...] = (), *, shards: int, last: str | None = None
) -> DataFrame:
    """Full blocks from an unbounded source; what is left of a batch starts the next one.

    Rows are packed per (source, shard), shard being a hash of the row key, so a hot source is spread over `shards`
    groups: as many as tasks should share a source. Rows of a shard are packed in order of arrival, and in `order` inside
    a micro-batch; if files arrive in key order, blocks do not depend on how the stream is cut. State is the tail of a
    shard, fewer ids than a block.

    `last` names a boolean column that marks the end of a source. A marked row has no ids of its own; it reaches all
    shards, which then write their tails as shorter blocks and start anew. Without it the tails, less than a block per
    shard, stay in the state.
    """
    keys = [*by, "shard"]
    names = [*by, "shard", "block_no", "input_ids"]
    own = F.array(F.floor(uniform(0, F.col(order)) * shards).cast("int"))
    end = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    rows = stream.withColumn("__end", end).withColumn("shard", F.explode(F.when(F.col("__end"), every).otherwise(own)))
    rows = rows.select(*keys, order, ids, "__end")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", block_no long, input_ids array<int>"

    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, done = (np.zeros(0, np.int32), 0) if not state.exists else (np.asarray(state.get[0], np.int32), state.get[1])
        # a key's rows of one micro-batch may come in several frames: the order holds over all of them
        rows_ = pd.concat(list(frames), ignore_index=True).sort_values(["__end", order], kind="stable")
        ended = bool(rows_["__end"].any())
        parts = [np.asarray(x, np.int32) for x in rows_.loc[~rows_["__end"], ids] if x is not None]
        stretch = np.concatenate([tail, *parts])
        full = len(stretch) // block
        blocks = [stretch[i * block : (i + 1) * block] for i in range(full)]
        tail = stretch[full * block :]
        if ended and len(tail):
            blocks.append(tail)
        if ended:
            tail = tail[:0]
        state.update((tail.tolist(), done + len(blocks)))
        if blocks:
            out = pd.DataFrame({"block_no": range(done, done + len(blocks)), "input_ids": blocks})
            for name, value in zip(keys, key):
                out[name] = value
            yield out[names]

    return rows.groupBy(*keys).applyInPandasWithState(
        pack, out_schema, "tail array<int>, done long", "append", GroupStateTimeout.NoTimeout
    )


def stream_shuffle(stream: DataFrame, key: str, seed: int, label: str = "shuffle") -> str:
    """Seeded permutation inside each micro-batch: rows with (batch_id, pos)."""

    def each(batch: DataFrame, i: int, out: str) -> None:
        shuffle_position(batch, seed, key).write.mode("overwrite").parquet(f"{out}/batch_id={i}")

    return run_batches(stream, label, each)


def stream_shuffle_buffer(
    stream: DataFrame, key: str, columns: list[str], seed: int, buffer: int, *, shards: int, last: str
) -> DataFrame:
    """A shuffle that looks ahead `buffer` rows per shard, over all micro-batches: (shard, place, key, columns).

    Rows go to a shard by a hash of their key; as many shards as tasks should share the stream. A shard first fills its
    buffer. Then each arriving row draws a slot, sends on the row that stands there and takes its place, so rows of different
    micro-batches meet. A row whose boolean column `last` is true reaches all shards and carries nothing: they send on what they
    hold in an order drawn anew, and start again. Rows arrive by micro-batch and, inside one, by key. State is the buffer.
    """
    kept = [key, *columns]
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    own = F.array(F.floor(uniform(seed, F.lit("shard"), F.col(key)) * shards).cast("int"))
    end = F.coalesce(F.col(last), F.lit(False))
    rows = stream.withColumn("__end", end).withColumn("shard", F.explode(F.when(end, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)))
    slot = F.floor(uniform(seed, F.lit("slot"), F.col(key)) * buffer).cast("int")
    rows = rows.select("shard", *kept, "__end", slot.alias("__slot"), uniform(seed, F.lit("end"), F.col(key)).alias("__turn"))
    held = [f"{c} array<{types[c]}>" for c in kept]

    def step(shard: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = 0
        standing: list[tuple] = []
        if state.exists:
            sent, turns, *cells = state.get
            standing = list(zip(*cells, turns))
        arrived = pd.concat(list(frames), ignore_index=True).sort_values(["__end", key], kind="stable")
        out: list[tuple] = []
        for *row, at, turn in arrived.loc[~arrived["__end"], [*kept, "__slot", "__turn"]].itertuples(index=False, name=None):
            if len(standing) < buffer:
                standing.append((*row, turn))
            else:
                out.append(standing[at][:-1])
                standing[at] = (*row, turn)
        if arrived["__end"].any():
            out += [r[:-1] for r in sorted(standing, key=lambda r: (r[-1], r[0]))]
            standing = []
        cells = [list(c) for c in zip(*standing)] if standing else [[] for _ in range(len(kept) + 1)]
        state.update((sent + len(out), cells[-1], *cells[:-1]))
        if out:
            frame = pd.DataFrame(out, columns=kept)
            frame.insert(0, "shard", shard[0])
            frame.insert(1, "place", range(sent, sent + len(out)))
            yield frame

    out_schema = ", ".join(["shard int", "place long", *[f"{c} {types[c]}" for c in kept]])
    return rows.groupBy("shard").applyInPandasWithState(
        step, out_schema, ", ".join(["sent long", "turns array<double>", *held]), "append", GroupStateTimeout.NoTimeout
    )


def _cursor(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """What the micro-batch before this one left; nothing before the first."""
    return spark.read.schema(schema).parquet(f"{folder}/batch_id={batch - 1}") if batch else spark.createDataFrame([], schema)


def stream_interleave(
    stream: DataFrame, key: str, names: list[str], probs: list[float], seed: int, source: str, last: str, label: str = "interleave"
) -> str:
    """`interleave` over a whole stream, drawn on as rows arrive: rows with their `draw`; returns the folder.

    Draws go on from where the micro-batch before stopped, up to the first that needs a row which has not arrived. A
    source ends with a row of it whose boolean column `last` is true; from then on it starts over when its rows are used up, and
    with the draw that finishes the last source the mixture ends, exactly as that of a finite table. Rows of a source are read in
    order of arrival, inside a micro-batch by key. Arrived rows are kept, as sources start over; all that is carried between
    micro-batches is the next draw and, per source, rows arrived, rows drawn, and whether it ended. A repeated micro-batch reads the
    same cursor and overwrites its own folders.
    """
    spark = _session(stream)
    columns = [c for c in stream.columns if c != last]
    names, probs = zip(*[(n, p) for n, p in zip(names, probs)])
    schema = "source string, arrived long, drawn long, ended boolean, next long"

    def each(batch: DataFrame, i: int, out: str) -> None:
        kept, cursors = f"{out}-rows", f"{out}-cursor"
        before = {r["source"]: r for r in _cursor(spark, cursors, i, schema).collect()}  # one row per source
        arrived = {s: before[s]["arrived"] if s in before else 0 for s in names}
        drawn = {s: before[s]["drawn"] if s in before else 0 for s in names}
        first = next((r["next"] for r in before.values()), 0)
        batch.filter(F.col(source).isin(*names)).write.mode("overwrite").parquet(f"{out}-staged/batch_id={i}")
        staged = spark.read.schema(batch.schema).parquet(f"{out}-staged/batch_id={i}")
        mark = F.coalesce(F.col(last), F.lit(False))
        counts = {r[source]: r for r in staged.groupBy(source).agg(F.count_if(~mark).alias("n"), F.max(mark).alias("end")).collect()}
        ahead = F.coalesce(*[F.when(F.col(source) == s, F.lit(n).cast("long")) for s, n in arrived.items()])
        rows = with_key_position(staged.filter(~mark), key, (source,), "row").withColumn("row", F.col("row") + ahead)
        rows.select("row", *columns).write.mode("overwrite").parquet(f"{kept}/batch_id={i}")
        ended = {s: (s in before and before[s]["ended"]) or (s in counts and counts[s]["end"]) for s in names}
        for s in names:
            arrived[s] += counts[s]["n"] if s in counts else 0
        empty = [s for s in names if ended[s] and not arrived[s]]
        if empty:
            raise ValueError(f"sources without rows: {empty}")
        if all(ended.values()):
            unread = {s: arrived[s] - 1 - drawn[s] for s in names if arrived[s] > drawn[s]}
            stop = max(draws_of_ranks(spark, unread, names, probs, seed, first, every=True).values()) + 1 if unread else first
        else:
            wanting = {s: arrived[s] - drawn[s] for s in names if not ended[s]}
            stop = min(draws_of_ranks(spark, wanting, names, probs, seed, first).values())
        table = spark.read.schema(f"row long, {_ddl(staged, columns)}, batch_id long").parquet(kept).filter(F.col("batch_id") <= i).drop("batch_id")
        placed = scheduled(spark, first, stop, drawn, arrived, ended, names, probs, seed).withColumnRenamed("source", source)
        placed.join(table, [source, "row"]).select("draw", *columns).write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        used = {r[source]: r["n"] for r in placed.groupBy(source).agg(F.count("*").alias("n")).collect()}
        state = [(s, arrived[s], drawn[s] + used.get(s, 0), bool(ended[s]), stop) for s in names]
        spark.createDataFrame(state, schema).coalesce(1).write.mode("overwrite").parquet(f"{cursors}/batch_id={i}")

    return run_batches(stream, label, each)


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def stream_mix(
    stream: DataFrame, key: str, names: list[str], probs: list[float], seed: int, source: str, label: str = "mix"
) -> str:
    """Each micro-batch mixed by itself, which is another operator than `interleave` over the whole stream.

    A micro-batch is read until each of its own sources is exhausted; sources it lacks take no part, so shares hold
    only over batches that have all sources. Use it for streams whose batches are cut to hold all of them.
    """

    def each(batch: DataFrame, i: int, out: str) -> None:
        # read the batch from disk for its several passes
        staged = f"{out}-staged/batch_id={i}"
        batch.write.mode("overwrite").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        present = {r[0] for r in rows.filter(F.col(source).isin(names)).groupBy(source).count().collect()}
        kept = [(n, p) for n, p in zip(names, probs) if n in present]
        if kept:
            mixed = interleave(rows, key, [n for n, _ in kept], [p for _, p in kept], seed, source)
            mixed.write.mode("overwrite").parquet(f"{out}/batch_id={i}")

    return run_batches(stream, label, each)


def stream_metric_log(
    stream: DataFrame, key: str, phase: str, metric: str, value: str, is_log: str, label: str = "metric-log"
) -> str:
    """Means of the metrics of a phase since its last log record: (phase, log_no, metric, mean, records), written when a log closes them.

    A log record of a phase closes what its rows gathered, in order of arrival and inside a micro-batch by key, and resets it; it
    has no metric of its own. A row's log is the number of log records in front of it, a running sum over blocks of keys, so that
    a phase with all rows is spread over its blocks; sums are made per task before they meet. Between micro-batches the open sums
    of each phase and metric and the number of logs so far are carried, by batch id, so that a repeated micro-batch changes nothing.
    """
    spark = _session(stream)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{phase} {types[phase]}, log_no long, {metric} {types[metric]}, total double, records long"
    same = [phase, "log_no", metric]

    def each(batch: DataFrame, i: int, out: str) -> None:
        staged = f"{out}-staged/batch_id={i}"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        carried = _cursor(spark, f"{out}-open", i, schema)
        # a row without metric holds the number of logs of its phase so far
        logs = carried.filter(F.col(metric).isNull()).select(F.col(phase).alias("__phase"), F.col("log_no").alias("__past"))
        mark = F.coalesce(F.col(is_log), F.lit(False)).cast("long")
        keyed = with_key_block(rows.withColumn("__mark", mark), key, (phase,))
        keyed = keyed.withColumn("__at", F.struct(phase, F.struct("__blk").alias("__blk")))
        starts = block_starts(keyed, [phase], F.col("__mark"), "__ahead").drop("__sum")
        inside = F.sum("__mark").over(W.partitionBy("__at").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
        keyed = keyed.withColumn("__in", F.coalesce(inside, F.lit(0))).join(starts, "__at")
        keyed = keyed.join(logs, F.col(phase).eqNullSafe(F.col("__phase")), "left")
        numbered = keyed.withColumn("log_no", F.coalesce("__past", F.lit(0)) + F.col("__ahead") + F.col("__in"))
        fresh = numbered.filter("__mark = 0").filter(F.col(metric).isNotNull()).groupBy(*same).agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("records"))
        closed = numbered.filter("__mark = 1").groupBy(phase).agg((F.max("log_no") + 1).alias("log_no"))
        past = logs.select(F.col("__phase").alias(phase), F.col("__past").alias("log_no"))
        counted = closed.unionByName(past).groupBy(phase).agg(F.max("log_no").alias("log_no"))
        open_ = carried.filter(F.col(metric).isNotNull()).unionByName(fresh).groupBy(*same).agg(F.sum("total").alias("total"), F.sum("records").alias("records"))
        open_ = cut_lineage(open_, "log-sums")
        counted = cut_lineage(counted, "log-counts")
        done = open_.join(counted.select(F.col(phase).alias("__phase"), F.col("log_no").alias("__logs")), F.col(phase).eqNullSafe(F.col("__phase")), "left")
        finished = F.col("log_no") < F.coalesce("__logs", F.lit(0))
        means = done.filter(finished).select(*same, (F.col("total") / F.col("records")).alias("mean"), "records")
        means.write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        left = done.filter(~finished).select(*same, "total", "records")
        none = F.lit(None)
        heads = counted.select(phase, "log_no", none.cast(types[metric]).alias(metric), none.cast("double").alias("total"), none.cast("long").alias("records"))
        left.unionByName(heads).write.mode("overwrite").parquet(f"{out}-open/batch_id={i}")

    return run_batches(stream, label, each)


def stream_log(stream: DataFrame, by: list[str], value: Column, label: str = "log") -> str:
    """Running means per log window and metric; every batch writes the windows it changed."""
    means = stream.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("records"))

    def each(batch: DataFrame, i: int, out: str) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}")

    return run_batches(means, label, each, "update")


def latest_log(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The last written state of every window."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("mean", "records"), "batch_id").alias("last")
    return rows.groupBy(*by).agg(last).select(*by, "last.*")
