"""Streaming forms over the given tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_dir
from ..sources.files import path_exists
from ..streaming import streams as W
from . import fixtures as X
from .fixtures import arr, encoded_ctes, joined, uniform_sql, with_ctes
from .mixing import LANGS, PROBS, interleave_ctes
from .registry import query

S = X.SPECIALS


def documents(spark, sf):
    # a pattern finds the table both as one file and as a folder of files, where a filter on names sees the files' own
    rows = W.stream_source(spark, "web", f"{sf}/documents.[p]arquet")
    # one file is one task: spread its rows
    return rows.repartition("doc_id")


@query("SELECT doc_id, lang, text FROM documents")
def stream_source(spark, sf):
    return spark.read.parquet(W.run_to_table(documents(spark, sf), "stream-source"))


@query(with_ctes("vocab", f"""
SELECT d.doc_id, d.lang, {arr(f'list_concat(list_concat([{S.bos}], e.ids), [{S.eos}])')} AS input_ids
FROM documents d JOIN enc e ON e.doc_id = d.doc_id""", encoded_ctes("enc", "documents", "doc_id", X.strip_sql("text"))))
def stream_prepare(spark, sf):
    prepared = W.stream_prepare(documents(spark, sf), X.vocabulary(spark, sf))
    rows = spark.read.parquet(W.run_to_table(prepared, "stream-prepare"))
    return rows.select("doc_id", "lang", joined("input_ids").alias("input_ids"))


# Files of a micro-batch: its rows are cut by key over as many tasks.
FILES = 4
# Bytes of text that a micro-batch should hold, and the least number of micro-batches: their state function sees a batch at once.
BATCH_BYTES, PARTS = 128 << 20, 3


def arrive(spark, rows, key, path):
    """Rows as files that arrive in key order, `FILES` for each micro-batch; there are more micro-batches of more rows, no larger ones."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in rows.schema if f.dataType.simpleString() == "string"]
    size = rows.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0
    parts, stage = max(PARTS, -(-size // BATCH_BYTES)), work_dir(spark, "arrivals")
    rows.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(stage)
    for i in range(parts):
        if path_exists(spark, f"{stage}/__part={i}"):
            spark.read.schema(rows.schema).parquet(f"{stage}/__part={i}").repartitionByRange(FILES, key).write.mode("append").parquet(path)


def in_batches(spark, sf, table, key, schema):
    """The table as a file stream of micro-batches in key order."""
    path = work_dir(spark, f"stream-{table}")
    arrive(spark, spark.read.parquet(f"{sf}/{table}.parquet"), key, path)
    return W.stream_source(spark, "web", path, schema, files_per_trigger=FILES)


STREAM_PACK = {
    **encoded_ctes("enc", "documents", "doc_id", X.strip_sql("text")),
    "items": f"""SELECT d.lang, floor(('0x'||substr(md5('0:'||d.doc_id),1,8))::BIGINT/4294967296.0::DOUBLE * 4)::INT AS shard, d.doc_id,
        list_concat(list_concat([{S.bos}], e.ids), [{S.eos}]) AS ids FROM enc e JOIN documents d ON d.doc_id = e.doc_id""",
    "toks": "SELECT lang, shard, doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS ix FROM items",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY lang, shard ORDER BY doc_id, ix) - 1 AS p FROM toks",
}
PACKED = """SELECT lang, shard, p // 512 AS block_no, array_to_string(list(id ORDER BY p), ',') AS input_ids FROM numbered GROUP BY ALL"""


@query(with_ctes("vocab", PACKED + " HAVING count(*) = 512", STREAM_PACK))
def stream_pack(spark, sf):
    """Micro-batches of bounded size, three at least; tails wait in the state."""
    prepared = W.stream_prepare(in_batches(spark, sf, "documents", "doc_id", W.MONO), X.vocabulary(spark, sf))
    blocks = W.stream_pack(prepared, "input_ids", "doc_id", 512, ("lang",), shards=4)
    rows = spark.read.parquet(W.run_to_table(blocks, "stream-pack"))
    return rows.select("lang", "shard", "block_no", joined("input_ids").alias("input_ids"))


@query(with_ctes("vocab", PACKED, STREAM_PACK))
def stream_pack_flush(spark, sf):
    """The end of every language is marked, so that the tails are written too."""
    path = work_dir(spark, "stream-ends")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text", F.lit(False).alias("last"))
    arrive(spark, docs, "doc_id", path)
    ends = docs.groupBy("lang").agg(F.max("doc_id").alias("doc_id")).select("doc_id", "lang", F.lit("").alias("text"), F.lit(True).alias("last"))
    ends.coalesce(1).write.mode("append").parquet(path)
    stream = W.stream_source(spark, "web", path, f"{W.MONO}, last boolean", files_per_trigger=FILES)
    prepared = W.stream_prepare(stream, X.vocabulary(spark, sf))
    blocks = W.stream_pack(prepared, "input_ids", "doc_id", 512, ("lang",), shards=4, last="last")
    rows = spark.read.parquet(W.run_to_table(blocks, "stream-pack"))
    return rows.select("lang", "shard", "block_no", joined("input_ids").alias("input_ids"))


@query(f"""SELECT 0 AS batch_id, doc_id, lang, text, row_number() OVER (ORDER BY {uniform_sql('doc_id')}, doc_id) - 1 AS pos FROM documents""")
def stream_shuffle(spark, sf):
    return spark.read.parquet(W.stream_shuffle(documents(spark, sf), "doc_id", X.SEED))


@query(with_ctes("", "SELECT 0 AS batch_id, m.draw, m.source AS lang, m.doc_id, d.text FROM mix m JOIN documents d ON d.doc_id = m.doc_id",
    interleave_ctes("mix", "documents", "lang", "doc_id", LANGS, PROBS)))
def stream_mix(spark, sf):
    path = W.stream_mix(documents(spark, sf), "doc_id", LANGS, PROBS, X.SEED, "lang")
    return spark.read.parquet(path).select("batch_id", "draw", "lang", "doc_id", "text")


def uneven(spark, sf, cuts=(0.1, 0.15, 0.7)):
    """The documents as micro-batches of uneven size, with a last one that holds a marked row per language."""
    path = work_dir(spark, "stream-uneven")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text", F.lit(False).alias("last"))
    high = docs.agg(F.max("doc_id")).first()[0] + 1
    for low, top in zip((0.0, *cuts), (*cuts, 1.0)):
        part = docs.filter((F.col("doc_id") >= int(low * high)) & (F.col("doc_id") < int(top * high)))
        part.repartitionByRange(FILES, "doc_id").write.mode("append").parquet(path)
    ends = docs.groupBy("lang").agg(F.max("doc_id").alias("doc_id")).select("doc_id", "lang", F.lit("").alias("text"), F.lit(True).alias("last"))
    ends.coalesce(1).write.mode("append").parquet(path)  # one row per language
    return W.stream_source(spark, "web", path, f"{W.MONO}, last boolean", files_per_trigger=FILES)


SHARDS, BUFFER = 3, 32
_DRAW = f"('0x'||substr(md5({X.SEED}||':{{}}:'||doc_id),1,8))::BIGINT/4294967296.0::DOUBLE"


@query(f"""
WITH a AS (SELECT doc_id, lang, text, floor({_DRAW.format('shard')} * {SHARDS})::INT AS shard, {_DRAW.format('end')} AS turn, floor({_DRAW.format('slot')} * {BUFFER})::INT AS drawn FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS t, count(*) OVER (PARTITION BY shard) AS n FROM a),
s AS (SELECT *, lead(t) OVER (PARTITION BY shard, CASE WHEN t < {BUFFER} THEN t ELSE drawn END ORDER BY t) AS taken FROM t)
SELECT shard, doc_id, lang, text, CASE WHEN taken IS NOT NULL THEN taken - {BUFFER}
    ELSE greatest(n - {BUFFER}, 0) + row_number() OVER (PARTITION BY shard, taken IS NULL ORDER BY turn, doc_id) - 1 END AS place FROM s""")
def stream_shuffle_buffer(spark, sf):
    """A buffer in the state, over uneven micro-batches: a row leaves when a later one draws its slot, the rest at the end."""
    shuffled = W.stream_shuffle_buffer(uneven(spark, sf), "doc_id", ["lang", "text"], X.SEED, BUFFER, shards=SHARDS, last="last")
    return spark.read.parquet(W.run_to_table(shuffled, "stream-shuffle"))


@query(with_ctes("", "SELECT m.draw, m.source AS lang, m.doc_id, d.text FROM mix m JOIN documents d ON d.doc_id = m.doc_id",
    interleave_ctes("mix", "documents", "lang", "doc_id", LANGS, PROBS)))
def stream_interleave(spark, sf):
    """The mixture of the whole stream, over uneven micro-batches: the rows of the finite mixture."""
    path = W.stream_interleave(uneven(spark, sf), "doc_id", LANGS, PROBS, X.SEED, "lang", "last")
    return spark.read.parquet(path).select("draw", "lang", "doc_id", "text")


@query("""
WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, event_id, event_type, value FROM events),
n AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY phase ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS log_no,
    sum((event_type = 'error')::INT) OVER (PARTITION BY phase)::BIGINT AS logs FROM e)
SELECT phase, log_no, event_type AS metric, avg(value)::FLOAT AS mean, count(value) AS records FROM n WHERE event_type <> 'error' AND log_no < logs GROUP BY ALL""")
def stream_metric_log(spark, sf):
    """Means since the last log of a phase; an error event stands for its log record."""
    events = in_batches(spark, sf, "events", "event_id", "event_id long, user_id long, event_type string, value double").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "train").otherwise("eval").alias("phase"), F.col("event_type").alias("metric"), "value",
        (F.col("event_type") == "error").alias("logged"),
    )
    rows = spark.read.parquet(W.stream_metric_log(events, "event_id", "phase", "metric", "value", "logged"))
    return rows.select("phase", "log_no", "metric", F.col("mean").cast("float").alias("mean"), "records")


@query("""
SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, event_id // 1000 AS log_window, event_type AS metric,
       avg(value)::FLOAT AS mean, count(*) AS records FROM events GROUP BY ALL""")
def stream_log(spark, sf):
    schema = "event_id long, user_id long, event_type string, value double"
    events = in_batches(spark, sf, "events", "event_id", schema).select(
        F.when(F.col("user_id") % 2 == 0, F.lit("train")).otherwise(F.lit("eval")).alias("phase"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("log_window"),
        F.col("event_type").alias("metric"),
        "value",
    )
    by = ["phase", "log_window", "metric"]
    rows = W.latest_log(spark, W.stream_log(events, by, F.col("value")), by)
    return rows.withColumn("mean", F.col("mean").cast("float"))
