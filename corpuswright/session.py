"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_dir: str | None = None

#: between the two collections of `release`
RELEASE_SECONDS = 0.5


def build_session(app: str = "corpuswright", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; on a cluster pass no master and size it by `conf`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir`, or a scratch folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_dir
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="corpuswright-")
    return _local_dir


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never reused between runs."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write once and read back, so that a lost executor costs a re-read and not a recomputation."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffles of finished writes. Spark drops a shuffle from disk once the driver has collected its handle, which
    a driver with room left puts off. As measured, one collection right after a write may free nothing, and a second after a pause all."""
    for pause in (RELEASE_SECONDS, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation: no job and no Python worker when it is broadcast."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=fields)
