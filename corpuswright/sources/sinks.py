"""Writers. Order is kept by range partitioning: part files in name order hold the rows in order."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import child_folders, create_file, delete_file, modified

#: name of the marker of a finished version, and how long another writer is waited for
READY, WAIT_SECONDS = "_READY", 6 * 3600.0


def _ordered(df: DataFrame, *keys: str, single_file: bool = False) -> DataFrame:
    if single_file:
        return df.coalesce(1).sortWithinPartitions(*keys)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_translations(df: DataFrame, out_dir: str, suffix: str = "", single_file: bool = False) -> None:
    """One line per segment in input order, one folder `test-<src>-<tgt><suffix>` per direction.

    `single_file` puts each direction into one file, by one task: only for test sets.
    """
    named = df.withColumn("file", F.concat(F.lit("test-"), "direction", F.lit(suffix)))
    rows = _ordered(named, "file", "seg_id", single_file=single_file)
    rows.select("file", F.col("output").alias("value")).write.partitionBy("file").text(out_dir)


def write_aligned(df: DataFrame, root: str, direction: str, lang: str, text: str) -> None:
    """One side of a test set in the line-aligned layout."""
    path = f"{root}/{direction.replace('-', '')}/test.{direction}.{lang}"
    _ordered(df.filter(F.col("direction") == direction), "seg_id").select(text).write.text(path)


def write_qa_jsonl(df: DataFrame, out_dir: str, order: tuple[str, ...] = ("seq",)) -> None:
    """question/response JSON lines per language."""
    rows = _ordered(df, "lang", *order)
    rows.select("lang", "question", "response").write.partitionBy("lang").json(out_dir)


def write_report(report: DataFrame, out: str, fmt: str = "json") -> None:
    """The report in request order; a few rows per direction, hence one file."""
    report.coalesce(1).sortWithinPartitions("position", "system").write.format(fmt).option("header", True).save(out)


def preview(df: DataFrame, n: int = 10, by: str = "direction", order: str = "seg_id") -> DataFrame:
    """First n outputs per direction; pruned to n rows per direction in every task before the shuffle."""
    first = W.partitionBy(by).orderBy(order)
    return df.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= n)


def fingerprint(*parts: object) -> str:
    """A name for prepared data from all that it depends on: options, vocabulary, input paths, and the like."""
    return hashlib.sha256("\x1f".join(repr(p) for p in parts).encode()).hexdigest()[:32]


def cache_prepared(df: DataFrame, path: str, key: str, overwrite: bool = False) -> DataFrame:
    """Prepared data from `path`/`key` if a finished write is there, else written first (see `prepare_once`).

    `key` is the `fingerprint` of what `df` was prepared from, so that other options, inputs or vocabularies never meet
    an old result. The schema must be the same too: it is part of the folder's name.
    """
    folder = f"{path}/{key}-{fingerprint(df.schema.simpleString())[:8]}"
    return prepare_once(df.sparkSession, lambda: df, folder, overwrite)


def prepare_once(
    spark: SparkSession, make: Callable[[], DataFrame], folder: str, overwrite: bool = False,
    wait_seconds: float = WAIT_SECONDS, poll_seconds: float = 1.0,
) -> DataFrame:
    """The rows of `make()`, written below `folder` by one of all sessions that ask for them and read by the others.

    A version is a folder of its own, which nobody sees before its marker stands beside the finished files. A claim file
    says that somebody writes; others wait for the marker, and after `wait_seconds` (a writer may have died with its
    claim) write a version themselves. Of several versions of one generation everybody reads the one finished first, so
    writers that meet do no harm; `overwrite` starts a new generation. Older versions stay: they may be in use.
    """
    versions = finished_versions(spark, folder)
    wanted = versions[0][0] + (1 if overwrite else 0) if versions else 0
    claim, deadline = f"{folder}/_claim-{wanted}", time.monotonic() + wait_seconds
    while True:
        versions = finished_versions(spark, folder)
        if versions and versions[0][0] >= wanted:
            return spark.read.parquet(versions[0][2])
        if not create_file(spark, claim) and time.monotonic() < deadline:
            time.sleep(poll_seconds)
            continue
        mine = f"{folder}/version-{wanted}-{uuid.uuid4().hex}"
        try:
            make().write.parquet(mine)
            create_file(spark, f"{mine}/{READY}")
        finally:
            delete_file(spark, claim)


def finished_versions(spark: SparkSession, folder: str) -> list[tuple[int, int, str]]:
    """(generation, time of completion, path), the one to read first."""
    found = []
    for path in child_folders(spark, folder):
        finished = modified(spark, f"{path}/{READY}")
        if finished is not None:
            found.append((int(path.rsplit("/", 1)[1].split("-")[1]), finished, path))
    return sorted(found, key=lambda v: (-v[0], v[1], v[2]))
