"""Paths and line numbers: what all readers share."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from ..session import cut_lineage

log = logging.getLogger(__name__)


def _located(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists."""
    fs, p = _located(spark, path)
    return fs.exists(p)


def create_file(spark: SparkSession, path: str) -> bool:
    """An empty file with the folders above it; False if it is there already."""
    fs, p = _located(spark, path)
    try:
        return fs.createNewFile(p)
    except Py4JJavaError as error:  # of two at once, the second may be told so by an exception
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False


def delete_file(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, False)


def modified(spark: SparkSession, path: str) -> int | None:
    """Milliseconds of the last change; None if nothing is there."""
    fs, p = _located(spark, path)
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None


def child_folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _located(spark, path)
    return [str(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The distinct paths that exist, in order; missing ones are logged and skipped."""
    found = []
    for path in dict.fromkeys(paths):
        if path_exists(spark, path):
            found.append(path)
        else:
            log.warning("%s does not exist, skipped", path)
    return found


def with_file_columns(df: DataFrame) -> DataFrame:
    """Add the file, the start of the split inside it, and the reading order, straight from the scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__offset"),
        F.monotonically_increasing_id().alias("__order"),
    )


def with_line_number(df: DataFrame, by: tuple[str, ...] = (), out: str = "seg_id") -> DataFrame:
    """0-based line number over the files of each `by` group, files in name order; `by` must be the same in all of a file.

    The rows of a split are read in one go, so their places are the distances from its first row. A first read counts rows per
    split; the table of splits is written, and the planner, which then knows its size, joins it to the rows where they are. No row
    is sorted or shuffled for its number, and a compressed file, which is one split, is nobody's sort.
    """
    split = F.struct("__file", "__offset")
    # a read of no data column may count lines that a parser skips
    data = next(c for c in df.columns if c not in ("__file", "__offset", "__order", *by))
    counts = df.groupBy(F.struct(*by, F.lit(0).alias("__")).alias("__group"), split.alias("__split")).agg(
        F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__n"), F.max(F.col(data).isNull()).alias("__parsed"))
    before = W.partitionBy("__group").orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__split", "__parsed", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    starts = cut_lineage(starts, "splits")
    numbered = df.withColumn("__split", split).join(starts, "__split").withColumn(out, F.col("__order") + F.col("__shift"))
    return numbered.drop("__split", "__shift", "__parsed", "__file", "__offset", "__order")


def with_row_number(df: DataFrame, by: tuple[str, ...], out: str = "seg_id") -> DataFrame:
    """The same where rows of one file belong to several groups: a split is the block of `with_position`."""
    numbered = with_position(df, ["__order"], F.struct("__file", "__offset"), by, out)
    return numbered.drop("__file", "__offset", "__order")
