"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm.decontaminate import remove_contamination
from corpuswright.llm.linededup import drop_repeated_lines
from corpuswright.llm.minhash import drop_near_duplicates
from corpuswright.llm.mixing import mix_documents
from corpuswright.llm.toxicity import drop_toxic, fit
from corpuswright.session import cut_lineage


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars` follows the text, if the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _release(spark: SparkSession) -> None:
    """Let go of what finished stages hold. Spark drops a shuffle or a broadcast, on disk and in memory, once the driver has
    collected its handle; a driver with room left would put that off, while its heap and the executors' disks grow."""
    spark.sparkContext._jvm.System.gc()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; it learns from the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    _release(spark)
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines of 50 words or more are cut out; every row stays."""
    _release(spark)
    return _counted(drop_repeated_lines(docs).drop("__cw_cut"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays."""
    _release(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark phrases are cut out; every row stays."""
    _release(spark)
    return _counted(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken twice is there twice."""
    _release(spark)
    return mix_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: the toxicity classifier cannot be said in SQL; the tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
