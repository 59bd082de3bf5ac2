"""Cutting answers out of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.text import py_strip, split_literal


def _lines(part: Column) -> Column:
    return F.split(part, "\n")


def _answer(parts: Column, k: Column) -> Column:
    """The first non-blank of the first two lines of part k, else its third line; NULL if an index is missing."""
    line = lambda i: py_strip(F.get(_lines(F.get(parts, k)), F.lit(i)))
    return (
        F.when(line(0) != "", line(0)).when(line(1) != "", line(1)).when(line(1).isNotNull(), line(2))
    )


def _second_suffix(parts: Column) -> Column:
    return py_strip(F.get(_lines(F.get(parts, F.lit(2))), F.lit(0)))


def clean_output(output: Column, suffix: Column, k: int | Column = 1) -> Column:
    """The answer after the k-th suffix (shots + 1 for few-shot prompts).

    When the suffix or a line is missing, the first line after the second suffix; failing that, ''.
    """
    k = F.lit(k) if isinstance(k, int) else k
    return let(
        split_literal(output, suffix), lambda p: F.coalesce(_answer(p, k), _second_suffix(p), F.lit(""))
    )


def output_issue(output: Column, suffix: Column, k: int | Column = 1) -> Column:
    """'ok', 'blank' (an empty line was skipped), 'recovered' (by the next suffix) or 'unrecoverable'."""
    k = F.lit(k) if isinstance(k, int) else k

    def issue(p: Column) -> Column:
        first = py_strip(F.get(_lines(F.get(p, k)), F.lit(0)))
        return (
            F.when(first != "", F.lit("ok"))
            .when(_answer(p, k).isNotNull(), F.lit("blank"))
            .when(_second_suffix(p).isNotNull(), F.lit("recovered"))
            .otherwise(F.lit("unrecoverable"))
        )

    return let(split_literal(output, suffix), issue)


def split_qa(output: Column, prefix: str, suffix: str) -> Column:
    """struct(question, response, failed) of a chat output.

    Without affixes the response is the whole output. A missing affix, or exactly one empty affix (nothing can
    be split by an empty string), fails: the whole output becomes the question and the response 'TODO'.
    """
    done = lambda q, r, bad: F.struct(
        q.alias("question"), r.alias("response"), F.lit(bad).alias("failed")
    )
    todo = done(output, F.lit("TODO"), True)
    if not prefix and not suffix:
        return done(F.lit(""), py_strip(output), False)
    if not prefix or not suffix:
        return todo

    def parts(p: Column) -> Column:
        question = py_strip(F.get(split_literal(F.get(p, F.lit(0)), prefix), F.lit(1)))
        response = py_strip(F.get(p, F.lit(1)))
        return F.when(question.isNotNull() & response.isNotNull(), done(question, response, False)).otherwise(todo)

    return let(split_literal(output, suffix), parts)


def encdec_output(output: Column) -> Column:
    """Encoder-decoder outputs hold the answer only."""
    return py_strip(output)


def output_issues(df: DataFrame, output: str, suffix: str, k: int = 1, by: str = "direction") -> DataFrame:
    """Outputs per direction by how their answer was found."""
    tagged = df.withColumn("__issue", output_issue(F.col(output), F.col(suffix), k))
    kinds = ("ok", "blank", "recovered", "unrecoverable")
    return tagged.groupBy(by).agg(*[F.count_if(F.col("__issue") == i).alias(i) for i in kinds])
