"""String expressions whose results equal Python's `str` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts, as a class both Java and RE2 read.
PY_SPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def py_strip(c: Column) -> Column:
    """Unicode strip on both ends; Spark `trim` removes plain spaces only."""
    return F.regexp_replace(c, rf"\A[{PY_SPACE}]+|[{PY_SPACE}]+\z", "")


def py_split(c: Column) -> Column:
    """`str.split()`: words between runs of Unicode white space."""
    return F.filter(F.split(c, rf"[{PY_SPACE}]+"), lambda w: w != "")


def split_literal(c: Column, sep: str | Column) -> Column:
    """`str.split(sep)` for a literal separator (a per-row column is allowed), keeping empty parts."""
    if isinstance(sep, str):
        sep = F.lit(sep)
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    return F.call_function("split", c, quoted, F.lit(-1))


def words(c: Column) -> Column:
    """Tokens between blanks, tabs and line ends: the unit of the corpus vocabulary."""
    return F.filter(F.split(c, "[ \\n\\t\\r]+"), lambda w: w != "")
