"""Bind a value once inside an expression.

A lambda body is evaluated per element, and the optimizer may inline a projected column into it. Whatever a
lambda needs besides its own arguments is therefore bound here first, which keeps array work linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body(s)` where s['name'] is the value of that name."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
