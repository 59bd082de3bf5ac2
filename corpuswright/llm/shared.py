"""Sending an object to all tasks as plain data: workers need not have this library on their path."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import SparkSession


def share(spark: SparkSession, thing: object) -> Broadcast:
    """The attributes of `thing`, which hold numbers, text, arrays and containers of these, as a broadcast value."""
    return spark.sparkContext.broadcast(dict(vars(thing)))


def restore(kind: type, shared: Broadcast):
    """An object of the class `kind` with the attributes that were shared."""
    thing = kind.__new__(kind)
    thing.__dict__.update(shared.value)
    return thing
