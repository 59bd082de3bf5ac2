"""Reproducible randomness: a uniform that is a pure function of (seed, keys).

`rand(seed)` depends on how rows are partitioned and on retries; an md5 of the row key does not, so a
recomputed task after an executor loss yields the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int, *keys: Column) -> Column:
    """First 32 bits of md5('seed:key[:key…]') as 8 hex digits (sorts like the uniform)."""
    parts = [F.lit(str(seed)), *[k.cast("string") for k in keys]]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return F.conv(hash_hex(seed, *keys), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(u: Column, names: list, probs: list[float]) -> Column:
    """The name whose cumulative probability interval holds u (names and probs are parallel lists)."""
    if len(names) != len(probs):
        raise ValueError("one probability per name")
    total = float(sum(probs))
    choice, acc = None, 0.0
    for name, p in list(zip(names, probs))[:-1]:
        acc += p
        bound = u < F.lit(acc / total)
        choice = F.when(bound, F.lit(name)) if choice is None else choice.when(bound, F.lit(name))
    last = F.lit(names[-1])
    return last if choice is None else choice.otherwise(last)
