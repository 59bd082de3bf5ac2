"""Words of whole text columns for the operators of training data (`functions/bytewords.py` cuts and hashes them)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf

from ..functions.bytewords import (  # noqa: F401
    ALNUM, LONG_WORD, LOWER, PIECE_BYTES, PLAIN, Words, _table, chain, column_bytes, hash_spans, mix, pieces, spans, words,
)


def byte_hash(values: list[bytes]) -> np.ndarray:
    """Hashes of given words, equal to those that `words` gives them."""
    buffer = np.frombuffer(b"".join(values), dtype=np.uint8)
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    return hash_spans(buffer, ends - np.array([len(v) for v in values], dtype=np.int64), ends) if values else np.zeros(0, np.uint64)


def column_udf(fn, returns: str):
    """An Arrow function over one column as a column expression."""

    def run(column: pa.Array) -> pa.Array:
        return fn(column)

    return arrow_udf(run, returns)
