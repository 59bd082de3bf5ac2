"""Translation directions: the request as a small dimension, and rows expanded by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table


def parse_directions(directions: str | list[str]) -> list[str]:
    """'de-en,en-de' → ['de-en', 'en-de'], request order kept, duplicates removed."""
    items = directions.split(",") if isinstance(directions, str) else list(directions)
    out = list(dict.fromkeys(items))
    for d in out:
        if len(d.split("-")) != 2:
            raise ValueError(f"not a direction: {d}")
    return out


def canonical(direction: str) -> str:
    """The unordered pair, named with the non-English side first and English second."""
    src, tgt = direction.split("-")
    return f"{src if src != 'en' else tgt}-en"


def direction_dim(spark: SparkSession, directions: str | list[str]) -> DataFrame:
    """One row per request: position, direction, src, tgt, pair (canonical)."""
    rows = [(i, d, *d.split("-"), canonical(d)) for i, d in enumerate(parse_directions(directions))]
    return local_table(spark, rows, "position int, direction string, src string, tgt string, pair string")


def requested_languages(directions: str | list[str]) -> list[str]:
    """Sorted distinct languages on either side of the request."""
    return sorted({lang for d in parse_directions(directions) for lang in d.split("-")})


def filter_pairs(df: DataFrame, directions: str | list[str], a: str = "lang_a", b: str = "lang_b") -> DataFrame:
    """Rows whose language pair is requested in either direction (a literal IN list, so it is pushed down)."""
    wanted = parse_directions(directions)
    return df.filter(_direction(F.col(a), F.col(b)).isin(wanted) | _direction(F.col(b), F.col(a)).isin(wanted))


def expand_directions(df: DataFrame, directions: str | list[str]) -> DataFrame:
    """Each parallel row yields an example per requested direction: forward first, then reverse.

    The request is a literal list (a few hundred entries at most), filtered before the explode, so the
    step is one narrow projection without a shuffle or a join.
    """
    wanted = parse_directions(directions)
    side = lambda order, s, t: F.struct(
        F.lit(order).alias("ord"),
        F.col(f"lang_{s}").alias("src"),
        F.col(f"lang_{t}").alias("tgt"),
        F.col(f"text_{s}").alias("src_text"),
        F.col(f"text_{t}").alias("tgt_text"),
    )
    both = F.array(side(0, "a", "b"), side(1, "b", "a"))
    kept = F.filter(both, lambda x: _direction(x["src"], x["tgt"]).isin(wanted))
    passed = [c for c in df.columns if c not in ("lang_a", "lang_b", "text_a", "text_b")]
    return (
        df.withColumn("__ex", F.explode(kept))
        .select(*passed, "__ex.*")
        .withColumn("direction", _direction(F.col("src"), F.col("tgt")))
    )


def _direction(src: Column, tgt: Column) -> Column:
    return F.concat_ws("-", src, tgt)
