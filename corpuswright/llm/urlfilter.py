"""URL filters by hashed expressions, with DataFrame functions only.

A rule is (host, path, verdict). A URL is expanded into expressions: every suffix of its host at a label border, with
every prefix of its path whose length some rule has. Expressions meet the rules in an equi-join on the first four bytes
of their SHA-256; the full digest then confirms, and the longest rule wins. Rules of any number work: nothing of them is
held on the driver but the distinct lengths of their paths and of their hosts in labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table

#: verdict of a URL that no rule fits
DEFAULT = "allow"
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table; the path of a rule such as `net/` is `/`."""
    return local_table(spark, rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_cols: tuple[str, ...] = ("page_id",), url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """id columns, host, path, rule, verdict of every row of `pages`.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path
    together) wins; of equally long ones the one with the longer host, then `block`. Rules given twice count once. A
    null URL, or one without `://`, has an empty host and path and can fit no rule with a host. No rules: all default.
    """
    rules = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where("r_host <> '' and r_path is not null and r_verdict is not null").distinct()
    )
    shape = rules.agg(
        F.sort_array(F.collect_set(F.length("r_path"))).alias("paths"),
        F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels"),
    ).first()
    keyed = rules.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    parts = pages.select(
        *(F.col(c) for c in id_cols), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
    )
    if not shape["paths"]:
        return parts.select(*id_cols, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # equal URLs are judged once; hosts and paths are never null here
    urls = parts.select("host", "path").distinct()
    suffixes = F.array(*(F.substring_index("host", ".", -n) for n in shape["labels"]))
    fits = F.filter(F.array_distinct(suffixes), lambda s: s != "")
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, shape["paths"])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = (
        urls.select("host", "path", F.explode(fits).alias("e_host"), prefixes.alias("p"))
        .select("host", "path", "e_host", F.explode("p").alias("e_path"))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
    )
    hits = expressions.join(keyed, F.substring("e_digest", 1, PREFIX_HEX) == keyed["short"]).where(
        "e_digest = digest and e_host = r_host and e_path = r_path"
    )
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block"))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        *id_cols, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
