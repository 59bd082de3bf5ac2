"""Denoising tasks over whole texts in rows of 64 ids; full rows have no padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import denoise as U
from . import fixtures as X
from .fixtures import arr, joined, ones_zeros_sql, pad_sql, with_ctes
from .registry import query
from .tokens import ROW_CTES, WIDTH, texts, token_rows

S = X.SPECIALS

TASK_SQL = f"""CASE WHEN {X.uniform_sql("'task'", 'row_id')} < 0.25 THEN 'R'
    WHEN {X.uniform_sql("'task'", 'row_id')} < 0.75 THEN 'S' ELSE 'X' END"""


def cuts_sql(items: str, segments: str, tag: str, kind: str) -> str:
    """Sorted cut positions."""
    key = f"substr(md5('{X.SEED}:'||row_id||':{tag}:{kind}:'||i), 1, 8)||lpad(i::VARCHAR, 9, '0')"
    ranked = f"list_sort(list_transform(range(1, {items}), lambda i: {key}))"
    return f"list_sort(list_transform({ranked}[1:{segments} - 1], lambda s: substr(s, 9)::INT))"


def spans_ctes(src: str, out: str, tag: str, mean: str, density: float) -> dict[str, str]:
    """`out(row_id, ids, fp, mask)`: the noise mask of every row, cleared from the first pad on."""
    n = f"{out}_n"
    return {
        n: f"""SELECT *, least(greatest(round_even(spans0, 0), 1), noise, {WIDTH} - noise)::INT AS spans
            FROM (SELECT *, noise / mean AS spans0 FROM (SELECT row_id, ids, fp, {mean} AS mean,
                least(greatest(round_even({WIDTH} * {density}, 0), 1), {WIDTH} - 1)::INT AS noise FROM {src}))""",
        f"{out}_c": f"""SELECT row_id, ids, fp,
            list_concat({cuts_sql('noise', 'spans', tag, 'noise')}, [noise]) AS ca,
            list_concat({cuts_sql(f'({WIDTH} - noise)', 'spans', tag, 'kept')}, [{WIDTH} - noise]) AS cb FROM {n}""",
        out: f"""SELECT row_id, ids, fp, list_transform(range({WIDTH}), lambda p: CASE
              WHEN p >= CASE WHEN fp < 0 THEN {WIDTH} - 1 ELSE fp END THEN 0
              WHEN len(list_filter(range(1, len(ca) + 1), lambda j: p >= cb[j] + CASE WHEN j = 1 THEN 0 ELSE ca[j - 1] END
                   AND p < cb[j] + ca[j])) > 0 THEN 1 ELSE 0 END) AS mask FROM {out}_c""",
    }


def sentinel_sql(mask: str) -> str:
    start = lambda i: f"({mask}[{i}] = 1 AND ({i} = 1 OR {mask}[{i} - 1] = 0))"
    starts = f"list_filter(range(1, {WIDTH} + 1), lambda si: {start('si')})"
    return f"""list_transform(range(1, {WIDTH} + 1), lambda ti: CASE WHEN {mask}[ti] = 0 THEN 0
        WHEN {start('ti')} THEN {X.VOCAB_LEN} - list_position({starts}, ti) ELSE -1 END)"""


def collapse_sql(ids: str, marks: str) -> str:
    return f"[x for x in [CASE WHEN {marks}[i] <> 0 THEN {marks}[i] ELSE x END for x, i in {ids}] if x >= 0]"


def rewrite_ctes(src: str, out: str) -> dict[str, str]:
    return {
        f"{out}_s": f"""SELECT row_id, ids, {sentinel_sql('mask')} AS s1, {sentinel_sql('inv')} AS s2
            FROM (SELECT *, [1 - m for m in mask] AS inv FROM {src})""",
        f"{out}_t": f"""SELECT row_id, [x for x in {collapse_sql('ids', 's1')} if x <> {S.pad}] AS a,
            [x for x in {collapse_sql('ids', 's2')} if x <> {S.pad}] AS b FROM {out}_s""",
        out: f"""SELECT row_id, {pad_sql('list_concat(a, b)', WIDTH, S.pad)}[1:{WIDTH}] AS input_ids,
            {pad_sql('list_concat([-100 for q in a], b)', WIDTH, -100)}[1:{WIDTH}] AS labels,
            {ones_zeros_sql(WIDTH, '(len(a) + len(b))')} AS attention_mask, {ones_zeros_sql(WIDTH, 'len(a)')} AS prefix_mask
            FROM {out}_t""",
    }


BASE = {
    **ROW_CTES,
    "base": f"SELECT row_id, ids, mask AS att, (coalesce(list_position(ids, {S.pad}), 0) - 1)::INT AS fp FROM rows",
}
R_MASK = spans_ctes("base", "rmask", "r0", "3.0::DOUBLE", 0.15)
X_MASK = spans_ctes("base", "xmask", "x0", "least(32.0::DOUBLE, fp * 0.5::DOUBLE)", 0.5)


def labelled(spark, sf):
    return token_rows(spark, sf).withColumn("labels", A.ignore_value(F.col("input_ids"), S.pad))


@query(with_ctes("vocab", f"SELECT row_id, {TASK_SQL} AS task FROM rows", ROW_CTES))
def assign_task(spark, sf):
    return token_rows(spark, sf).select("row_id", U.assign_task(F.col("row_id"), X.SEED).alias("task"))


MASK_OUT = "SELECT r.row_id, {} AS r_mask, {} AS x_mask FROM rmask r JOIN xmask x ON x.row_id = r.row_id"


@query(with_ctes("vocab", MASK_OUT.format(arr("r.mask"), arr("x.mask")), {**BASE, **R_MASK, **X_MASK}))
def noise_mask(spark, sf):
    rows = token_rows(spark, sf).withColumn("fp", A.first_index(F.col("input_ids"), S.pad))
    n, fp, key = F.size("input_ids"), F.col("fp"), F.col("row_id")
    return rows.select(
        "row_id", joined(U.r_mask(n, fp, X.SEED, key)).alias("r_mask"), joined(U.x_mask(n, fp, X.SEED, key)).alias("x_mask")
    )


@query(with_ctes("vocab", f"SELECT r.row_id, {arr('[greatest(m, x.mask[i]) for m, i in r.mask]')} AS mask FROM rmask r JOIN xmask x ON x.row_id = r.row_id",
    {**BASE, **R_MASK, **X_MASK}))
def mask_union(spark, sf):
    rows = token_rows(spark, sf).withColumn("fp", A.first_index(F.col("input_ids"), S.pad))
    n, fp, key = F.size("input_ids"), F.col("fp"), F.col("row_id")
    rows = rows.withColumn("a", U.r_mask(n, fp, X.SEED, key)).withColumn("b", U.x_mask(n, fp, X.SEED, key))
    return rows.select("row_id", joined(U.mask_union([F.col("a"), F.col("b")])).alias("mask"))


@query(with_ctes("vocab", f"SELECT row_id, {arr(sentinel_sql('mask'))} AS marks FROM rmask", {**BASE, **R_MASK}))
def sentinels(spark, sf):
    rows = token_rows(spark, sf).withColumn("fp", A.first_index(F.col("input_ids"), S.pad))
    rows = rows.withColumn("mask", U.r_mask(F.size("input_ids"), F.col("fp"), X.SEED, F.col("row_id")))
    return rows.select("row_id", joined(U.sentinels(F.col("mask"), X.VOCAB_LEN)).alias("marks"))


@query(with_ctes("vocab", f"SELECT row_id, {arr(pad_sql(collapse_sql('ids', 's1'), WIDTH, S.pad))} AS ids FROM marked",
    {**BASE, **R_MASK, "marked": f"SELECT row_id, ids, {sentinel_sql('mask')} AS s1 FROM rmask"}))
def apply_sentinels(spark, sf):
    rows = token_rows(spark, sf).withColumn("fp", A.first_index(F.col("input_ids"), S.pad))
    rows = rows.withColumn("mask", U.r_mask(F.size("input_ids"), F.col("fp"), X.SEED, F.col("row_id")))
    rows = rows.withColumn("marks", U.sentinels(F.col("mask"), X.VOCAB_LEN))
    return rows.select("row_id", joined(U.apply_sentinels(F.col("input_ids"), F.col("marks"), S.pad)).alias("ids"))


ROW_OUT = "SELECT row_id, {} AS input_ids, {} AS attention_mask, {} AS labels, {} AS prefix_mask FROM ".format(
    arr("input_ids"), arr("attention_mask"), arr("labels"), arr("prefix_mask")
)


@query(with_ctes("vocab", ROW_OUT + "rnew", {**BASE, **R_MASK, **rewrite_ctes("rmask", "rnew")}))
def r_denoise(spark, sf):
    return texts(U.r_denoise(labelled(spark, sf), "row_id", X.SEED, X.VOCAB_LEN, S.pad), "row_id")


@query(with_ctes("vocab", ROW_OUT + "xnew", {**BASE, **X_MASK, **rewrite_ctes("xmask", "xnew")}))
def x_denoise(spark, sf):
    return texts(U.x_denoise(labelled(spark, sf), "row_id", X.SEED, X.VOCAB_LEN, S.pad), "row_id")


S_NEW = {
    "snew": f"""SELECT row_id, ids AS input_ids, [CASE WHEN x = {S.pad} THEN -100 ELSE x END for x in ids] AS labels,
        att AS attention_mask, {ones_zeros_sql(WIDTH, 'greatest(floor(fp / 2.0), 2)')} AS prefix_mask FROM base"""
}


@query(with_ctes("vocab", ROW_OUT + "snew", {**BASE, **S_NEW}))
def s_denoise(spark, sf):
    return texts(U.s_denoise(labelled(spark, sf), S.pad), "row_id")


@query(with_ctes("vocab", f"""
SELECT task, c.* FROM (SELECT row_id, {TASK_SQL} AS task FROM rows) t JOIN (
  SELECT 'R' AS k, * FROM ({ROW_OUT} rnew) UNION ALL SELECT 'X', * FROM ({ROW_OUT} xnew) UNION ALL SELECT 'S', * FROM ({ROW_OUT} snew)
) c0 ON c0.k = t.task AND c0.row_id = t.row_id JOIN LATERAL (SELECT c0.row_id AS row_id, c0.input_ids AS input_ids,
  c0.attention_mask AS attention_mask, c0.labels AS labels, c0.prefix_mask AS prefix_mask) c ON true""",
    {**BASE, **R_MASK, **X_MASK, **S_NEW, **rewrite_ctes("rmask", "rnew"), **rewrite_ctes("xmask", "xnew")}))
def denoise(spark, sf):
    return texts(U.denoise(labelled(spark, sf), "row_id", X.SEED, X.VOCAB_LEN, S.pad), "row_id", "task")
