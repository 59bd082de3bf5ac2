"""Mixtures, permutations, limits, concatenation, token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..operators import mixing as M
from ..operators.ordering import align_by_position, uniform_block, with_key_position
from . import fixtures as X
from .fixtures import encoded_ctes, uniform_sql, with_ctes
from .registry import query

LANGS, PROBS = ["de", "en", "es", "fr"], [0.2, 0.5, 0.1, 0.2]


def pick_sql(u: str, names: list[str], probs: list[float]) -> str:
    acc, parts = 0.0, []
    for n, p in list(zip(names, probs))[:-1]:
        acc += p
        parts.append(f"WHEN {u} < {acc / sum(probs)!r} THEN '{n}'")
    return f"CASE {' '.join(parts)} ELSE '{names[-1]}' END"


def interleave_ctes(
    out: str, src: str, source: str, order: str, names: list[str], probs: list[float], seed: int = X.SEED, key: str = "doc_id"
) -> dict[str, str]:
    """`out(draw, key, source)`: draws by probability until every source was read once, sources cycling.

    Eight times the expected number of draws is generated, far beyond the draw that finishes the last source.
    """
    u = f"(('0x'||substr(md5('{seed}:'||draw),1,8))::BIGINT/4294967296.0::DOUBLE)"
    weights = ", ".join(f"('{n}', {p!r})" for n, p in zip(names, probs))
    return {
        f"{out}_n": f"SELECT {source} AS source, count(*) AS n FROM {src} WHERE {source} IN (SELECT s FROM (VALUES {weights}) w(s, p)) GROUP BY ALL",
        f"{out}_d": f"""SELECT draw, {pick_sql(u, names, probs)} AS source FROM (SELECT unnest(range(
            (SELECT (8 * max(n / p) + 100)::BIGINT FROM {out}_n JOIN (VALUES {weights}) w(s, p) ON s = source))) AS draw)""",
        f"{out}_k": f"""SELECT d.draw, d.source, n, row_number() OVER (PARTITION BY d.source ORDER BY draw) - 1 AS k
            FROM {out}_d d JOIN {out}_n USING (source)""",
        f"{out}_r": f"""SELECT {source} AS source, {key}, row_number() OVER (PARTITION BY {source} ORDER BY {order}) - 1 AS row FROM {src}""",
        out: f"""SELECT draw, k.source, r.{key} FROM {out}_k k JOIN {out}_r r ON r.source = k.source AND r.row = k.k % k.n
            WHERE draw <= (SELECT max(draw) FROM {out}_k WHERE k = n - 1)""",
    }


@query(with_ctes("", """
SELECT draw, i.source AS lang, i.doc_id, d.text AS raw_text FROM mix i JOIN documents d ON d.doc_id = i.doc_id""",
    interleave_ctes("mix", "documents", "lang", "doc_id", LANGS, PROBS)))
def interleave(spark, sf):
    mixed = M.interleave(X.mono(spark, sf), "doc_id", LANGS, PROBS, X.SEED, "lang")
    return mixed.select("draw", "lang", "doc_id", "raw_text")


SORTED = M.sort_mixture(LANGS, PROBS)


@query(with_ctes("", "SELECT draw, source AS lang, doc_id FROM mix", interleave_ctes("mix", "documents", "lang", "doc_id", *SORTED)))
def interleave_sorted_sources(spark, sf):
    names, probs = M.sort_mixture(LANGS, PROBS)
    return M.interleave(X.mono(spark, sf).drop("raw_text"), "doc_id", names, probs, X.SEED, "lang").select("draw", "lang", "doc_id")


@query(with_ctes("", "SELECT draw, source AS lang, doc_id FROM mix",
    interleave_ctes("mix", "documents", "lang", f"{uniform_sql('doc_id')}, doc_id", LANGS, M.uniform_probs(4))))
def interleave_shuffled_uniform(spark, sf):
    """Sources shuffled first, no probabilities given: all sources alike."""
    rows = X.mono(spark, sf).drop("raw_text").withColumn("u", uniform(X.SEED, F.col("doc_id")))
    mixed = M.interleave(rows, "doc_id", LANGS, None, X.SEED, "lang", ["u", "doc_id"], uniform_block(F.col("u")))
    return mixed.select("draw", "lang", "doc_id")


NESTED = {
    **interleave_ctes("monomix", "documents", "lang", "doc_id", *SORTED),
    "combined": f"""SELECT seq, lang_a, CASE WHEN {uniform_sql('seq')} < 0.5 THEN text_a||' '||text_b
        ELSE text_b||' '||text_a END AS raw_text FROM parallel""",
    **interleave_ctes("webmix", "combined", "lang_a", "seq", ["de", "es", "fr"], M.uniform_probs(3), key="seq"),
    "union_all": """SELECT 'mono' AS mixture, draw AS place, d.text AS raw_text FROM monomix m JOIN documents d ON d.doc_id = m.doc_id
        UNION ALL SELECT 'web', draw, c.raw_text FROM webmix w JOIN combined c ON c.seq = w.seq""",
    **interleave_ctes("nested", "union_all", "mixture", "place", ["mono", "web"], [0.5, 0.5], key="place"),
    "shuffled": f"""SELECT *, row_number() OVER (ORDER BY {uniform_sql('draw')}, draw) - 1 AS pos FROM nested""",
}


@query(with_ctes("parallel", """
SELECT s.pos, s.source AS mixture, s.place, u.raw_text FROM shuffled s JOIN union_all u ON u.mixture = s.source AND u.place = s.place""", NESTED))
def mix_nested(spark, sf):
    """Monolingual mixture and web-parallel mixture, half and half, then shuffled."""
    from ..operators.filters import join_sides_random

    names, probs = M.sort_mixture(LANGS, PROBS)
    docs, pairs = X.mono(spark, sf), join_sides_random(X.parallel(spark, sf), X.SEED)
    mono = M.interleave(docs.select("lang", "doc_id"), "doc_id", names, probs, X.SEED, "lang", out="place")
    web = M.interleave(pairs.select("lang_a", "seq"), "seq", ["de", "es", "fr"], None, X.SEED, "lang_a", out="place")
    keys = M.mix_nested(
        mono.select("place", F.col("doc_id").alias("row")), web.select("place", F.col("seq").alias("row")), "place", X.SEED, "pos"
    )
    texts = docs.select(F.lit("mono").alias("mixture"), F.col("doc_id").alias("row"), "raw_text").unionByName(
        pairs.select(F.lit("web").alias("mixture"), F.col("seq").alias("row"), "raw_text")
    )
    return keys.join(texts, ["mixture", "row"]).select("pos", "mixture", "place", "raw_text")


@query(f"SELECT doc_id, text AS raw_text, row_number() OVER (ORDER BY {uniform_sql('doc_id')}, doc_id) - 1 AS pos FROM documents")
def shuffle(spark, sf):
    return M.shuffle_position(X.mono(spark, sf).select("doc_id", "raw_text"), X.SEED, "doc_id")


@query("SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20")
def take_first(spark, sf):
    rows = M.take_first(X.mono(spark, sf).select("doc_id", "lang"), 20, "doc_id", ("lang",))
    return with_key_position(rows, "doc_id", ("lang",), "rn").withColumn("rn", F.col("rn") + 1)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 2000")
def take_first_by_position(spark, sf):
    """A limit beyond most groups."""
    return M.take_first(X.mono(spark, sf).select("doc_id", "lang"), 2000, "doc_id", ("lang",))


@query(with_ctes("parallel", f"""
SELECT source, key, raw_text, row_number() OVER (ORDER BY {uniform_sql('key')}, key) - 1 AS pos FROM (
  SELECT 'mono' AS source, doc_id * 2 AS key, text AS raw_text FROM documents
  UNION ALL SELECT 'web', seq * 2 + 1, text_a||' '||text_b FROM parallel)"""))
def concat_sources(spark, sf):
    mono = X.mono(spark, sf).select(F.lit("mono").alias("source"), (F.col("doc_id") * 2).alias("key"), "raw_text")
    web = X.parallel(spark, sf).select(
        F.lit("web").alias("source"), (F.col("seq") * 2 + 1).alias("key"), F.concat_ws(" ", "text_a", "text_b").alias("raw_text")
    )
    return M.shuffle_position(M.concat_sources([mono, web]), X.SEED, "key")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {uniform_sql('doc_id')}, doc_id LIMIT 16")
def random_rows(spark, sf):
    return M.random_rows(X.mono(spark, sf).select("doc_id", "lang"), 16, X.SEED, "doc_id")


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents")
def row_position(spark, sf):
    return with_key_position(X.mono(spark, sf).select("lang", "doc_id"), "doc_id", ("lang",))


SPARSE = "('0x'||substr(md5(doc_id::VARCHAR),1,15))::BIGINT"
SPARSE_LANG = "CASE WHEN doc_id % 5 <> 0 THEN lang END"


def sparse_rows(spark, sf):
    """Hashed keys, one of them NULL, and no language for every fifth row."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    return X.mono(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") != 7, key).alias("key"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")
    )


SPARSE_ROWS = f"SELECT doc_id, CASE WHEN doc_id <> 7 THEN {SPARSE} END AS key, {SPARSE_LANG} AS lang FROM documents"


@query(f"SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key NULLS FIRST) - 1 AS pos FROM ({SPARSE_ROWS})")
def row_position_sparse(spark, sf):
    return with_key_position(sparse_rows(spark, sf), "key", ("lang",))


@query(f"""SELECT doc_id, key, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key NULLS FIRST) AS rn FROM ({SPARSE_ROWS}))
WHERE rn <= 30""")
def take_first_sparse(spark, sf):
    return M.take_first(sparse_rows(spark, sf), 30, "key", ("lang",))


@query(f"""SELECT doc_id, key, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key NULLS FIRST) AS rn FROM
    (SELECT doc_id, md5(doc_id::VARCHAR) AS key, {SPARSE_LANG} AS lang FROM documents)) WHERE rn <= 300""")
def take_first_text_keys(spark, sf):
    rows = sparse_rows(spark, sf).withColumn("key", F.md5(F.col("doc_id").cast("string")))
    return M.take_first(rows, 300, "key", ("lang",))


@query("""
WITH n AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT a.lang AS lang, a.pos, a.doc_id AS doc_a, b.doc_id AS doc_b, a.text AS text_a, b.text AS text_b
FROM n a JOIN n b ON b.pos = a.pos AND b.lang = 'en' WHERE a.lang <> 'en'
UNION ALL SELECT NULL, pos, NULL, doc_id, NULL, text FROM n
    WHERE lang = 'en' AND pos NOT IN (SELECT pos FROM n WHERE lang <> 'en')
UNION ALL SELECT lang, pos, doc_id, NULL, text, NULL FROM n
    WHERE lang <> 'en' AND pos NOT IN (SELECT pos FROM n WHERE lang = 'en')"""
)
def align_by_position_rows(spark, sf):
    """Rows of two languages that hold the same place in their corpus."""
    rows = with_key_position(X.mono(spark, sf), "doc_id", ("lang",))
    left = rows.filter("lang <> 'en'").select("lang", "pos", F.col("doc_id").alias("doc_a"), F.col("raw_text").alias("text_a"))
    right = rows.filter("lang = 'en'").select("pos", F.col("doc_id").alias("doc_b"), F.col("raw_text").alias("text_b"))
    return align_by_position(left, right)


@query(with_ctes("vocab", """
SELECT lang, sum(len(ids) + 2)::BIGINT AS tokens, sum(len(ids) + 2)::BIGINT // 512 AS full_blocks,
       round(sum(len(ids) + 2) / (SELECT sum(len(ids) + 2) FROM enc), 9) AS share, sum(len(ids) + 2)::BIGINT // (4 * 512) AS steps
FROM enc e JOIN documents d ON d.doc_id = e.doc_id GROUP BY lang""", encoded_ctes("enc", "documents", "doc_id", X.strip_sql("text"))))
def token_accounting(spark, sf):
    from ..operators.packing import mono_ids

    v = X.vocabulary(spark, sf)
    ids = X.mono(spark, sf).select("lang", mono_ids(v, F.col("raw_text"), None).alias("ids"))
    return M.token_accounting(ids, "ids", "lang", 4, 512).withColumn("share", F.round("share", 9))
