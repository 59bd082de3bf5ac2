"""The registered queries of this subpackage, one per operator, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality, toxicity
from .conversations import damage, repair_conversations
from .decontaminate import mark_contamination
from .langmodel import score_texts
from .linededup import drop_repeated_lines
from .minhash import near_duplicates
from .mixing import mix_plan
from .rules import judge_quality
from .samples import crc_of, held_out
from .search import rank_documents
from .secrets import scan_secrets
from .urlfilter import judge_urls, rule_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOW = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"


_LINE_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
    FROM documents WHERE text IS NOT NULL
), w AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l
), c AS (
    SELECT doc_id, line, k, row_number() OVER d AS i, sum(n) OVER d AS upto, sum(n) OVER d - n AS before
    FROM w WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), bounds AS (
    SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY ALL
    UNION
    SELECT a.doc_id, max(b.i) AS lo, a.i AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.upto - b.before >= 50 GROUP BY a.doc_id, a.i
), runs AS (
    SELECT r.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY i) AS run FROM bounds r JOIN c ON c.doc_id = r.doc_id AND i BETWEEN lo AND hi GROUP BY ALL
), later AS (
    SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS nth FROM runs
), gone AS (
    SELECT DISTINCT c.doc_id, c.k FROM later JOIN c ON c.doc_id = later.doc_id AND i BETWEEN lo AND hi WHERE nth > 1
), kept AS (
    SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.k = gone.k GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_cut, 0) AS n_lines_cut, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_cut FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""


@register(_LINE_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines of 50 words or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    lines = lambda c: F.size(F.split(c, "\n", -1))
    out = drop_repeated_lines(docs)
    # a text that loses all its lines is empty, which still splits into one
    left = F.when(F.col("text") == "", F.when(F.col("whole") == "", 1).otherwise(0)).otherwise(lines("text"))
    cut = F.coalesce(lines("whole") - left, F.lit(0)).cast("long")
    return out.select("doc_id", cut.alias("n_lines_cut"), "text")


_LEAK_SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, s, array_to_string(w[p:p + s - 1], ' ') AS win
    FROM (SELECT item_id, w, least(10, len(w)) AS s, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, s, p, array_to_string(w[p:p + s - 1], ' ') AS win
    FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT s FROM bw) WHERE len(w) >= s)
), hits AS (
    SELECT DISTINCT doc_id, dw.s, p, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.win = bw.win
), marked AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + s)) AS q FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@register(_LEAK_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark phrases, and the items they come from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark_contamination(docs, _table(spark, sf_dir, "benchmark"), out="f")
    hit = F.aggregate("f.spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    out = found.select("doc_id", F.col("f.n_words").alias("n_words"), hit.alias("n_hit"), F.col("f.items").alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_NEAR_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format(_LOW.format('text'))} AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), near AS (
    SELECT a, b FROM links JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@register(_NEAR_SQL)
def op8_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("digest", "component")


_MIX_SQL = r"""
WITH s AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
    SELECT source, sum(size)::DOUBLE AS source_size FROM s GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight, sum(source_size) OVER () * 150 / 100 AS total FROM per
), line AS (
    SELECT *, total - (sum(2 * source_size) OVER o - 2 * source_size) AS rest, sum(weight) OVER () - (sum(weight) OVER o - weight) AS ws
    FROM w WINDOW o AS (ORDER BY CASE WHEN source_size > 0 THEN weight / source_size ELSE 'inf'::DOUBLE END DESC, source NULLS FIRST, source_size ROWS UNBOUNDED PRECEDING)
), capped AS (
    SELECT *, rest * weight >= 2 * source_size * ws AS cap FROM line
), rate AS (
    SELECT (any_value(total) - coalesce(sum(2 * source_size) FILTER (cap), 0)) / (sum(weight) - coalesce(sum(weight) FILTER (cap), 0)) AS rate FROM capped
), aim AS (
    SELECT source, source_size::BIGINT AS source_size, CASE WHEN cap THEN 2 * source_size ELSE least(rate * weight, 2 * source_size) END AS target FROM capped, rate
), steps AS (
    SELECT s.doc_id, s.source, size, aim.source_size, target, md5(s.doc_id::VARCHAR) AS h,
        CASE WHEN aim.source_size > 0 THEN round(target / aim.source_size * 1000000)::BIGINT ELSE 0 END AS step,
        length(bin(size + 1)) * 4 + (((size + 1) * 4) >> (length(bin(size + 1)) - 1)::BIGINT) - 4 AS class
    FROM s JOIN aim ON s.source IS NOT DISTINCT FROM aim.source
), sums AS (
    SELECT *, floor(('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 1000000)::BIGINT
        + sum(step) OVER (PARTITION BY source ORDER BY class, ('0x' || substr(h, 1, 4))::BIGINT * 64 // 65536, size, h ROWS UNBOUNDED PRECEDING) AS upto
    FROM steps
)
SELECT doc_id, size, source_size, target, ((upto // 1000000 - (upto - step) // 1000000) * size)::BIGINT AS taken FROM sums
"""


@register(_MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the rows whose crc32(doc_id) mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    score = toxicity.toxicity_score(F.col("text"), net, spark)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int")
    )


@register()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the rows whose crc32(doc_id) mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    score = quality.quality_score(F.col("text"), model, spark)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_URL_SQL = rf"""
WITH p AS (
    SELECT page_id, coalesce({_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), r (r_host, r_path, r_verdict) AS (
    VALUES {', '.join(str(r) for r in RULES)}
), hits AS (
    SELECT page_id, r_host || r_path AS rule, r_verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS nth
    FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT p.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM p LEFT JOIN hits ON hits.page_id = p.page_id AND nth = 1
"""


@register(_URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that each page's URL falls under, and its verdict."""
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, RULES))


@register()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether it is kept."""
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register()
def op3_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under a bigram model learnt from those that are not held out."""
    return score_texts(_table(spark, sf_dir, "documents"))


@register()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of secrets in all documents with the forest's verdict; the values themselves stay out of the result."""
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


# CRC-32, polynomial 0xEDB88320, of the ASCII text `conv_id:turn`
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ascii(x)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))))"""

# the integers' order is that of (cost, letters), which a pair of columns says as well
_REPAIR_SQL = rf"""
WITH RECURSIVE given AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC} % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT c, turn, role AS by_role, md5(text) AS by_text, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM given
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, by_role, by_text, copy) AS i,
        regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS body FROM damaged
), faults AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY c, role, text) THEN 'duplicate'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), r AS (
    SELECT c, i, turn, role, text, left(role, 1) AS initial, fault, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS broken,
        i > 1 AND lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM faults
), step (state, follow, named) AS (
    VALUES ('-', 'u', 'user:'), ('s', 'u', 'user:'), ('u', 'a', 'assistant:'), ('a', 'u', 'user:')
), way AS (
    SELECT c, 0::BIGINT AS i, '-' AS state, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS body FROM (SELECT DISTINCT c FROM given)
    UNION ALL
    SELECT c, i, state, cost, audit, body FROM (
        SELECT *, row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) AS nth FROM (
            SELECT p.c, r.i, unnest(CASE
                    WHEN gone THEN [{{'state': p.state, 'cost': p.cost + 2, 'audit': p.audit || 'D', 'body': p.body}}]
                    ELSE [
                        {{'state': p.state, 'cost': p.cost + 2, 'audit': p.audit || 'D', 'body': p.body}},
                        {{'state': n.follow, 'cost': p.cost + 1 + broken, 'audit': p.audit || 'R', 'body': coalesce(p.body || chr(10), '') || named || text}},
                        {{'state': CASE WHEN initial = n.follow THEN n.follow WHEN initial = 's' AND p.state = '-' THEN 's' END, 'cost': p.cost + broken,
                         'audit': p.audit || 'K', 'body': coalesce(p.body || chr(10), '') || role || ':' || text}}
                    ] END, recursive := true)
            FROM (
                SELECT c, i, state, cost, audit, body FROM way
                UNION ALL
                SELECT c, i, follow, cost + 5, audit || 'I', coalesce(body || chr(10), '') || named FROM way JOIN step USING (state)
            ) p JOIN r ON r.c = p.c AND r.i = p.i + 1 JOIN step n ON n.state = p.state
        ) WHERE state IS NOT NULL
    ) WHERE nth = 1
), n AS (
    SELECT g.c, any_value(g.conv_id) AS conv_id, coalesce(max(r.i), 0) AS n FROM (SELECT DISTINCT c, conv_id FROM given) g LEFT JOIN r USING (c) GROUP BY g.c
), best AS (
    SELECT w.c, row_number() OVER (PARTITION BY w.c ORDER BY cost + CASE state WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END) AS nth,
        cost + CASE state WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END AS cost, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
        body || CASE state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END AS body
    FROM way w JOIN n ON n.c = w.c AND n.n = w.i
), facts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY c
)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, best.cost, best.audit, sha256(coalesce(best.body, '')) AS repaired_sha256
FROM n JOIN best ON best.c = n.c AND best.nth = 1 LEFT JOIN facts ON facts.c = n.c
"""


@register(_REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair_conversations(_table(spark, sf_dir, "conversations"), damage)


@register()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from the rows whose crc32(doc_id) mod 5 is not 0."""
    docs = _table(spark, sf_dir, "documents")
    net = langid.fit(docs)
    found = docs.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), langid.predict_language(F.col("text"), net, spark).alias("f"))
    return found.select("doc_id", "held_out", "f.lang_pred", "f.score")


_RANK_SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), size AS (
    SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d
), tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), weight AS (
    SELECT term, floor(1000 * ln((2 * size.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, size.n
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * size.n) // size.l))))::BIGINT AS score
    FROM q JOIN weight USING (term) JOIN tf USING (term), size GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@register(_RANK_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
