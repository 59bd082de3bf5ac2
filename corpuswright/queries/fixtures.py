"""Domain shapes derived from the given tables, once for Spark and once as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.rand import uniform
from ..functions.text import PY_SPACE
from ..operators.vocab import Specials, Vocabulary, load_vocabulary
from ..sources.lang import LOCAL_PREFIX, LOCAL_SUFFIX, lang_rows

SEED = 42
DIRECTIONS = ["de-en", "en-de", "fr-en", "en-es"]
VOCAB_SIZE = 1000
SPECIALS = Specials()
VOCAB_LEN = SPECIALS.first_word + VOCAB_SIZE


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- Spark side -------------------------------------------------------------------------------------------


def mono(spark: SparkSession, sf: str) -> DataFrame:
    """Monolingual texts: every document."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("raw_text"))
    # one row group is one task: the texts of a small file are dealt out for the work on them
    return docs.repartition("doc_id")


def parallel(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel rows xx-en: neighbouring documents of which exactly one is English, whole texts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    # only one side is dealt out here: the join deals the other, and a text would move for either
    a = docs.repartition("doc_id").select(F.col("doc_id").alias("seq"), F.col("lang").alias("la"), F.col("text").alias("ta"))
    b = docs.select((F.col("doc_id") - 1).alias("seq"), F.col("lang").alias("lb"), F.col("text").alias("tb"))
    pairs = a.join(b, "seq").filter((F.col("la") == "en") != (F.col("lb") == "en"))
    flip = F.col("la") == "en"
    return pairs.select(
        "seq",
        F.when(flip, F.col("lb")).otherwise(F.col("la")).alias("lang_a"),
        F.lit("en").alias("lang_b"),
        F.when(flip, F.col("tb")).otherwise(F.col("ta")).alias("text_a"),
        F.when(flip, F.col("ta")).otherwise(F.col("tb")).alias("text_b"),
    )


def instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Instruction rows: a user turn followed by an assistant turn of the same conversation."""
    conv = table(spark, sf, "conversations")
    user = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("inputs"))
    answer = conv.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("targets")
    )
    codes = F.array(*[F.lit(c) for c in ("deu", "eng", "fra", "jpn")])
    return user.join(answer, ["conv_id", "turn"]).withColumn(
        "language_code", F.get(codes, (F.col("conv_id") % 4).cast("int"))
    )


SYSTEMS = ("sysA", "sysB", "sysC")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """(system, direction, seg_id, source, reference, hypothesis) with English as the target."""
    return aligned_of(parallel(spark, sf))


def aligned_of(pairs: DataFrame, *more: str) -> DataFrame:
    """The aligned rows of given parallel rows, with some more of their columns."""
    return answered(segments_of(pairs, *more))


def segments_of(pairs: DataFrame, *more: str) -> DataFrame:
    """(direction, seg_id, source, reference) of given parallel rows, with some more of their columns."""
    return pairs.select(
        *more,
        F.concat(F.col("lang_a"), F.lit("-en")).alias("direction"),
        F.col("seq").alias("seg_id"),
        F.col("text_a").alias("source"),
        F.col("text_b").alias("reference"),
    )


def answered(segments: DataFrame) -> DataFrame:
    """A row for each system's output of a segment: system, hypothesis."""
    outputs = F.array(
        F.struct(F.lit("sysA").alias("system"), _drop_fifth(F.col("reference")).alias("hypothesis")),
        F.struct(F.lit("sysB").alias("system"), F.lower("reference").alias("hypothesis")),
        F.struct(F.lit("sysC").alias("system"), F.col("reference").alias("hypothesis")),
    )
    return segments.select("*", F.inline(outputs))


def _drop_fifth(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w, i: (i + 1) % 5 != 0), " ")


SCORERS = ("comet", "kiwi")


def scores(spark: SparkSession, sf: str, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """(scorer, system, direction, seg_id, score): hashed, one decimal, so ties are common."""
    seg = parallel(spark, sf).select(
        F.concat(F.col("lang_a"), F.lit("-en")).alias("direction"), F.col("seq").alias("seg_id")
    )
    keys = F.array(
        *[F.struct(F.lit(sc).alias("scorer"), F.lit(sy).alias("system")) for sc in SCORERS for sy in systems]
    )
    u = uniform(SEED, F.col("scorer"), F.col("system"), F.col("seg_id"))
    return seg.select("*", F.inline(keys)).withColumn("score", F.round(u, 1))


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Wide preference rows: both sides of a pair, two systems, scores per side, Delta, required direction."""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("seq"), (F.col("quality") - F.col("toxic")).alias("delta")
    )
    p = parallel(spark, sf).join(labels, "seq", "left")
    score = lambda system, side: F.round(
        uniform(SEED, F.lit(system), F.lit(side), F.col("seq")), 1
    )
    out = p.withColumn(
        "required_direction",
        F.when(F.col("seq") % 3 == 0, F.concat(F.col("lang_a"), F.lit("-en"))).when(F.col("seq") % 3 == 1, F.lit("")),
    )
    for side in ("a", "b"):
        text = F.col(f"text_{side}")
        out = (
            out.withColumn(f"sys1_{side}", _drop_fifth(text))
            .withColumn(f"sys2_{side}", F.lower(text))
            .withColumn(f"ref_score_{side}", score("ref", side))
            .withColumn(f"sys1_score_{side}", score("sys1", side))
            .withColumn(f"sys2_score_{side}", score("sys2", side))
        )
    return out


def vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    return load_vocabulary(mono(spark, sf), "raw_text", VOCAB_SIZE, SPECIALS)


def vocabulary_of_specials() -> Vocabulary:
    """No words: enough where only the number of tokens matters."""
    return Vocabulary([], SPECIALS, [[]])


def joined(ids: str | Column) -> Column:
    """An id array as text, the form in which arrays are compared.

    JSON writes numbers without a string of each; what holds a NULL goes the way that leaves NULLs out.
    """
    plain = lambda x: F.array_join(x.cast("array<string>"), ",")
    bare = lambda text: F.substring_index(text, "]", 1).substr(2, 2**31 - 1)
    return let(
        F.col(ids) if isinstance(ids, str) else ids,
        lambda x: let(F.to_json(x), lambda text: F.when(text.contains("null"), plain(x)).otherwise(bare(text))),
    )


# --- SQL side ---------------------------------------------------------------------------------------------


def lit(s: str) -> str:
    """A SQL string literal; line ends by chr(10) so that the text stays on one line."""
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else (str(v) if isinstance(v, int) else f"({lit(v)})")
    return ",".join("(" + ",".join(cell(v) for v in r) + ")" for r in rows)


def uniform_sql(*keys: str) -> str:
    return f"(('0x'||substr(md5({SEED}||':'||{_concat(keys)}),1,8))::BIGINT/4294967296.0::DOUBLE)"


def _concat(keys: tuple[str, ...]) -> str:
    return "||':'||".join(f"({k})" for k in keys)


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\n\\t\\r]+'), lambda w: w <> '')"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{PY_SPACE}]+|[{PY_SPACE}]+\z', '', 'g')"


def drop_fifth_sql(text: str) -> str:
    return f"array_to_string([w for w, i in string_split({text}, ' ') if i % 5 <> 0], ' ')"


def arr(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


CTES: dict[str, str] = {
    "langs": "SELECT * FROM (VALUES " + _values([r[:5] for r in lang_rows()]) + ") t(lang,name,nllb,iso3,group_id)",
    "local": "SELECT * FROM (VALUES "
    + _values([(k, LOCAL_PREFIX.get(k), LOCAL_SUFFIX.get(k)) for k in sorted(LOCAL_PREFIX.keys() | LOCAL_SUFFIX.keys())])
    + ") t(lang,prefix,suffix)",
    "dirs": "SELECT * FROM (VALUES "
    + _values([(i, d, *d.split("-")) for i, d in enumerate(DIRECTIONS)])
    + ") t(position,direction,src,tgt)",
    "mono": "SELECT doc_id, lang, text AS raw_text FROM documents",
    "parallel": """
        SELECT a.doc_id AS seq, CASE WHEN a.lang = 'en' THEN b.lang ELSE a.lang END AS lang_a, 'en' AS lang_b,
               CASE WHEN a.lang = 'en' THEN b.text ELSE a.text END AS text_a,
               CASE WHEN a.lang = 'en' THEN a.text ELSE b.text END AS text_b
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
        WHERE (a.lang = 'en') <> (b.lang = 'en')""",
    "expanded": """
        SELECT seq, 0 AS ord, lang_a AS src, lang_b AS tgt, text_a AS src_text, text_b AS tgt_text,
               lang_a||'-'||lang_b AS direction FROM parallel
        WHERE lang_a||'-'||lang_b IN (SELECT direction FROM dirs)
        UNION ALL
        SELECT seq, 1, lang_b, lang_a, text_b, text_a, lang_b||'-'||lang_a FROM parallel
        WHERE lang_b||'-'||lang_a IN (SELECT direction FROM dirs)""",
    "prompted": """
        SELECT e.*, s.name AS src_name, t.name AS tgt_name,
               'Translate this from '||s.name||' to '||t.name||':'||chr(10)||s.name||': '||src_text
               ||chr(10)||t.name||':' AS prompt
        FROM expanded e JOIN langs s ON s.lang = e.src JOIN langs t ON t.lang = e.tgt""",
    "instr": """
        SELECT u.conv_id, u.turn, u.text AS inputs, a.text AS targets,
               ['deu','eng','fra','jpn'][(u.conv_id % 4)::INT + 1] AS language_code
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "aligned": f"""
        SELECT lang_a||'-en' AS direction, seq AS seg_id, text_a AS source, text_b AS reference, system,
               CASE system WHEN 'sysA' THEN {drop_fifth_sql('text_b')} WHEN 'sysB' THEN lower(text_b)
                           ELSE text_b END AS hypothesis
        FROM parallel CROSS JOIN (VALUES ('sysA'),('sysB'),('sysC')) s(system)""",
    "scores": f"""
        SELECT lang_a||'-en' AS direction, seq AS seg_id, scorer, system,
               round({uniform_sql('scorer', 'system', 'seq')}, 1) AS score
        FROM parallel CROSS JOIN (VALUES ('sysA'),('sysB'),('sysC')) s(system)
                      CROSS JOIN (VALUES ('comet'),('kiwi')) c(scorer)""",
    "prefs": f"""
        SELECT p.*, l.quality - l.toxic AS delta,
               CASE p.seq % 3 WHEN 0 THEN lang_a||'-en' WHEN 1 THEN '' END AS required_direction,
               {drop_fifth_sql('text_a')} AS sys1_a, lower(text_a) AS sys2_a,
               {drop_fifth_sql('text_b')} AS sys1_b, lower(text_b) AS sys2_b,
               round({uniform_sql("'ref'", "'a'", 'seq')}, 1) AS ref_score_a,
               round({uniform_sql("'sys1'", "'a'", 'seq')}, 1) AS sys1_score_a,
               round({uniform_sql("'sys2'", "'a'", 'seq')}, 1) AS sys2_score_a,
               round({uniform_sql("'ref'", "'b'", 'seq')}, 1) AS ref_score_b,
               round({uniform_sql("'sys1'", "'b'", 'seq')}, 1) AS sys1_score_b,
               round({uniform_sql("'sys2'", "'b'", 'seq')}, 1) AS sys2_score_b
        FROM parallel p LEFT JOIN labels l ON l.doc_id = p.seq""",
    "vocab": f"""
        SELECT token, n, ({SPECIALS.first_word - 1} + row_number() OVER (ORDER BY n DESC, token))::INT AS id
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM documents)
              GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB_SIZE})""",
}

_NEEDS = {
    "expanded": ["parallel", "dirs"],
    "prompted": ["expanded", "langs"],
    "aligned": ["parallel"],
    "scores": ["parallel"],
    "prefs": ["parallel"],
}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """A query with the named fixtures (and what they need) in front of `body`; `extra` CTEs come last."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def encoded_ctes(out: str, src: str, keys: str, text: str) -> dict[str, str]:
    """CTEs that encode `text` of `src` by the vocabulary: `out(keys, ids)`."""
    keyed = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return {
        f"{out}_w": f"SELECT {keys}, {words_sql(text)} AS w FROM {src}",
        f"{out}_t": f"SELECT {keys}, unnest(w) AS token, generate_subscripts(w, 1) AS ix FROM {out}_w",
        f"{out}_g": f"""SELECT {keyed}, list(coalesce(v.id, {SPECIALS.unk}) ORDER BY ix) AS ids
            FROM {out}_t s LEFT JOIN vocab v ON v.token = s.token GROUP BY {keyed}""",
        out: f"""SELECT {keyed}, coalesce(g.ids, []::INT[]) AS ids
            FROM {out}_w s LEFT JOIN {out}_g g ON {' AND '.join(f's.{k.strip()} = g.{k.strip()}' for k in keys.split(','))}""",
    }


def pad_sql(ids: str, n: int | str, value: int, side: str = "right") -> str:
    fill = f"list_transform(range(greatest({n} - len({ids}), 0)), lambda z: {value}::INT)"
    return f"list_concat({fill}, {ids})" if side == "left" else f"list_concat({ids}, {fill})"


def pad_mask_sql(ids: str, n: int | str, side: str = "right") -> str:
    return pad_sql(f"list_transform({ids}, lambda z1: 1::INT)", n, 0, side)


def ones_zeros_sql(total: int | str, n: str) -> str:
    return f"list_transform(range({total}), lambda zi: CASE WHEN zi < {n} THEN 1 ELSE 0 END)"
