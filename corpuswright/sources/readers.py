"""Readers. Dynamic keys of the input (language codes, system names) become data in a fixed schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from ..operators.directions import canonical, parse_directions
from ..operators.filters import filter_language, iso3_codes
from .files import existing, path_exists, with_file_columns, with_line_number, with_row_number
from .lang import lang_dim, lang_rows

TRANSLATION = "translation map<string,string>"
INSTRUCTION = (
    "inputs string, targets string, language string, language_code string, annotation_type string, user_id string"
)
SPLITS = ("train", "valid", "test")


def _sides(translation: Column) -> list[Column]:
    """Both entries of a two-language map, in file order."""
    langs, texts = F.map_keys(translation), F.map_values(translation)
    return [
        F.get(langs, F.lit(0)).alias("lang_a"),
        F.get(langs, F.lit(1)).alias("lang_b"),
        F.get(texts, F.lit(0)).alias("text_a"),
        F.get(texts, F.lit(1)).alias("text_b"),
    ]


def parallel_paths(root: str, directions: str | list[str], splits: tuple[str, ...] = SPLITS, suffix: str = "") -> list[str]:
    """Files of the requested directions: train and valid per unordered pair, test per direction."""
    tag = f"-{suffix}" if suffix else ""
    paths = []
    for d in parse_directions(directions):
        pair = canonical(d)
        folder = f"{root}/{pair.replace('-', '')}"
        names = {"train": f"train.{pair}{tag}.json", "valid": f"valid.{pair}.json", "test": f"test.{d}.json"}
        paths += [f"{folder}/{names[s]}" for s in splits]
    return list(dict.fromkeys(paths))


def read_parallel(
    spark: SparkSession,
    root: str,
    directions: str | list[str],
    splits: tuple[str, ...] = SPLITS,
    suffix: str = "",
) -> DataFrame:
    """(split, pair, seq, lang_a, lang_b, text_a, text_b); each file is read once, missing files are skipped."""
    paths = existing(spark, parallel_paths(root, directions, splits, suffix))
    if not paths:
        schema = "split string, pair string, seq long, lang_a string, lang_b string, text_a string, text_b string"
        return spark.createDataFrame([], schema)
    raw = with_file_columns(spark.read.schema(TRANSLATION).json(paths))
    name = r"/(train|valid|test)\.([a-z]+-[a-z]+)[^/]*\.json"
    rows = raw.select(
        F.regexp_extract("__file", name, 1).alias("split"),
        F.regexp_extract("__file", name, 2).alias("pair"),
        *_sides(F.col("translation")),
        "__file", "__offset", "__order",
    )
    return with_line_number(rows, ("split", "pair"), "seq")


def override_test(df: DataFrame, override_path: str | None, directions: str | list[str]) -> DataFrame:
    """Replace the test rows by another data set, partitioned by direction; only requested ones are read."""
    if not override_path:
        return df
    spark = df.sparkSession
    other = spark.read.schema(df.drop("split", "pair").schema.add("direction", "string")).parquet(override_path)
    wanted = other.filter(F.col("direction").isin(parse_directions(directions)))
    tests = wanted.select(F.lit("test").alias("split"), F.col("direction").alias("pair"), *df.drop("split", "pair").columns)
    return df.filter("split <> 'test'").unionByName(tests)


def read_source_text(spark: SparkSession, path: str, directions: str | list[str]) -> DataFrame:
    """A plain text file as test rows of exactly one direction, the target side empty."""
    wanted = parse_directions(directions)
    if len(wanted) != 1:
        raise ValueError("a source text file needs exactly one direction")
    src, tgt = wanted[0].split("-")
    raw = with_file_columns(spark.read.option("lineSep", "\n").text(path))
    rows = raw.select(
        F.lit(src).alias("lang_a"), F.lit(tgt).alias("lang_b"), F.col("value").alias("text_a"), F.lit("").alias("text_b"),
        "__file", "__offset", "__order",
    )
    return with_line_number(rows, (), "seq")


def _numbered(raw: DataFrame, columns: list[Column | str], numbered: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """The columns alone, or with `seq`, the row's place in its group, which may change inside a file."""
    if not numbered:
        return raw.select(*columns)
    rows = with_file_columns(raw).select(*columns, "__file", "__offset", "__order")
    return with_row_number(rows, by, "seq") if by else with_line_number(rows, by, "seq")


def read_mono_json(spark: SparkSession, paths: list[str], numbered: bool = False) -> DataFrame:
    """Translation structs whose two sides are used as monolingual texts."""
    return _numbered(spark.read.schema(TRANSLATION).json(paths), _sides(F.col("translation")), numbered)


def read_web_mono(
    spark: SparkSession, path: str, langs: list[str], fmt: str = "parquet", numbered: bool = False
) -> DataFrame:
    """(lang, raw_text) of web corpora partitioned by language; all other columns are pruned."""
    raw = spark.read.format(fmt).schema("text string, lang string").load(path).filter(F.col("lang").isin(langs))
    return _numbered(raw, ["lang", F.col("text").alias("raw_text")], numbered, ("lang",))


# Fixed value: the language whose web pairs come from another corpus.
FALLBACK_CODE = "tha_Thai"


def web_parallel_paths(path: str, directions: str | list[str], fallback: dict[str, str]) -> dict[str, str]:
    """Direction → folder: both long codes in alphabetical order, or the fallback corpus of that language."""
    code = {row[0]: row[2] for row in lang_rows()}
    paths = {}
    for d in parse_directions(directions):
        a, b = sorted(code[lang] for lang in d.split("-"))
        paths[d] = fallback[FALLBACK_CODE] if FALLBACK_CODE in (a, b) else f"{path}/{a}-{b}"
    return paths


def read_web_parallel(
    spark: SparkSession, path: str, directions: str | list[str], fallback: dict[str, str] | None = None
) -> DataFrame:
    """(direction, seq, lang_a, lang_b, text_a, text_b) of web parallel corpora.

    Every requested direction is a source of its own, so a folder asked for twice gives its rows twice.
    """
    paths = web_parallel_paths(path, directions, fallback or {})
    found = {d: p for d, p in paths.items() if path_exists(spark, p)}
    if not found:
        raise FileNotFoundError(f"no web parallel corpus under {path}")

    # a scan per source: its name is a constant and not read out of a path
    def source(direction: str, folder: str) -> DataFrame:
        raw = with_file_columns(spark.read.schema(TRANSLATION).json(folder))
        rows = raw.select(F.lit(direction).alias("direction"), *_sides(F.col("translation")), "__file", "__offset", "__order")
        return with_line_number(rows, ("direction",), "seq")

    return reduce(DataFrame.unionByName, [source(d, p) for d, p in found.items()])


def read_instructions(
    spark: SparkSession,
    path: str,
    directions: str | list[str],
    test: bool = False,
    fmt: str = "json",
    numbered: bool = False,
    per_language: bool = True,
) -> DataFrame:
    """Instruction rows in the requested languages; test rows also carry `lang`, the two-letter code.

    `numbered` adds `seq`, the row's place among the chosen rows of its language, or among all of them.
    """
    raw = filter_language(spark.read.format(fmt).schema(INSTRUCTION).load(path), directions)
    rows = _numbered(raw, [*[c.split()[0] for c in INSTRUCTION.split(", ")]], numbered, ("language_code",) if per_language else ())
    if not test:
        return rows
    dim = lang_dim(spark).select(F.col("iso3").alias("language_code"), "lang")
    return rows.join(F.broadcast(dim.filter(F.col("language_code").isin(iso3_codes(directions)))), "language_code")


def read_preferences(
    spark: SparkSession,
    path: str,
    directions: str | list[str],
    scorer: str = "xcomet_kiwi",
    systems: tuple[str, str] = ("sys1", "sys2"),
    numbered: bool = False,
) -> DataFrame:
    """Wide preference rows of `<path>/lang_pair=xx-en/`, each unordered pair read once.

    `systems` are the key prefixes of the two systems; an unknown scorer leaves NULL scores, which
    `require_scores` refuses.
    """
    pairs = list(dict.fromkeys(canonical(d) for d in parse_directions(directions)))
    schema = f"{TRANSLATION}, lang_pair string"
    raw = spark.read.schema(schema).json(path).filter(F.col("lang_pair").isin(pairs))
    get = lambda key: F.try_element_at("translation", key if isinstance(key, Column) else F.lit(key))
    both = F.split(get("language_pair"), "-")
    rows = raw.withColumn("lang_a", F.get(both, F.lit(0))).withColumn("lang_b", F.get(both, F.lit(1)))
    columns = ["lang_pair", "lang_a", "lang_b"]
    out: list[Column] = []
    for side in ("a", "b"):
        lang = F.col(f"lang_{side}")
        out.append(get(lang).alias(f"text_{side}"))
        for name, prefix in zip(("sys1", "sys2"), systems):
            out.append(get(F.concat(F.lit(f"{prefix}_"), lang)).alias(f"{name}_{side}"))
        for name, prefix in zip(("ref", "sys1", "sys2"), ("ref", *systems)):
            key = F.concat(F.lit(f"{prefix}_"), lang, F.lit(f"_{scorer}"))
            out.append(get(key).cast("double").alias(f"{name}_score_{side}"))
    human = [get("Delta").cast("double").alias("delta"), get("required_directions").alias("required_direction")]
    return _numbered(rows, [*columns, *out, *human], numbered, ("lang_pair",))


def read_shots(spark: SparkSession, folder: str, directions: str | list[str]) -> DataFrame:
    """(direction, shots): the few-shot file of every direction; a missing file is an error."""
    wanted = parse_directions(directions)
    paths = {d: f"{folder}/shots.{d}.json" for d in wanted}
    missing = [p for p in paths.values() if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"few-shot files missing: {missing}")
    raw = with_file_columns(
        spark.read.option("multiLine", True).schema("source string, target string").json(list(paths.values()))
    )
    rows = raw.withColumn("direction", F.regexp_extract("__file", r"/shots\.([a-z]+-[a-z]+)\.json", 1))
    # a handful of hand-written shots per direction
    ordered = F.sort_array(F.collect_list(F.struct("__file", "__order", "source", "target")))
    return rows.groupBy("direction").agg(
        F.transform(ordered, lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"))).alias("shots")
    )


ALIGNED_NAME = r"/test\.([a-z]+)-([a-z]+)\.([a-z]+)(?:/|$)"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(direction, lang, seg_id, text) of `test.<src>-<tgt>.<lang>` files of one root; no paths give no rows.

    Only a line feed ends a line, blank lines count. Nothing but the file's own name is read out of a path, so folders
    may be called anything.
    """
    if not paths:
        return spark.createDataFrame([], "direction string, lang string, seg_id long, text string")
    raw = with_file_columns(spark.read.option("lineSep", "\n").text(paths))
    part = lambda i: F.regexp_extract("__file", ALIGNED_NAME, i)
    rows = raw.select(
        F.concat_ws("-", part(1), part(2)).alias("direction"), part(3).alias("lang"), F.col("value").alias("text"), "__file", "__offset", "__order"
    )
    return with_line_number(rows, ("direction", "lang"), "seg_id")


def aligned_path(root: str, direction: str, lang: str) -> str:
    return f"{root}/{direction.replace('-', '')}/test.{direction}.{lang}"


def read_aligned(
    spark: SparkSession, testset: str, outputs: dict[str, str], directions: str | list[str]
) -> DataFrame:
    """(system, direction, seg_id, source, reference, hypothesis), paired by line number.

    `outputs` maps a system's name to its folder; each root is a scan of its own, so equal folder names do not meet.
    Every line of the test set stands once per named system, with a NULL hypothesis where that system has no such line
    (a shorter file, or none at all). Lines that a system has beyond the test set stay, with NULL source and reference.
    """
    wanted = parse_directions(directions)
    paths = lambda root, side: existing(spark, [aligned_path(root, d, d.split("-")[side]) for d in wanted])
    key = ["direction", "seg_id"]
    sides = [("source", F.lit(None), testset, 0), ("reference", F.lit(None), testset, 1)]
    sides += [("hypothesis", F.lit(name), root, 1) for name, root in outputs.items()]
    # all sides are lines of one table, so that a text moves once, to its place
    lines = reduce(
        DataFrame.unionByName,
        [read_lines(spark, paths(root, side)).select(F.lit(role).alias("role"), name.cast("string").alias("system"), *key, "text") for role, name, root, side in sides],
    )
    of = lambda role: F.any_value(F.when(F.col("role") == role, F.col("text")), F.lit(True)).alias(role)
    hypothesis = F.when(F.col("role") == "hypothesis", F.struct("system", F.col("text").alias("hypothesis")))
    places = lines.groupBy(*key).agg(
        of("source"), of("reference"), F.collect_list(hypothesis).alias("__own"), F.bool_or(F.col("role") != "hypothesis").alias("__expected")
    )

    def per_system(own: Column) -> Column:
        line = lambda s: F.get(F.filter(own, lambda o: o["system"] == s), F.lit(0))["hypothesis"]
        return F.array(*[F.struct(F.lit(s).alias("system"), line(F.lit(s)).alias("hypothesis")) for s in outputs])

    rows = F.when(F.col("__expected"), let(F.col("__own"), per_system)).otherwise(F.col("__own"))
    return places.select(*key, "source", "reference", F.inline(rows)).select("system", *key, "source", "reference", "hypothesis")


SCORE_LINE = r"^(.*)\tSegment (\d+)\tscore: (\S+)$"
SYSTEM_LINE = r"^(.*)\tscore: (\S+)$"


def read_segment_scores(spark: SparkSession, path: str, scorer: str) -> DataFrame:
    """(scorer, output, seg_id, score) of a scorer's text output, one line per segment."""
    lines = spark.read.option("lineSep", "\n").text(path)
    part = lambda i: F.regexp_extract("value", SCORE_LINE, i)
    return lines.filter(F.col("value").rlike(SCORE_LINE)).select(
        F.lit(scorer).alias("scorer"), part(1).alias("output"), part(2).cast("long").alias("seg_id"), part(3).cast("double").alias("score")
    )


def read_system_scores(spark: SparkSession, path: str, scorer: str) -> DataFrame:
    """(scorer, output, score): the closing line of a scorer's text output."""
    lines = spark.read.option("lineSep", "\n").text(path)
    closing = F.col("value").rlike(SYSTEM_LINE) & ~F.col("value").rlike(SCORE_LINE)
    part = lambda i: F.regexp_extract("value", SYSTEM_LINE, i)
    return lines.filter(closing).select(
        F.lit(scorer).alias("scorer"), part(1).alias("output"), part(2).cast("double").alias("score")
    )


def read_segment_scores_json(spark: SparkSession, path: str, scorer: str, field: str = "COMET") -> DataFrame:
    """The same from the JSON output: one object per run, output name → list of segments.

    Such an object cannot be split; it is as long as one test set, and every file is its own task.
    """
    raw = spark.read.option("wholetext", True).text(path)
    runs = raw.select(F.explode(F.from_json("value", f"map<string,array<struct<{field}: double>>>")).alias("output", "segments"))
    rows = runs.select("output", F.posexplode("segments").alias("seg_id", "segment"))
    return rows.select(
        F.lit(scorer).alias("scorer"), "output", F.col("seg_id").cast("long").alias("seg_id"), F.col(f"segment.{field}").alias("score")
    )
