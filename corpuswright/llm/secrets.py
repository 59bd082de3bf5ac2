"""Secret scan: candidates by form, false positives removed by a random forest, with DataFrame functions only.

A candidate is a run of `LEAST_LENGTH` or more letters, digits and `_+/-` with a digit in it (and up to two `=` behind, if
nothing more of a run follows). A word may hold any number of them, at any place. The forest sees the run's length, its shares of character classes and their transitions, how much of
it dictionary words cover, whether it lies in a path or an address, and the words around it. It is trained from labelled
findings: a table of findings with a verdict. Where a user has none, `weak_labels` makes them: secrets are the forms that
issuers publish and values assigned to a secret's name; false positives are placeholders and known harmless forms (UUIDs, hashes
in paths or named so, numbers, versions and dates, words with numbers). What neither or both of the rules name stays without a
label and is judged by the forest alone. As such labels rest on the name and the assignment in front of a value, the
forest does not see these two features then (`WEAK_FEATURES`).

The dictionary holds the most frequent words of the whole corpus, `DICTIONARY` at most. The training sample is bounded by
`SAMPLE` findings of each kind. Everything else covers every whole text.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..session import cut_lineage
from .rules import word_list
from .samples import learnable

LEAST_LENGTH = 12
DICTIONARY = 50_000
SAMPLE = 4_000
TREES, DEPTH, SEED = 20, 6, 17

#: fixed values: names of secrets as they stand in front of one, and the published form of access key ids
_NAMES = r"(?i)(passw|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
#: forms that issuers publish: AWS, GitHub, GitLab, Slack, Stripe, Google, JWT, Mailgun, Twilio, npm, PyPI, DigitalOcean, Shopify,
#: Hugging Face, OpenAI and Anthropic, Square, Databricks, Grafana
_ISSUED = "(^|[/+_-])(" + "|".join((
    "(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{22,}", "glpat-[A-Za-z0-9_-]{20,}",
    "xox[abeoprs]-[A-Za-z0-9-]{10,}", "xapp-[0-9]-[A-Za-z0-9-]{10,}", "[rs]k_(live|test)_[A-Za-z0-9]{16,}", "whsec_[A-Za-z0-9+/]{32,}",
    "AIza[A-Za-z0-9_-]{35}", "GOCSPX-[A-Za-z0-9_-]{28}", "eyJ[A-Za-z0-9_-]{10,}", "key-[0-9a-f]{32}", "SK[0-9a-f]{32}", "npm_[A-Za-z0-9]{36}",
    "pypi-[A-Za-z0-9_-]{50,}", "do[op]_v1_[0-9a-f]{64}", "shp(at|ca|pa|ss)_[0-9a-fA-F]{32}", "hf_[A-Za-z0-9]{30,}", "sk-[A-Za-z0-9_-]{20,}",
    "sq0(atp|csp)-[A-Za-z0-9_-]{22,}", "dapi[0-9a-f]{32}", "gls?[ac]_[A-Za-z0-9_+/-]{32,}",
)) + ")={0,2}$"
#: forms of parts joined by dots, as they stand in front of a part: JWT signature, SendGrid, Google OAuth, Vault
_ISSUED_LEAD = r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+|(^|[^A-Za-z0-9])(SG(\.[A-Za-z0-9_-]{22})?|ya29|hv[sb]))\.$"
#: harmless forms
_PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|redacted|your[_-]?|x{6,}|0{8,}|12345678|abcdefgh)"
_UUID = "^[/+_-]*[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_PATH_HASH = "/([0-9a-f]{7,}|[0-9A-F]{7,})(/|$)"
_HASH_NAME = r"(?i)(commit|revision|sha-?[0-9]+|md5|checksum|digest|etag|integrity)[^A-Za-z0-9]*$"
_PARTS = "[A-Z]{3,}|[A-Z]?[a-z]{3,}|[0-9]+|[/_+-]+"

_CHAR = r"A-Za-z0-9_+/\-"
_START = rf"(?<![{_CHAR}])(?=[A-Za-z_+/\-]*[0-9])"
_HAS_RUN = rf"{_START}[{_CHAR}]{{{LEAST_LENGTH}}}"
#: groups: what stands in front of the run in its word (all, or 32 characters or more), the run, and 64 characters behind it
_RUN = rf"(?s){_START}(?=[{_CHAR}]{{{LEAST_LENGTH}}})(?<=(^.{{0,63}}|.{{32,64}}))([{_CHAR}]{{{LEAST_LENGTH},}}(?:={{1,2}}(?![{_CHAR}=]))?)(?=(.{{0,64}}))"
#: characters of a neighbouring word that count
NEIGHBOUR = 64
_CLASSES = (("digits", "[0-9]"), ("upper", "[A-Z]"), ("lower", "[a-z]"))
FEATURES = (
    "length", "digits", "upper", "lower", "hex", "transitions", "variety", "covered", "path", "address", "named", "assigned", "quoted", "word_before", "word_after",
)
#: without those that weak labels rest on
WEAK_FEATURES = tuple(f for f in FEATURES if f not in ("named", "assigned"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, digest (of the text), word_no (from 0), value, lead (what stands in front of it in
    the word), before, after, path. One word may give several rows. `after` is the rest of the word, or the next word if no letter or
    digit is left. A long word gives each of its runs its near surroundings only, so that the work follows the length.

    Null and empty texts have none; repeated rows give their candidates as often.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")

    def near(words: Column, i: Column, end) -> Column:
        return F.coalesce(end(F.get(words, i), F.lit(NEIGHBOUR)), F.lit(""))

    def found(words: Column) -> Column:
        marked = F.transform(
            words,
            lambda w, i: F.when(
                (F.length(w) >= LEAST_LENGTH) & w.rlike("[0-9]") & w.rlike(_HAS_RUN),
                F.struct(
                    i.cast("long").alias("word_no"), w.alias("word"),
                    near(words, i - 1, F.right).alias("before"), near(words, i - 2, F.right).alias("before2"), near(words, i + 1, F.left).alias("after"),
                ),
            ),
        )
        return F.filter(marked, lambda c: c.isNotNull())

    each = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), path.alias("path"), F.explode(let(word_list(F.col(text_col)), found)).alias("c")
    )
    runs = F.arrays_zip(*(F.regexp_extract_all("c.word", F.lit(_RUN), k).alias(name) for k, name in ((1, "lead"), (2, "value"), (3, "rest"))))
    return each.select("doc_id", "digest", "c", "path", F.explode(runs).alias("r")).select(
        "doc_id", "digest", F.col("c.word_no").alias("word_no"), F.col("r.value").alias("value"), F.col("r.lead").alias("lead"),
        F.concat_ws(" ", "c.before2", "c.before").alias("before"),
        F.when(F.col("r.rest").rlike(r"[\p{L}\p{N}]"), F.col("r.rest")).otherwise(F.col("c.after")).alias("after"), "path",
    )


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three or more of a-z, lower-cased, `size` at most: a report of bounded length over all texts.

    Frequencies are taken in eighths of an octave; a step that would exceed `size` is left out, with all below it.
    """
    words = docs.select(F.explode(word_list(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    plain = words.select(F.regexp_replace(F.lower("w"), r"^[^\p{L}]+|[^\p{L}]+$", "").alias("w"), "n").where("w rlike '^[a-z]{3,}$'")
    counted = cut_lineage(plain.groupBy("w").agg(F.sum("n").alias("n")), "secrets-words")
    step = F.floor(F.log2("n") * 8).cast("int")
    rest, least = size, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        rest -= r["words"]
        if rest < 0:
            least = r["step"] + 1
            break
    return sorted(r["w"] for r in counted.where(step >= least).select("w").collect())


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    value, lead = F.col("value"), F.col("lead")
    size = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    changes = F.regexp_count(value, F.lit("(?<=[0-9])(?![0-9]|$)|(?<=[A-Z])(?![A-Z]|$)|(?<=[a-z])(?![a-z]|$)"))
    chars = F.size(F.array_distinct(F.split(value, "")))
    if words:
        # a set of constants: the work per part does not grow with the dictionary
        known = ", ".join(f"'{w}'" for w in words)
        parts = "regexp_extract_all(value, '[A-Z]?[a-z]+|[A-Z]+', 0)"
        hit = F.expr(f"aggregate(filter({parts}, p -> lower(p) in ({known})), 0, (n, p) -> n + length(p))")
        covered = F.least(F.lit(1.0), hit / size)
    else:
        covered = F.lit(0.0)
    flag = lambda c: c.cast("double")
    context = F.concat_ws(" ", "before", "lead")
    columns = {
        "length": size,
        **{name: share(pattern) for name, pattern in _CLASSES},
        "hex": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "transitions": changes / size,
        "variety": chars / size,
        "covered": covered,
        "path": flag(F.contains(value, F.lit("/")) | lead.rlike("/$") | F.col("path").rlike(r"(?i)(test|example|sample|fixture)")),
        "address": flag(lead.rlike("(@|://|[.])")),
        "named": flag(context.rlike(_NAMES)),
        "assigned": flag(_assigned()),
        "quoted": flag(lead.rlike("['\"]$")),
        "word_before": flag(F.col("before").rlike(r"^[\p{L} ,.]+$")),
        "word_after": flag(F.col("after").rlike(r"^[\p{L},.]+$")),
    }
    return found.withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()})


def _assigned() -> Column:
    return F.col("lead").rlike("[=:]['\"]?$") | F.col("before").rlike("[=:]$")


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings: secret is 1, 0 or null, where no rule or rules of both kinds hold. Placeholders are 0, issued forms 1 whatever else holds."""
    value, lead, context = F.col("value"), F.col("lead"), F.concat_ws(" ", "before", "lead")
    issued = value.rlike(_ISSUED) | lead.rlike(_ISSUED_LEAD)
    given = context.rlike(_NAMES) & _assigned()
    words_and_numbers = F.regexp_replace(value, _PARTS + "|=", "") == ""
    harmless = value.rlike(_UUID) | value.rlike(_PATH_HASH) | (value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & context.rlike(_HASH_NAME)) | words_and_numbers
    return found.withColumn(
        "secret", F.when(value.rlike(_PLACEHOLDER), 0).when(issued, 1).when(given & ~harmless, 1).when(harmless & ~given, 0).cast("int")
    )


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, word_no, value, score (share of the forest's votes), secret.

    `labelled` has value, lead, before, after, path and secret (0 or 1); if it lacks one of the two kinds, every candidate of
    the corpus gets the verdict of the other kind. Without it findings are labelled by `weak_labels`, on the rows whose crc32
    of the id is not 1 mod 3; if these lack one of the two kinds, each candidate gets its own weak label, or false
    without one. No candidates give no rows. Repeated rows repeat their findings.
    """
    found = cut_lineage(candidates(docs, id_col, text_col, path_col), "secrets-found")
    words = dictionary(docs, text_col)
    weak, features = labelled is None, FEATURES if labelled is not None else WEAK_FEATURES
    if weak:
        labelled = weak_labels(found.where(learnable(F.col("doc_id"))))
    pool = with_features(labelled.where("secret in (0, 1) and value is not null"), words)
    counts = {r["secret"]: r["n"] for r in pool.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        only = F.coalesce(F.col("secret").cast("double"), F.lit(0.0)) if weak else F.lit(float(next(iter(counts), 0)))
        return (weak_labels(found) if weak else found).select("doc_id", "word_no", "value", only.alias("score"), (only > 0.5).alias("secret"))
    # a bounded share of each kind, by a digest of the finding
    place = F.xxhash64("value", "lead", "before", "after").bitwiseAND(F.lit((1 << 30) - 1))
    limit = F.when(F.col("secret") == 1, int(min(1.0, SAMPLE / counts[1]) * (1 << 30))).otherwise(int(min(1.0, SAMPLE / counts[0]) * (1 << 30)))
    sample = cut_lineage(pool.where(place < limit).select(*(f"f_{k}" for k in features), F.col("secret").cast("double").alias("label")), "secrets-sample")
    assemble = VectorAssembler(inputCols=[f"f_{k}" for k in features], outputCol="features")
    # one partition of a bounded sample, in one order: reruns grow the same trees
    ordered = assemble.transform(sample.coalesce(1).sortWithinPartitions("label", *(f"f_{k}" for k in features)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ordered)
    votes = vector_to_array(F.col("probability"))[1]
    scored = forest.transform(assemble.transform(with_features(found, words))).withColumn("score", F.round(votes, 6))
    return scored.select("doc_id", "word_no", "value", "score", (F.col("score") >= 0.5).alias("secret"))
