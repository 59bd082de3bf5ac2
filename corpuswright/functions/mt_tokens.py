"""Tokenization of the corpus BLEU metric (public mteval-13a and zh definitions) as regex chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_split, py_strip

# Entity replacements and split rules of the metric, in order.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", 1),
    (r"([^0-9])([\.,])", 2),
    (r"([\.,])([^0-9])", 3),
    (r"([0-9])(-)", 2),
]
REPLACEMENTS = {1: (" ", 1, " "), 2: (1, " ", 2, " "), 3: (" ", 1, " ", 2)}
# Code point ranges that the zh tokenizer isolates.
CJK = (
    r"\x{3400}-\x{4db5}\x{4e00}-\x{9fa5}\x{9fa6}-\x{9fbb}\x{f900}-\x{fa2d}\x{fa30}-\x{fa6a}\x{fa70}-\x{fad9}"
    r"\x{2001}-\x{2a6d}\x{2f81}-\x{2fa1}\x{ff00}-\x{ffef}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{31c0}-\x{31ef}"
    r"\x{2f00}-\x{2fdf}\x{2ff0}-\x{2fff}\x{3100}-\x{312f}\x{31a0}-\x{31bf}\x{fe10}-\x{fe1f}\x{fe30}-\x{fe4f}"
    r"\x{2600}-\x{26ff}\x{2700}-\x{27bf}\x{3200}-\x{32ff}\x{3300}-\x{33ff}"
)


def replacement(kind: int, mark: str) -> str:
    """A rule's replacement with group references in the given engine's notation."""
    return "".join(part if isinstance(part, str) else f"{mark}{part}" for part in REPLACEMENTS[kind])


#: the rules without the space in the first one's class: a space more beside a space changes no word, and most matches are spaces
_SPACED = [(RULES[0][0].replace(" -", "!-"), RULES[0][1]), *RULES[1:]]


def _rules(c: Column) -> Column:
    for pattern, kind in _SPACED:
        c = F.regexp_replace(c, pattern, replacement(kind, "$"))
    return c


def _plain_13a(c: Column) -> Column:
    c = F.replace(c, F.lit("<skipped>"), F.lit(""))
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def tokenize_13a(c: Column) -> Column:
    """Words of the default tokenizer."""
    return py_split(_rules(F.concat(F.lit(" "), _plain_13a(c), F.lit(" "))))


def _spaced_zh(c: Column) -> Column:
    return _rules(F.regexp_replace(py_strip(c), f"([{CJK}])", " $1 "))


def tokenize_zh(c: Column) -> Column:
    """Chinese characters one by one, the rest by the default rules."""
    return py_split(_spaced_zh(c))


# Fixed value: the tokenizer of Japanese targets, a morphological one that is not available.
NO_TOKENIZER = "ja-mecab"


def tokenizer_for(target: Column) -> Column:
    """Tokenizer name of a target language."""
    return F.when(target == "zh", F.lit("zh")).when(target == "ja", F.lit(NO_TOKENIZER)).otherwise(F.lit("13a"))


def tokenize(c: Column, target: Column) -> Column:
    """Tokens by target language; NULL where the tokenizer is not available."""
    return F.when(target == "zh", tokenize_zh(c)).when(target != "ja", tokenize_13a(c))


def for_grams(c: Column, target: Column) -> Column:
    """What `functions/ngrams.py` counts; NULL where the tokenizer is not available. Only Chinese has its rules applied."""
    return F.when(target == "zh", _spaced_zh(c)).when(target != "ja", _plain_13a(c))


def cut_by_grams(target: Column) -> Column:
    """Whether the 13a rules are left to `functions/ngrams.py`."""
    return target != "zh"
