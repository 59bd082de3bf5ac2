"""The language dimension: 50 rows, fixed, therefore safe to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table

# Group, language, English name, long code, ISO-639-3 code.
LANGUAGES = """
- en English eng_Latn eng
1 da Danish dan_Latn dan
1 nl Dutch nld_Latn nld
1 de German deu_Latn deu
1 is Icelandic isl_Latn isl
1 no Norwegian nob_Latn nob
1 sv Swedish swe_Latn swe
1 af Afrikaans afr_Latn afr
2 ca Catalan cat_Latn cat
2 ro Romanian ron_Latn ron
2 gl Galician glg_Latn glg
2 it Italian ita_Latn ita
2 pt Portuguese por_Latn por
2 es Spanish spa_Latn spa
3 bg Bulgarian bul_Cyrl bul
3 mk Macedonian mkd_Cyrl mkd
3 sr Serbian srp_Cyrl srp
3 uk Ukrainian ukr_Cyrl ukr
3 ru Russian rus_Cyrl rus
4 id Indonesian ind_Latn ind
4 ms Malay zsm_Latn msa
4 th Thai tha_Thai tha
4 vi Vietnamese vie_Latn vie
4 mg Malagasy plt_Latn mlg
4 fr French fra_Latn fra
5 hu Hungarian hun_Latn hun
5 el Greek ell_Grek ell
5 cs Czech ces_Latn ces
5 pl Polish pol_Latn pol
5 lt Lithuanian lit_Latn lit
5 lv Latvian lvs_Latn lav
6 ka Georgian kat_Geor kat
6 zh Chinese zho_Hans zho
6 ja Japanese jpn_Jpan jpn
6 ko Korean kor_Hang kor
6 fi Finnish fin_Latn fin
6 et Estonian est_Latn est
7 gu Gujarati guj_Gujr guj
7 hi Hindi hin_Deva hin
7 mr Marathi mar_Deva mar
7 ne Nepali npi_Deva nep
7 ur Urdu urd_Arab urd
8 az Azerbaijani azj_Latn aze
8 kk Kazakh kaz_Cyrl kaz
8 ky Kyrgyz kir_Cyrl kir
8 tr Turkish tur_Latn tur
8 uz Uzbek uzn_Latn uzb
8 ar Arabic arb_Arab ara
8 he Hebrew heb_Hebr heb
8 fa Persian pes_Arab fas
"""

# Prompt parts in the target language (source side English).
LOCAL_PREFIX = {
    "de": "Übersetzen Sie dies vom Englischen ins Deutsche:\nEnglisch: ",
    "fr": "Traduisez ceci de l'anglais vers le français :\nAnglais: ",
    "cs": "Přeložte toto z angličtiny do češtiny:\nanglicky: ",
    "is": "Þýddu þetta úr ensku yfir á íslensku:\nEnska: ",
    "zh": "将其从英文翻译成中文：\n英语：",
    "ja": "これを英語から日本語に翻訳してください:\n英語：",
    "ru": "Переведите это с английского на русский:\nАнглийский: ",
    "uk": "Перекладіть це з англійської на українську:\nАнглійська: ",
    "ha": "Fassara wannan daga Turanci zuwa Hausa:\nTuranci: ",
}
LOCAL_SUFFIX = {
    "en": "\nEnglish:",
    "de": "\nDeutsch:",
    "fr": "\nFrançais :",
    "cs": "\nčesky:",
    "is": "\nÍslenska:",
    "zh": "\n中文：",
    "ja": "\n日本語：",
    "ru": "\nРусский:",
    "uk": "\nУкраїнська:",
    "ha": "\nHausa:",
}

LANG_SCHEMA = "lang string, name string, nllb string, iso3 string, group_id int, prefix string, suffix string"


def lang_rows() -> list[tuple]:
    """(lang, name, nllb, iso3, group_id, prefix, suffix); English has no group."""
    rows = []
    for line in LANGUAGES.strip().splitlines():
        group, lang, name, nllb, iso3 = line.split(" ")
        group_id = None if group == "-" else int(group)
        rows.append((lang, name, nllb, iso3, group_id, LOCAL_PREFIX.get(lang), LOCAL_SUFFIX.get(lang)))
    return rows


def lang_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, lang_rows(), LANG_SCHEMA)


def local_parts(spark: SparkSession) -> DataFrame:
    """Localized prompt parts; one language here has no row in `lang_dim`."""
    langs = sorted(LOCAL_PREFIX.keys() | LOCAL_SUFFIX.keys())
    rows = [(lang, LOCAL_PREFIX.get(lang), LOCAL_SUFFIX.get(lang)) for lang in langs]
    return local_table(spark, rows, "lang string, prefix string, suffix string")


def required(value: Column, what: str, key: Column) -> Column:
    """`value`, or an error naming the key when a lookup found nothing."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(key, F.lit("NULL")))))


def with_lang(df: DataFrame, lang_col: str, field: str, out: str) -> DataFrame:
    """Add one attribute of the language in `lang_col`; an unknown language is an error."""
    dim = lang_dim(df.sparkSession).select(F.col("lang").alias(lang_col), F.col(field).alias("__found"))
    joined = df.join(F.broadcast(dim), lang_col, "left")
    return joined.withColumn(out, required(F.col("__found"), field, F.col(lang_col))).drop("__found")


def lang_group(df: DataFrame, lang_col: str, out: str = "group_id") -> DataFrame:
    """Language → adapter group 1–8; English and unknown languages have none, which is an error."""
    return with_lang(df, lang_col, "group_id", out)


def nllb_pair_key(a: Column, b: Column) -> Column:
    """Config name of a web parallel corpus: both long codes in alphabetical order."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))
