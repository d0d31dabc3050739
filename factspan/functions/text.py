"""Scalar text functions as column expressions (survey P1-P5, P8, P9, P14, 2.16)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and marks of the sentence and unit rules.
LETTER = r"[\p{L}\p{N}\p{M}]"
ENDS = "。！？!?"
CLOSERS = "」』）)】〕］]”\"'’"
OPEN_BRACKETS = "「『（(【〔［["
CLOSE_BRACKETS = "」』）)】〕］]"
ARM_PARTICLES = ("が", "を", "に", "で", "と", "へ")
ATTRIBUTION = r"\((?:reported|said) by .*\)\s*$"
KANA, HAN = r"[ぁ-んァ-ヶー]", r"[㐀-䶿一-鿿]"
JAPANESE = r"[぀-ヿ一-鿿]"
LATIN_WORD = r"[A-Za-zＡ-Ｚａ-ｚ][A-Za-z0-9Ａ-Ｚａ-ｚ０-９.+#_-]*"


def has_letter(c: Column) -> Column:
    """Does the text hold a letter, number or mark?"""
    return c.rlike(LETTER)


def is_kana_unit(c: Column) -> Column:
    """P2 for single characters: hiragana alone."""
    return c.rlike("^[\\u3040-\\u309f]+$")


def strip_attribution(c: Column) -> Column:
    """The claim without a trailing (reported by ...) or (said by ...)."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ATTRIBUTION, ""))


def detect_script(c: Column) -> Column:
    """Ja, zh, en or latin; Latin counts words, the rest characters."""
    c = F.coalesce(c, F.lit(""))
    count = lambda p: F.regexp_count(c, F.lit(p))
    japanese = count(JAPANESE)
    latin = count(LATIN_WORD)
    chinese = (count(HAN) >= 6) & ~c.rlike(KANA)
    return F.when(japanese > latin, F.when(chinese, "zh").otherwise("ja")).when(latin == 0, "latin").otherwise("en")


def is_base(kind: Column) -> Column:
    """P5."""
    return kind == "base"


def cut_inside_word(text: Column, start: Column) -> Column:
    """Does a word character stand right before the 1-based start?"""
    return (start > 1) & F.substring(text, start - 1, F.lit(1)).rlike(r"[\p{L}\p{N}_.\-・]")


def same_sentence(a: Column, b: Column) -> Column:
    """Equal as written but for a final full stop."""
    bare = lambda c: F.regexp_replace(F.trim(c), "[。.]$", "")
    return bare(a) == bare(b)


def shown(c: Column, closed: tuple[str, ...] = ()) -> Column:
    """A value of a closed list as it is, anything else as digest and length."""
    hidden = F.concat(F.lit("str:"), F.substring(F.sha2(c, 256), 1, 8), F.lit("/"), F.length(c).cast("string"))
    return F.when(c.isin(*closed), c).otherwise(hidden) if closed else hidden


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def answer_form(texts: pd.Series) -> pd.Series:
    """NFKC and case folding: two answers are one if their forms are equal."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold().strip(), na_action="ignore")


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)
