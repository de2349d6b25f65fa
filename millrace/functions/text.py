"""Text normalization and trainability as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal the reference's for right results.
FOLD = {
    "‘": "'", "’": "'", "‛": "'", "ʼ": "'",
    "“": '"', "”": '"',
    "–": "-", "—": "-", "‒": "-", "−": "-",
    " ": " ",
    "​": "", "‌": "", "‍": "",
}
HOMOGLYPHS = {
    "ԑ": "ɛ", "ↄ": "ɔ", "ǝ": "ə", "ε": "ɛ", "ϵ": "ɛ", "ο": "o",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
}
PUNCTUATION = "!\"(),.:;?[]{}«»…·•*/\\|_=+<>@#$%^&~`"

_WORD = r"[\p{L}\p{N}_]"
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _translate(text: Column, table: dict[str, str]) -> Column:
    """Characters that map to nothing come last, where translate() deletes them."""
    ordered = sorted(table.items(), key=lambda kv: kv[1] == "")
    return F.translate(text, "".join(k for k, _ in ordered), "".join(v for _, v in ordered))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which Spark lacks."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The NFC form. Characters below U+0300 are composed as they stand, so only other texts are sent to Python."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def normalize(text: Column, keep_apostrophe: bool = True, compose: bool = True) -> Column:
    """compose=False leaves out the one step that needs Python, for texts known to be composed already."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(_translate(composed(text) if compose else text, FOLD))
    text = _translate(text, HOMOGLYPHS)
    text = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    if not keep_apostrophe:
        text = F.translate(text, "'", " ")
    text = F.regexp_replace(text, rf"(?<!{_WORD})[-']|[-'](?!{_WORD})", " ")
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def has_digits(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{Nd}")


def is_trainable(text: Column, normal: Column, min_chars: int = 2) -> Column:
    """normal: the text's normalized form, computed once by the caller."""
    return ~has_digits(text) & (F.length(normal) >= min_chars) & normal.rlike(r"\p{L}")


def characters(normal: Column) -> Column:
    """Array of the single characters of a normalized text, spaces left out."""
    return F.filter(F.split(normal, ""), lambda c: (c != "") & (c != " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def casing(text: Column) -> Column:
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    return (
        F.when(letters == "", "no-letters")
        .when(letters == F.upper(letters), "ALL CAPS")
        .when(letters == F.lower(letters), "all lower")
        .otherwise("Mixed")
    )
