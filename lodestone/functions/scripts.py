"""Presentation forms, reversed text and OCR noise; Arrow functions only where no built-in expression exists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import LETTERS_FROM, LETTERS_TO, char_share

#: Fixed: the blocks of Arabic presentation forms.
PRESENTATION = "[ﭐ-﷿ﹰ-ﻼ]"
NOISE = "[■□▪▫●○◆◇★☆�]"


@F.pandas_udf(T.StringType())
def compatible_form(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no expression for."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text])


def unify_letters(text: str | Column) -> Column:
    """NFKC and one form of each letter."""
    return F.translate(compatible_form(text), LETTERS_FROM, LETTERS_TO)


def has_presentation_forms(text: str | Column, least: float = 0.3) -> Column:
    """Whether a text looks reversed: a share of presentation forms above the threshold."""
    return char_share(text, PRESENTATION) > least


def reverse_words(text: str | Column) -> Column:
    """Words in reverse order, letters as they are."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.reverse(F.split(c, " ")), " ")


def reverse_letters(text: str | Column) -> Column:
    """Words in reverse order and letters reversed, but for numbers and separators."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.reverse(F.split(c, " ")), lambda w: F.when(w.rlike(r"^[0-9۰-۹.,/:%-]+$"), w).otherwise(F.reverse(w))), " ")


def clean_ocr(text: str | Column) -> Column:
    """Noise characters and tokens of marks only removed, at most one blank line in a row."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, NOISE, "")
    c = F.regexp_replace(c, r"(?m)(?<![^\s])[^\p{L}\p{N}\s]{3,}(?![^\s])", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n\s*(?:\n\s*)+", "\n\n")


def keyboard_similarity(a: str | Column, b: str | Column) -> Column:
    """Edit similarity with letters that lie side by side or sound alike folded into one."""
    fold = lambda c: F.translate(F.lower(F.col(c) if isinstance(c, str) else c), "qwdsfgvbcxzykpmtj", "aaeersssccciqbndg")
    x, y = fold(a), fold(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)
