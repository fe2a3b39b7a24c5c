"""Tokens, folding, stemming and query clean-up."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters without: from the Unicode decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column, diacritics: bool = True) -> Column:
    low = F.lower(text)
    return F.translate(F.regexp_replace(low, "\\p{M}+", ""), *_accents()) if diacritics else low


def tokens(text: Column, diacritics: bool = False) -> Column:
    """Words of letters and digits, case-folded; ``_`` separates."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit("")), diacritics), F.lit(WORD), F.lit(0))


def sanitize(query: Column) -> Column:
    """Words of a query with only letters, digits and ``_``, quoted and joined by OR; '' if none is left."""
    words = F.transform(F.split(F.trim(F.regexp_replace(query, "\\s+", " ")), " "), lambda w: F.regexp_replace(w, "[^\\p{L}\\p{N}_]", ""))
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def query_phrases(query: str, stem_words: bool = False) -> list[list[str]]:
    """The phrases of a query: each word's tokens.  A word counts as often as it is written."""
    out = []
    for word in query.split():
        kept = "".join(c for c in word if c.isalnum() or c == "_")
        text = "".join(c for c in unicodedata.normalize("NFD", kept.lower()) if not unicodedata.combining(c)) if stem_words else kept.lower()
        parts = [x for x in re.split(r"[\W_]+", text) if x]
        if parts:
            out.append([stem(x) for x in parts] if stem_words else parts)
    return out


# ---------------------------------------------------------------- Porter's algorithm (1980), from its published rules

_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The suffix rules of steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, rules) -> tuple[str, str] | None:
    hits = [r for r in rules if w.endswith(r[0])]
    return max(hits, key=lambda r: len(r[0])) if hits else None


def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _has_vowel(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (r := _longest(w, rules)) and _measure(w[: -len(r[0])]) > 0:
            w = w[: -len(r[0])] + r[1]
    if r := _longest(w, [(s, "") for s in _STEP4]):
        base = w[: -len(r[0])]
        if _measure(base) > 1 and (r[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stemmed_column(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with a column ``stem``."""

    @F.pandas_udf("string")
    def stems(values: pd.Series) -> pd.Series:
        return values.map(stem)

    return words.withColumn("stem", stems(column))


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """``terms`` with each term's stem; the Python function sees only the distinct vocabulary."""
    vocabulary = stemmed_column(terms.select(column).distinct(), column)
    return terms.join(vocabulary, column).withColumn(column, F.col("stem")).drop("stem")
