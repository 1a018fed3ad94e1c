"""Tokens, stop words and stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are never indexed.
STOP_WORDS = (
    "and are also can may might more than get let have but would should could must has had his her him she himself herself "
    "for how if in into is it no not of on or such too that the them their then there these they this which was what when where "
    "who why will with were you your http https www com org edu gov html htm"
).split()

TOKEN = "^[a-z]{3,}$"


def raw_tokens(text: Column) -> Column:
    """Lower-cased text split at runs of anything but ASCII letters, digits and underscores; without empty strings."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


def is_token(word: Column) -> Column:
    """Whether a lower-case word is indexed."""
    return (F.length(word) >= 3) & ~word.isin(*STOP_WORDS) & word.rlike(TOKEN)


def exploded_tokens(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """One row for each indexed word: the columns ``keep`` and ``word``. Words are filtered as rows, in compiled code."""
    rows = df.select(*keep, F.explode(F.split(F.lower(text), r"\W+")).alias("word"))
    return rows.where(is_token(F.col("word")))


def tokens(text: Column) -> Column:
    """The words of a text that are indexed: three or more letters a-z, no stop words."""
    return F.filter(F.split(F.lower(text), r"\W+"), is_token)


def token_count(text: Column) -> Column:
    """Number of indexed words of a text; 0 for null."""
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("bigint")


_VOWELS = frozenset("aeiou")
# Fixed values of the 1980 paper: suffix -> replacement, longest suffix first where one ends another.
_STEP2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    """One letter c or v for each letter of a word; y is a vowel behind a consonant."""
    out: list[str] = []
    for i, x in enumerate(word):
        vowel = x in _VOWELS or (x == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """The number of vowel-consonant sequences of a stem."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    for end, new in table:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """Porter's stem of a lower-case word, with the later rules bli -> ble and logi -> log; words of one or two letters stay."""
    if len(word) < 3:
        return word
    # plurals and participles
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end) and _has_vowel(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # double suffixes, then -full, -ness etc.
    word = _swap(_swap(word, _STEP2), _STEP3)
    # single suffixes of long words
    for end in _STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    # a final e, a double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


def with_stems(df: DataFrame, column: str = "word") -> DataFrame:
    """``df`` with ``column`` replaced by its stem, a batch of words at a time and each distinct word of a batch once."""
    return df.withColumn(column, stem_udf(F.col(column)))
