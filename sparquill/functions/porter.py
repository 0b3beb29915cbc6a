"""The suffix stemmer of Porter (1980), with the published later changes bli to ble and logi to log.

Token arrays are stemmed inside their rows, Arrow batch by batch, each distinct word of a batch once;
no token is shuffled for it.
"""

from __future__ import annotations

import string
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules, in order; within a step the longest match decides.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: The longest suffix comes first; a word that ends in none of them is through with one test.
STEP_2, STEP_3 = (sorted(rules, key=lambda r: -len(r[0])) for rules in (STEP_2, STEP_3))
STEP_4 = sorted(STEP_4, key=lambda s: -len(s))
ENDS_2, ENDS_3, ENDS_4 = tuple(s for s, _ in STEP_2), tuple(s for s, _ in STEP_3), tuple(STEP_4)
SHAPES = str.maketrans({ch: "v" if ch in "aeiou" else "c" for ch in string.ascii_lowercase})


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    if "y" not in word and word.isascii() and word.isalpha() and word.islower():
        return word.translate(SHAPES)
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules: list[tuple[str, str]], ends: tuple[str, ...], least: int) -> str:
    if not word.endswith(ends):
        return word
    for suffix, by in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + by if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _double_end(cut) and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2, ENDS_2, 0), STEP_3, ENDS_3, 0)
    for suffix in STEP_4 if w.endswith(ENDS_4) else ():
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            if _measure(cut) > 1 and (suffix != "ion" or cut.endswith(("s", "t"))):
                w = cut
            break
    if w.endswith("e"):
        cut = w[:-1]
        if _measure(cut) > 1 or (_measure(cut) == 1 and not _short_end(cut)):
            w = cut
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def vocabulary_stems(vocabulary: DataFrame) -> DataFrame:
    """``term, stem`` for each distinct term; only all-letter terms are stemmed."""
    distinct = vocabulary.select("term").distinct()
    return distinct.withColumn("stem", F.when(F.col("term").rlike("^[a-z]+$"), stem_udf("term")).otherwise(F.col("term")))


def stem_or_self(word: str) -> str:
    """The stem of a word of the letters a-z; other terms stay."""
    return stem(word) if word.isascii() and word.isalpha() and word.islower() else word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(terms: pa.Array) -> pa.Array:
    """Arrays of terms with each term replaced by its stem."""
    coded = terms.flatten().dictionary_encode()
    stems = pa.array([stem_or_self(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(coded.indices))
