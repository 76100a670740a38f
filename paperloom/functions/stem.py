"""Porter's stemmer (1980) for English words, and as a column over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The paper's suffixes: fixed values.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_PAIRS = [sorted((x.split(":") for x in step.split()), key=lambda x: -len(x[0])) for step in (STEP2, STEP3)]
_ENDS = sorted(STEP4.split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in stem:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """It ends consonant, vowel, consonant, the last being none of w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word; words under 3 letters and those with other signs than a to z stay as they are."""
    if not re.fullmatch("[a-z]{3,64}", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = next((e for e in ("eed", "ed", "ing") if word.endswith(e)), "")
    stem = word[: len(word) - len(cut)]
    if cut == "eed":
        word = word[:-1] if _measure(stem) else word
    elif cut and "v" in _shape(stem):
        if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short(stem)):
            word = stem + "e"
        else:
            word = stem[:-1] if _double(stem) and stem[-1] not in "lsz" else stem
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pairs in _PAIRS:
        end, new = next((p for p in pairs if word.endswith(p[0])), ("", ""))
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + new
    end = next((e for e in _ENDS if word.endswith(e)), "")
    stem = word[: len(word) - len(end)]
    if end and _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(token: Column) -> Column:
    """Stems of a column of lower-case tokens; null stays null."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(porter, na_action="ignore")

    return run(token)
