"""The English stemmer of the Snowball project (Porter 2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

VOWEL = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile("[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first (and again after the second) non-vowel that follows a vowel begin."""
    special = re.match("gener|commun|arsen", w)
    m = _REGION.search(w)
    r1 = special.end() if special else m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWEL and w[1] not in VOWEL
    return len(w) > 2 and w[-3] not in VOWEL and w[-2] in VOWEL and w[-1] not in VOWEL + "wxY"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub("([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and re.search("[aeiouy]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    # 2
    for end, to in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in tuple(LI)):
                w = w[: -len(end)] + to
            break
    # 3
    for end, to in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    # 4
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of a column of token arrays; no built-in function has it."""
    return tokens.map(lambda ts: None if ts is None else [t if t is None else stem(t) for t in ts])
