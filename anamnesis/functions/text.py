"""Tokenisers as column expressions: Latin words, bigrams of CJK runs, the English stemmer.

Text is put in compatibility form and lower case.  Latin words go to both
fields, ``words`` and ``bigrams``, when indexing and to ``words`` only when
querying; CJK runs give character bigrams (no dictionary is at hand offline).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import schema as S
from .stem import WHOLE, stems

# none of these scripts begins below U+1100, which spares the search for the script of other letters
_CJK = r"[\x{1100}-\x{10ffff}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; no built-in function has it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def latin_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscore, CJK apart."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _CJK, " ")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*S.STOPWORDS))


def plural_stem(t: Column) -> Column:
    """Strips plurals only: the tokeniser of the exact text baseline."""
    return F.when(t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y"))).when(
        t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes"), F.substring(t, F.lit(1), F.length(t) - 1)
    ).when(t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def plain_tokens(text: Column) -> Column:
    """Runs of two letters or digits or more of the lower-cased text, plurals stripped, without stopwords: the exact text baseline."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(runs, lambda t: (F.length(t) > 1) & ~t.isin(*S.STOPWORDS))
    return F.transform(kept, plural_stem)


def normalized(text: Column) -> Column:
    """Compatibility form, which only texts beyond ASCII need."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("^[\\x00-\\x7f]*$"), text).otherwise(nfkc(text))


def words(text: Column, stem: bool = False) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _CJK, " ")
    out = F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: (t != "") & ~t.isin(*S.STOPWORDS))
    return stems(out) if stem else out


def terms_among(tokens: Column, terms: list[str], stem: bool = False) -> Column:
    """Those of the tokens (with stem, their stems) that are one of the terms.

    A stem differs from the beginning of its word in its last two letters at most, but for the words of a list:
    only words with such a beginning are stemmed.
    """
    if not stem:
        return F.filter(tokens, lambda t: t.isin(*terms))
    heads = sorted({t[: max(1, len(t) - 3)] for t in terms})
    return stems(F.filter(tokens, lambda t: reduce(lambda a, b: a | b, (t.startswith(h) for h in heads), t.isin(*WHOLE))))


def script_runs(text: Column) -> Column:
    """Maximal runs of Han, of Kana and Hangul, and of all else but white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{IsHan}+|[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+)"), 1)


def char_bigrams(text: Column) -> Column:
    """Sliding pairs of every CJK run; a single character stays."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_CJK}+)"), 1)

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))

    return F.flatten(F.transform(runs, pairs))


def fields(text: Column, stem: bool = False) -> Column:
    """(field, term) of a text to index: Latin words in both fields, bigrams in theirs."""
    latin, pairs = words(text, stem), char_bigrams(F.lower(text))

    def tag(name: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

    return F.concat(tag("words", latin), tag("bigrams", latin), tag("bigrams", pairs))


def query_terms(text: str, stem: bool = False) -> list[tuple[str, str]]:
    """Distinct (field, term) of a query, sorted: Latin words in ``words``, bigrams in theirs; a repeated word counts once."""
    import re

    from .stem import stem as stemmed

    plain = unicodedata.normalize("NFKC", text).lower()
    cjk = "\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\u31f0-\u31ff\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\uac00-\ud7ff\U00020000-\U0003ffff"
    latin = [t for t in re.split(r"[^\w]+", re.sub(f"[{cjk}]", " ", plain)) if t and t not in S.STOPWORDS]
    out = {("words", stemmed(t) if stem else t) for t in latin}
    for run in re.findall(f"[{cjk}]+", plain):
        out |= {("bigrams", run[i : i + 2]) for i in range(max(1, len(run) - 1))}
    return sorted(out)


def config_hash(stem: bool, simplify: bool = False, version: int = 2) -> str:
    """64-bit FNV-1a of the tokeniser's settings, which a namespace pins."""
    h = 0xCBF29CE484222325
    for b in f"v{version}:t2s={str(simplify).lower()}:stem={str(stem).lower()}".encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"
