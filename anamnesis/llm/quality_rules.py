"""Quality rules: line-first cleaning.

Each line is judged on its own by navigation, punctuation and boilerplate
rules; failing lines go, and a document that loses more than ``max_loss`` of
its characters goes as a whole.  Everything is a JVM-side expression over one
row: no shuffle, no Python.  Lines and their judgement are each made behind a
generator of one element, which no later filter or projection repeats.

A line passes if it has fewer than two bars, few symbols, few capitals, no
boilerplate phrase (lines under ``SHORT`` characters only: a long paragraph may
mention one), words that repeat little, and a last word that ends a sentence in
any script (terminal punctuation or a closing quote or bracket), holds a digit
or an @ (an identifier), or ends in a letter of a script that writes no full
stops (Thai, Lao, Tibetan, Burmese, Khmer).  Scripts without case can't break
the rule on capitals.

Defined cases: lines are trimmed and blank lines neither kept nor counted as a
loss; null, empty or blank texts have nothing to keep and are rejected; equal
rows get equal results, one each; an empty table gives an empty result; columns
other than doc_id and text are carried, never read, and their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_LOSS = 0.5
SHORT = 120
SYMBOLS = r"[#$%&*<>{}~^=_@|\\]"
UPPER = "[A-ZÀ-ÖØ-Þ]"
TERMINAL = ".!?:;…‥。．！？；：।॥۔؟؛։።፧᙮᠃‼⁇⁈⁉"
CLOSING = "\"')»”’›」』）】》〉\\]"
UNSTOPPED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff"
ENDING = f"[0-9@]|[{TERMINAL}][{CLOSING}]*$|[{CLOSING}{UNSTOPPED}]$"
BOILERPLATE = (
    "(all rights reserved|licensed under|released under the|this work is licensed|cookie|privacy policy"
    "|terms of (use|service)|click here|subscribe|sign (in|up)|log ?in|javascript|lorem ipsum)"
)


def line_passes(line: Column) -> Column:
    """True if the trimmed, non-blank line breaks no rule."""
    size = F.length(line)
    words = F.split(line, " ")
    return (
        F.substring_index(line, " ", -1).rlike(ENDING)
        & (size - F.length(F.replace(line, F.lit("|"), F.lit(""))) < 2)
        & ((size >= SHORT) | ~F.lower(line).rlike(BOILERPLATE))
        & (size - F.length(F.regexp_replace(line, SYMBOLS, "")) < 0.08 * size + 1)
        & ((size < 10) | (size - F.length(F.regexp_replace(line, UPPER, "")) < 0.4 * size))
        & ((F.size(words) < 8) | (F.size(F.array_distinct(words)) >= 0.4 * F.size(words)))
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, whatever is later done with it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def judged(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """row (all columns of docs) and q: text (cleaned), n_lines, n_removed, n_kept_chars, keep."""
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("raw"))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    step = once(once(own, "lines", lines).drop("raw"), "kept", F.filter("lines", line_passes))
    size, left = F.length(F.array_join("lines", "")), F.length(F.array_join("kept", ""))
    return step.select(
        "row",
        F.struct(
            F.array_join("kept", "\n").alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
            left.cast("long").alias("n_kept_chars"),
            ((left > 0) & (left >= (1 - max_loss) * size)).alias("keep"),
        ).alias("q"),
    )


def quality_rules(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_kept_chars, keep, text (of the lines kept)."""
    q = judged(docs.select(docs["doc_id"], docs["text"]), max_loss)
    return q.select("row.doc_id", "q.n_lines", "q.n_removed", "q.n_kept_chars", "q.keep", "q.text")


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that pass, with their other columns; text is what the rules leave, n_chars its length."""
    q = judged(docs, max_loss).where("q.keep")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("q.text")
        if c == "n_chars":
            return F.length("q.text").cast(docs.schema[c].dataType).alias(c)
        return F.col("row")[c].alias(c)

    return q.select(*(column(c) for c in docs.columns))


SQL = f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents),
k AS (
  SELECT doc_id, lines, list_filter(lines, lambda l:
    regexp_matches(regexp_extract(l, '[^ ]*$'), '{ENDING.replace("'", "''")}')
    AND length(l) - length(replace(l, '|', '')) < 2
    AND (length(l) >= {SHORT} OR NOT regexp_matches(lower(l), '{BOILERPLATE}'))
    AND length(l) - length(regexp_replace(l, '{SYMBOLS}', '', 'g')) < 0.08 * length(l) + 1
    AND (length(l) < 10 OR length(l) - length(regexp_replace(l, '{UPPER}', '', 'g')) < 0.4 * length(l))
    AND (len(string_split(l, ' ')) < 8 OR len(list_distinct(string_split(l, ' '))) >= 0.4 * len(string_split(l, ' ')))) AS kept FROM s),
c AS (SELECT *, length(array_to_string(lines, '')) AS size, length(array_to_string(kept, '')) AS n FROM k)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed, n::BIGINT AS n_kept_chars,
  n > 0 AND n >= {1 - MAX_LOSS} * size AS keep, array_to_string(kept, chr(10)) AS text FROM c
"""
