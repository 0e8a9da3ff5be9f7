"""Text operators as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Phrases of an answer that says it does not know.
UNKNOWING = ("i don't know", "i do not know", "i don't have", "i do not have", "not in context", "not mentioned", "not available")
BLANK = "[ \\t\\n\\r\\f\\x0B]"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def normal_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, blanks collapsed."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, f"{BLANK}+", " "))


def answer_tokens(text: Column) -> Column:
    """Words of the normalised answer; [] for empty and null."""
    return F.filter(F.split(normal_answer(text), " "), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct blank-separated words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{BLANK}+"), lambda w: w != ""))


def unknowing(text: Column) -> Column:
    """Whether an answer says that it does not know."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for phrase in UNKNOWING:
        out = out | F.contains(low, F.lit(phrase))
    return out


def verdict(text: Column) -> Column:
    """1 for an answer that starts with yes, else 0."""
    return F.when(F.startswith(F.lower(F.trim(text)), F.lit("yes")), 1).otherwise(0)


def judged(raw: Column) -> Column:
    """``match`` of a judge's JSON, with or without a code fence; anything else is false."""
    bare = F.trim(F.regexp_replace(F.trim(raw), "^```(?:json)?\\s*|\\s*```$", ""))
    value = F.lower(F.get_json_object(bare, "$.match"))
    return F.coalesce(value == "true", F.lit(False))


def shortened(text: Column, width: int = 80) -> Column:
    """One line of at most ``width`` characters."""
    line = F.trim(F.regexp_replace(text, "\\n", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def bullets(text: Column) -> Column:
    """Items of a bulleted list; without bullets, the short non-empty lines."""
    lines = F.split(text, "\\r?\\n")
    mark = "^\\s*[-*•]\\s*(.+?)\\s*$"
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, '^"+|"+$', ""), "^'+|'+$", "")
    marked = F.filter(F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(mark))), lambda x: bare(F.trim(F.regexp_extract(x, mark, 1)))), lambda x: x != "")
    plain = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 200)), bare)
    return F.when(F.size(marked) > 0, marked).otherwise(plain)


def windows(text: Column, size: int = 1000, overlap: int = 120) -> Column:
    """Start (0-based) and text of the windows over a long text; one window for a short one."""
    step = size - overlap
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - overlap - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by blanks; [] for shorter texts."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each place of ``a``, cleared where a match grows."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, over Arrow batches."""

    @F.pandas_udf("int")
    def length(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_common_length(list(x), list(y)) for x, y in zip(xs, ys)], dtype="int32")

    return length(a, b)
