"""Fuzzy scores of a query against the words of a row, as Spark columns; the query's words are literals."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import fold

# Fixed values of the score ladder.
PREFIX, SHORT_PREFIX, REVERSE_PREFIX, EDITED, INITIAL = 0.95, 0.7, 0.6, 0.85, 0.7
SIMILAR_FROM, SIMILAR_BASE, SIMILAR_SLOPE = 0.45, 0.5, 0.4
LEAST_TOKEN, OTHER_FACTOR, LEAST_SCORE = 0.5, 0.9, 0.6


def query_tokens(query: str) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", query) if not 0x300 <= ord(c) <= 0x36F).lower()
    return [t for t in re.split(r"[^a-z0-9@.]+", bare) if t]


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(fold(c), "[^a-z0-9@.]+"), lambda t: t != "")


def _grams(padded: str) -> list[str]:
    return list(dict.fromkeys(padded[k : k + 3] for k in range(len(padded) - 2)))


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substring(padded, k, F.lit(3))))


def similarity(word: str, c: Column) -> Column:
    """Shared trigrams over all trigrams."""
    own = F.array(*map(F.lit, _grams(f"  {word} ")))
    return F.size(F.array_intersect(own, trigrams(c))) / F.greatest(F.size(F.array_union(own, trigrams(c))), F.lit(1))


def token_score(q: str, t: Column) -> Column:
    """How well a query word fits a word: the same, a beginning, a few edits, like trigrams."""
    edits = 2 if len(q) >= 8 else 1 if len(q) >= 4 else 0
    out = F.when(t == q, 1.0).when(t.startswith(q), PREFIX if len(q) >= 3 else SHORT_PREFIX)
    if len(q) >= 4:
        out = out.when((F.length(t) >= 3) & F.lit(q).startswith(t), REVERSE_PREFIX)
        out = out.when(F.levenshtein(F.lit(q), t, edits) >= 0, EDITED)
        alike = similarity(q, t)
        out = out.when((F.length(t) >= 4) & (alike >= SIMILAR_FROM), SIMILAR_BASE + alike * SIMILAR_SLOPE)
    return out.otherwise(0.0)


def _begins(words: Column, q: str) -> Column:
    return F.exists(words, lambda t: t.startswith(q))


def fuzzy_score(query: str, name: Column, others: list[Column], ids: list[Column]) -> Column:
    """0 if a query word fits nothing well enough, else the mean of the best fits; words beside the name count a little less. Ids match as substrings."""
    words = query_tokens(query)
    if not words:
        return F.lit(1.0)
    own, other = tokens(name), F.flatten(F.array(*map(tokens, others))) if others else F.array().cast("array<string>")
    most = lambda q, ts: F.coalesce(F.array_max(F.transform(ts, lambda t: token_score(q, t))), F.lit(0.0))
    best = []
    for q in words:
        b = F.greatest(most(q, own), most(q, other) * OTHER_FACTOR)
        if len(q) == 1:
            b = F.when((b == 0) & _begins(own, q), INITIAL).otherwise(b)
        best.append(b)
    total = F.aggregate(F.array(*best), F.lit(0.0), lambda s, b: F.when((s < 0) | (b < LEAST_TOKEN), -1.0).otherwise(s + b))
    score = F.when(total < 0, 0.0).otherwise(total / len(words))
    whole = " ".join(query.split()).lower()
    for i in ids if len(whole) >= 3 else []:
        score = F.when(F.coalesce(F.contains(fold(i), F.lit(whole)), F.lit(False)), 1.0).otherwise(score)
    return score
