"""Rule-based scores of candidates, as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import occurrences

# Weights of the four signals, and their steps.
WEIGHTS = {"relevance": 0.55, "recency": 0.15, "strength": 0.15, "engagement": 0.15}
REPEAT_FACTOR, REPEATS, OWNER_BONUS = 0.75, 2, 35
UNKNOWN_RECENCY, YEAR_STEP, LARGE_GRANT = 50, 20, 250_000


def rounded(c: Column) -> Column:
    """Half goes up."""
    return F.floor(c + 0.5).cast("int")


def relevance(text: Column, terms: dict[str, float], owner: Column | None = None) -> Column:
    """Weighted terms; a second occurrence counts less, further ones nothing. text is in lower case."""
    parts = []
    for term, weight in terms.items():
        hits = occurrences(text, term)
        parts.append(F.when(hits > 1, REPEATS * weight * REPEAT_FACTOR).when(hits == 1, float(weight)).otherwise(0.0))
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    return F.least(F.lit(100), rounded(total + F.when(owner, OWNER_BONUS).otherwise(0) if owner is not None else total))


def recency(newest_year: Column, as_of_year: int) -> Column:
    return F.when(newest_year.isNull(), UNKNOWN_RECENCY).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - (as_of_year - newest_year) * YEAR_STEP))).cast("int")


def strength(institution: Column, markers: list[str], grants: Column) -> Column:
    name = F.lower(F.coalesce(institution, F.lit("")))
    marked = reduce(lambda a, b: a | b, (F.contains(name, F.lit(m)) for m in markers), F.lit(False))
    money = F.coalesce(grants, F.lit(0.0))
    return F.least(F.lit(100), F.when(name != "", 40).otherwise(20) + F.when(marked, 25).otherwise(0) + F.when(money > LARGE_GRANT, 30).when(money > 0, 15).otherwise(0)).cast("int")


def engagement(email: Column, profile: Column, orcid: Column, publications: Column, grants: Column) -> Column:
    on = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(F.lit(100), F.when(email.isNotNull(), 45).otherwise(10) + on(profile.isNotNull(), 15) + on(orcid.isNotNull(), 10) + on(publications > 0, 15) + on(grants > 0, 15)).cast("int")


def blend(**signals: Column) -> Column:
    return rounded(reduce(lambda a, b: a + b, (signals[k] * w for k, w in WEIGHTS.items())))


def band(score: Column) -> Column:
    return F.when(score.isNull(), "Unscored").when(score >= 70, "70-100").when(score >= 50, "50-69").when(score >= 40, "40-49").otherwise("0-39")
