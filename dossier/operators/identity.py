"""Who is who: merging sightings of one key in their order, matching by keys in precedence, unique matches or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_key(email: Column, name_key: Column, institution_key: Column) -> Column:
    """E-mail if there is one, else name and institution, else the name; null without a name."""
    return F.when(name_key != "", F.when(email.isNotNull(), F.concat(F.lit("email:"), F.lower(email))).when(institution_key.isNotNull(), F.concat(F.lit("name:"), name_key, F.lit("|inst:"), institution_key)).otherwise(F.concat(F.lit("name:"), name_key)))


def first_values(df: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """One row a key: of each field the first value that isn't null, in the order of seq. A partial aggregate, so a hot key is a row a task."""
    return df.groupBy(key).agg(F.min(seq).alias(seq), F.count("*").alias("sightings"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields))


def ordered_union(df: DataFrame, key: str, seq: str, item: str, limit: int, name: str) -> DataFrame:
    """One row a key: its distinct items in the order in which they were first seen, `limit` at most. Items are made distinct before any list is."""
    one = df.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.min(seq).alias("__s"))
    return one.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("__s", item))), 1, limit), lambda x: x[item]).alias(name))


def distinct_by(items: Column, key) -> Column:
    """The list without elements whose key came before or is empty."""
    seen = F.transform(items, key)
    return F.filter(items, lambda x, i: (F.coalesce(key(x), F.lit("")) != "") & (F.array_position(seen, key(x)) == i + 1))


def merged_evidence(texts: Column, limit: int = 2500) -> Column:
    """Texts in their order with an empty line between, without those that are in what is held; a text that holds all before it takes its place."""

    def step(a: Column, b: Column) -> Column:
        b = F.trim(b)
        return F.when((b == "") | F.contains(a, b), a).when((a == "") | F.contains(b, a), b).otherwise(F.substring(F.concat(a, F.lit("\n\n"), b), 1, limit))

    return F.aggregate(texts, F.lit(""), step)


def cascade(rows: DataFrame, known: DataFrame, keys: list[tuple[str, list[Column], list[Column]]], known_id: str, match: str, via: str) -> DataFrame:
    """rows with the id of the known row that the first of the keys finds (the smallest such id), and which key that was.

    keys: name, key columns of rows, key columns of known. A row whose key has a null isn't looked up by it. Known keys are made distinct first, so no row
    of `rows` is ever multiplied."""
    found, how = [], F
    for k, (name, left, right) in enumerate(keys):
        k_left, k_right = [f"__l{k}_{i}" for i in range(len(left))], [f"__r{k}_{i}" for i in range(len(right))]
        best = known.select(*(c.alias(n) for c, n in zip(right, k_right, strict=True)), F.col(known_id).alias(f"__id{k}")).dropna().groupBy(*k_right).agg(F.min(f"__id{k}").alias(f"__id{k}"))
        rows = rows.withColumns(dict(zip(k_left, left, strict=True)))
        rows = rows.join(best, [F.col(a) == F.col(b) for a, b in zip(k_left, k_right, strict=True)], "left").drop(*k_left, *k_right)
        found.append(f"__id{k}")
        how = how.when(F.col(f"__id{k}").isNotNull(), name)
    return rows.withColumn(match, F.coalesce(*found)).withColumn(via, how.otherwise(None)).drop(*found)


def unique_matches(rows: DataFrame, row_id: str, row_keys: Column, known: DataFrame, known_id: str, known_keys: Column, name: str) -> DataFrame:
    """row_id and the known id that shares a key with it, if there is exactly one. Known keys with several ids are one row each before the join."""
    index = known.select(F.col(known_id).alias("__k"), F.explode(known_keys).alias("__key")).groupBy("__key").agg(F.min("__k").alias("low"), F.max("__k").alias("high"))
    hits = rows.select(F.col(row_id), F.explode(row_keys).alias("__key")).join(index, "__key")
    return hits.groupBy(row_id).agg(F.min("low").alias(name), F.max("high").alias("__high")).where(F.col(name) == F.col("__high")).drop("__high")


def contained_phrases(rows: DataFrame, row_id: str, text: Column, phrases: DataFrame, phrase: str, position: str, longest: int) -> DataFrame:
    """row_id and the phrase of the smallest position that stands in its text as whole words: an equi-join on word runs of each length up to the longest phrase."""
    words = F.split(text, " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, k, n), " "))))
    own = rows.select(row_id, F.explode(F.array_distinct(runs)).alias(phrase))
    return own.join(phrases.select(phrase, position), phrase).groupBy(row_id).agg(F.min_by(phrase, position).alias(phrase))


def without_known(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(known, key, "left_anti")
