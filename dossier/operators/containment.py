"""Which keys hold which others: a substring index in place of a join on a condition.

Every key is looked for by one of its grams only, the one that the fewest of the others have, so a word that all keys share is no join key unless a key consists of it.
What shares that gram is then asked whether it holds the whole key. Keys that are shorter than a gram are grams of their own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.session import cut, spread

#: Characters of a gram: so many that few texts share one, so a key is compared with few texts that don't hold it.
GRAM = 8


def grams(key: Column, size: Column | int) -> Column:
    """The distinct stretches of so many characters; none of a shorter key."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(key) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda k: F.substring(key, k, size)))).otherwise(F.array().cast("array<string>"))


def holders(keys: DataFrame, key: str, texts: DataFrame, text: str) -> DataFrame:
    """key, text: each distinct key with each distinct text that holds it, equal ones too. Null and empty keys are in nothing. One small job counts the lengths below a gram."""
    own = cut(keys.select(F.col(key).alias("key")).where("key <> ''").distinct())
    held = cut(texts.select(F.col(text).alias("text")).where("text <> ''").distinct())
    sizes = _sizes(own)
    return _holders(own, held, sizes) if sizes else own.crossJoin(held.limit(0))


def holder_counts(keys: DataFrame, key: str, texts: DataFrame, text: str) -> DataFrame:
    """key, n, first, last of each distinct key that stands in a text: how many distinct texts hold it, the first and the last of them.

    Keys no longer than a gram are grams, and texts are counted by gram before they meet, so a key that most texts hold makes no pairs. Longer keys are counted from their pairs."""
    own = cut(keys.select(F.col(key).alias("key")).where("key <> ''").distinct())
    held = cut(texts.select(F.col(text).alias("text")).where("text <> ''").distinct())
    told = [F.count("*").alias("n"), F.min("text").alias("first"), F.max("text").alias("last")]
    short, long = own.where(F.length("key") <= GRAM), own.where(F.length("key") > GRAM)
    out = spread(_pieces(held, _sizes(short)).groupBy(F.col("gram").alias("key")).agg(*told)).join(short, "key")
    return out.unionByName(_holders(long, held, [GRAM]).groupBy("key").agg(*told)) if long.head(1) else out


def _sizes(own: DataFrame) -> list[int]:
    return sorted(r[0] for r in own.select(F.least(F.length("key"), F.lit(GRAM)).alias("n")).distinct().collect())


def _pieces(held: DataFrame, sizes: list[int]) -> DataFrame:
    none = F.array().cast("array<string>")
    return held.select("text", F.explode(F.concat(none, *(grams(F.col("text"), n) for n in sizes))).alias("gram"))


def _holders(own: DataFrame, held: DataFrame, sizes: list[int]) -> DataFrame:
    pieces = _pieces(held, sizes)
    many = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    asked = own.select("key", F.explode(grams(F.col("key"), F.least(F.length("key"), F.lit(GRAM)))).alias("gram"))
    rarest = asked.join(spread(many), "gram", "left").groupBy("key").agg(F.min(F.struct("n", "gram")).alias("best"), F.count_if(F.col("n").isNull()).alias("nowhere")).where("nowhere = 0")
    # the few keys of a gram stand on the right, where a merge keeps the rows of a key
    return spread(pieces).join(rarest.select("key", F.col("best.gram").alias("gram")), "gram").where(F.contains("text", F.col("key"))).select("key", "text")


def either_way(asked: DataFrame, key: str, known: DataFrame, known_key: str, least_words: int = 1) -> DataFrame:
    """key, known_key: pairs of which one holds the other. A known key that lies in the asked one has so many words at least; one that is equal or holds it may have fewer."""
    there = holders(asked, key, known, known_key).select(F.col("key").alias(key), F.col("text").alias(known_key))
    long = known.where(F.size(F.split(known_key, " ")) >= least_words)
    back = holders(long, known_key, asked, key).select(F.col("text").alias(key), F.col("key").alias(known_key))
    return there.unionByName(back).distinct()


def first_place(asked: DataFrame, key: str, known: DataFrame, known_key: str, place: str, least_words: int = 1) -> DataFrame:
    """key, place: the first place, in their order, one of whose keys holds the asked key or lies in it. Places are reduced before they meet: one row a known key."""
    best = known.groupBy(known_key).agg(F.min(place).alias(place))
    return either_way(asked, key, best, known_key, least_words).join(best, known_key).groupBy(key).agg(F.min(place).alias(place))


def named_in(texts: DataFrame, text: str, names: DataFrame, name: str, least: int = 6) -> DataFrame:
    """text, name: which names of so many letters stand anywhere in which texts, whatever the case."""
    small = names.select(F.col(name).alias("__own"), F.lower(name).alias("__name")).where(F.length("__name") >= least).distinct()
    lower = texts.select(F.col(text).alias("__whole"), F.lower(text).alias("__small")).distinct()
    found = holders(small, "__name", lower, "__small").select(F.col("key").alias("__name"), F.col("text").alias("__small"))
    return found.join(small, "__name").join(lower, "__small").select(F.col("__whole").alias(text), F.col("__own").alias(name))


def longest_held(pairs: DataFrame, text: str, key: str) -> DataFrame:
    """Of each text the longest key that it holds, the first by letters among equals."""
    best = W.partitionBy(text).orderBy(F.length(key).desc(), F.col(key))
    return pairs.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")
