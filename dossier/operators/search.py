"""Fuzzy search of a table of queries in a table of people: an index of terms and grams, so that a query meets only the people who have a fitting word.

Queries are cut into words and people into terms; both are made distinct before they meet, so the costly comparison of two words is made once for each pair that can
fit, however many people have the term. A pair can fit if one begins the other (an equi-join on beginnings) or if the words share enough grams: at most k edits leave
max(lengths) + 1 - 3k of a word's grams, and trigrams that are alike by 0.45 are shared by as many of either word. So a query's word looks for its rarest grams only, so
many that a fitting term must have one of them, then the lengths are compared, the shared grams counted, and the ladder of functions.fuzzy decides.

Of the words of a query the one that the fewest people have is looked up; its people are then asked for the other words by their own terms. Each word must fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.functions.text import fold
from dossier.operators import order
from dossier.operators.containment import holders
from dossier.session import cut, spread


class Index:
    """What a search needs of the people: their terms with weights (1 in the name, less elsewhere), distinct terms with counts, and their ids in small letters."""

    def __init__(self, terms: DataFrame, ids: DataFrame, everybody: DataFrame):
        self.terms, self.ids, self.everybody = terms, ids, everybody
        self.words = cut(terms.groupBy("term").agg(F.count("*").alias("people")))


def index(people: DataFrame, id_: str, name: str, others: list[str], ids: list[str]) -> Index:
    """others: text columns or lists of texts; ids: columns that match by any part of them."""
    kinds = dict(people.dtypes)
    flat = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c)
    own = F.transform(fuzzy.tokens(F.coalesce(F.col(name), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))
    other = [F.transform(fuzzy.tokens(F.coalesce(flat(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(fuzzy.OTHER_FACTOR).alias("weight"))) for c in others]
    terms = people.select(F.col(id_).alias("person"), F.explode(F.concat(own, *other)).alias("x")).groupBy("person", "x.term").agg(F.max("x.weight").alias("weight"))
    codes = people.select(F.col(id_).alias("person"), F.explode(F.array(*(fold(F.col(c).cast("string")) for c in ids)) if ids else F.array().cast("array<string>")).alias("code")).where("code <> ''").distinct()
    return Index(cut(terms), codes, people.select(F.col(id_).alias("person")))


def _alike(q: Column, t: Column) -> Column:
    a, b = fuzzy.trigrams(q), fuzzy.trigrams(t)
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def ladder(q: Column, t: Column) -> Column:
    """functions.fuzzy.token_score for two columns."""
    long = F.length(q) >= 4
    out = F.when(t == q, 1.0).when(F.startswith(t, q), F.when(F.length(q) >= 3, fuzzy.PREFIX).otherwise(fuzzy.SHORT_PREFIX))
    out = out.when(long & (F.length(t) >= 3) & F.startswith(q, t), fuzzy.REVERSE_PREFIX)
    out = out.when((F.length(q) >= 8) & (F.levenshtein(q, t, 2) >= 0), fuzzy.EDITED).when(long & (F.levenshtein(q, t, 1) >= 0), fuzzy.EDITED)
    alike = _alike(q, t)
    return out.when(long & (F.length(t) >= 4) & (alike >= fuzzy.SIMILAR_FROM), fuzzy.SIMILAR_BASE + alike * fuzzy.SIMILAR_SLOPE).otherwise(0.0)


def _beginnings(c: Column, least: int = 1) -> Column:
    return F.when(F.length(c) >= least, F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.substring(c, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def fitting(asked: DataFrame, words: DataFrame) -> DataFrame:
    """word, term, score: which of the distinct query words fit which of the distinct terms (term, people), and how well."""
    ahead = spread(words.select("term", F.explode(_beginnings(F.col("term"))).alias("word"))).join(asked, "word").select("word", "term")
    behind = asked.where("length(word) >= 4").select("word", F.explode(_beginnings(F.col("word"), 3)).alias("term")).join(words.select("term"), "term").select("word", "term")
    pieces = words.where("length(term) >= 3").select("term", F.explode(fuzzy.trigrams(F.col("term"))).alias("gram"))
    many = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    n = F.size("grams")
    edits = F.when(F.length("word") >= 8, 2).otherwise(1)
    # at least one gram of the rarest n - m + 1 is shared; repeated grams of a word count once, so the edits are counted on the distinct ones
    needed = F.greatest(F.lit(1), F.least(F.ceil(n * fuzzy.SIMILAR_FROM), n - 3 * edits))
    own = asked.where("length(word) >= 4").withColumn("grams", fuzzy.trigrams(F.col("word"))).select("word", "grams", needed.cast("int").alias("needed"), F.explode("grams").alias("gram"))
    ranked = own.join(spread(many), "gram", "left").withColumn("place", F.row_number().over(W.partitionBy("word").orderBy(F.coalesce("n", F.lit(0)), "gram")))
    probes = ranked.where(F.col("place") <= n - F.col("needed") + 1).select("word", "gram", n.alias("own"))
    length = F.length("term") - F.length("word")
    edited = F.abs(length) <= edits
    alike = (F.length("term") + 1 >= F.floor(F.col("own") * fuzzy.SIMILAR_FROM)) & (F.length("term") >= 4)
    near = spread(pieces).join(probes, "gram").where(edited | alike).select("word", "term")
    pairs = ahead.unionByName(behind).unionByName(near).distinct()
    return pairs.withColumn("score", ladder(F.col("word"), F.col("term"))).where("score > 0")


def scored(ix: Index, queries: DataFrame, query: str, least: float = fuzzy.LEAST_SCORE) -> DataFrame:
    """asked (the query in small letters without accents, trimmed), person, score of all that reach the least score. A query without words finds everybody."""
    each = cut(queries.select(F.trim(fold(F.coalesce(query, F.lit("")))).alias("asked")).distinct().withColumn("tokens", fuzzy.tokens(F.col("asked"))))
    tokens = each.select("asked", F.explode(F.array_distinct("tokens")).alias("word"))
    pairs = cut(fitting(tokens.select("word").distinct(), ix.words))
    by_word = pairs.join(ix.words, "term").groupBy("word").agg(F.sum("people").alias("people"))
    found = tokens.join(by_word, "word", "left").groupBy("asked").agg(F.min(F.struct("people", "word")).alias("rarest"), F.count_if(F.col("people").isNull()).alias("nowhere")).where("nowhere = 0")
    wanted = found.select("asked", F.col("rarest.word").alias("word")).join(pairs, "word")
    first = spread(ix.terms).join(wanted, "term").select("asked", "person").distinct()
    words = tokens.join(pairs, "word")
    best = spread(first).join(spread(ix.terms), "person").join(spread(words), ["asked", "term"]).groupBy("asked", "person", "word").agg(F.max(F.col("score") * F.col("weight")).alias("best"))
    best = best.where(F.col("best") >= fuzzy.LEAST_TOKEN).groupBy("asked", "person").agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("best"))
    fits = best.join(spread(each), "asked").where(F.size("best") == F.size(F.array_distinct("tokens")))
    total = F.aggregate("tokens", F.lit(0.0), lambda s, w: s + F.element_at("best", w))
    out = fits.select("asked", "person", (total / F.size("tokens")).alias("score"))
    known = holders(each.where((F.length("asked") >= 3) & (F.size("tokens") > 0)), "asked", ix.ids, "code").join(spread(ix.ids.withColumnRenamed("code", "text")), "text")
    out = out.unionByName(known.select(F.col("key").alias("asked"), "person", F.lit(1.0).alias("score"))).groupBy("asked", "person").agg(F.max("score").alias("score"))
    blank = [r.asked for r in each.where(F.size("tokens") == 0).collect()]
    if blank:  # few: queries are made of letters and digits, and equal ones are one
        out = out.unionByName(ix.everybody.select(F.explode(F.array(*map(F.lit, blank))).alias("asked"), "person", F.lit(1.0).alias("score")))
    return out.where(F.col("score") >= least)


def fuzzy_search(queries: DataFrame, query_id: str, query: str, people: DataFrame, id_: str, name: str, others: list[str], ids: list[str], where: Column | None = None, ties: list[Column] | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    """query_id, id_, score, rank, total: a page of the people who pass the filters and fit each query, the best first, equal ones in the order of `ties` (then by id); total: how many fit.

    A page needs the first page * limit rows of a query only, which each task finds for itself before they are shuffled. Null and empty queries find everybody."""
    rows = people.where(where) if where is not None else people
    found = cut(scored(index(rows, id_, name, others, ids), queries, query))
    totals = found.groupBy("asked").agg(F.count("*").alias("total"))
    held = found.select(F.col("asked").alias("__asked"), F.col("person").alias("__person"), F.col("score").alias("__score")).join(spread(rows), F.col("__person") == F.col(id_))
    ranked = order.top_per_group(held, ["__asked"], [F.desc("__score"), *(ties or []), F.col("__person")], page * limit)
    ranked = ranked.where(F.col("rank") > (page - 1) * limit).select(F.col("__asked").alias("asked"), F.col("__person").alias("person"), F.col("__score").alias("score"), "rank").join(spread(totals), "asked")
    own = queries.select(query_id, F.trim(fold(F.coalesce(query, F.lit("")))).alias("asked"))
    return own.join(spread(ranked), "asked").select(query_id, F.col("person").alias(id_), "score", "rank", "total")
