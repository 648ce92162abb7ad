"""Search phrases and queries built from a catalogue, and the catalogue itself from product rows. Words and rules are parameters; fixed values stand below."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import slug
from dossier.operators.order import running_sum

# Nouns that end a product's name rather than a subject's, words that make a phrase with digits a subject, words that go on a model's name, sizes.
PRODUCT_NOUNS = ["instrument", "platform", "device", "kit", "package", "system", "core", "generator", "workstation"]
SUBJECTS_WITH_DIGITS = ["battery", "cell", "electrode", "voltammetry"]
QUALIFIERS = r"(?i)^(?:pico|go|mux|bt|smart|wearable|core|\d[a-z]?|[a-z]{1,3}\d*)$"
BATCH, WORDS, TAGS, DESCRIPTION = 5, 4, 30, 400
#: Rows of a task that makes them distinct.
ROWS = 1 << 18


def quoted(term: Column) -> Column:
    """Terms with a space or hyphen stand in quotes, so they are searched as phrases."""
    return F.when(term.rlike(r"[\s-]"), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def any_of(terms: Column) -> Column:
    """A query for any of the terms; blank ones are left out."""
    return F.array_join(F.transform(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != ""), quoted), " OR ")


def spellings(model: Column) -> Column:
    """How a model number is written: as given, without spaces and hyphens, with a space or hyphen before its first digits, with its last letter apart. Distinct, in this order."""
    compact = F.regexp_replace(model, r"[\s-]+", "")
    border = r"^([A-Za-zµ]+)(\d)"
    spaced = F.regexp_replace(compact, border, "$1 $2")
    return F.filter(F.array_distinct(F.array(model, compact, spaced, F.regexp_replace(compact, border, "$1-$2"), F.regexp_replace(spaced, r"(\d)([A-Za-z])$", "$1 $2"))), lambda t: t != "")


def model_query(brand: Column, model: Column, alone: Column) -> Column:
    """A model that is unmistakable is asked for in every spelling, any other one together with its brand."""
    return F.when(alone, any_of(spellings(model))).otherwise(F.concat_ws(" ", quoted(brand), quoted(model)))


def without_owner(name: Column) -> Column:
    """A brand without the owner in brackets."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "))


def distinct_terms(terms: Column) -> Column:
    """Trimmed terms, those that differ in case only once, the first spelling of each in its place. Blank ones and nulls go."""
    own = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    keys = F.array_distinct(F.transform(own, lambda t: F.lower(t)))
    # one pass over the distinct keys; lists of terms are those of one brand or product
    return F.transform(keys, lambda k: F.get(F.filter(own, lambda t: F.lower(t) == k), F.lit(0)))


def brand_query(brand: Column, models: Column, aliases: Column) -> Column:
    none = F.array().cast("array<string>")
    return any_of(distinct_terms(F.transform(F.concat(F.array(brand), F.coalesce(models, none), F.coalesce(aliases, none)), without_owner)))


def searchable(phrase: Column, generic: Iterable[str] = (), brands: Iterable[str] = (), model: str | None = None) -> Column:
    """Whether a phrase is worth a search: four characters or more, at most four words, not generic, no brand, no part number, no product noun at its end. model: pattern of model tokens."""
    p = F.lower(F.trim(phrase))
    words = F.split(p, r"\s+")
    keep = (F.length(p) >= 4) & (F.size(words) <= WORDS) & ~p.rlike(r"^\d") & ~p.rlike(rf"\b({'|'.join(PRODUCT_NOUNS)})$")
    keep = keep & ~(p.rlike(r"\d") & (F.size(words) <= 2) & ~p.rlike("|".join(SUBJECTS_WITH_DIGITS)))
    stopped = sorted({w.lower() for w in (*generic, *brands)})
    if stopped:
        keep = keep & ~p.isin(stopped)
    if model:
        keep = keep & ~F.exists(F.split(p, r"[\s/(),]+"), lambda w: w.rlike(model))
    return F.coalesce(keep, F.lit(False))


def model_tokens(name: Column, model: str) -> Column:
    """Tokens of a product's name that fit the pattern of model names, each before it with a short qualifier that follows, if there is one."""
    words = F.filter(F.split(name, r"[\s/(),]+"), lambda w: w != "")
    pairs = F.arrays_zip(words.alias("w"), F.slice(F.concat(words, F.array(F.lit(""))), 2, F.greatest(F.size(words), F.lit(1))).alias("after"))
    named = F.filter(pairs, lambda p: p["w"].rlike(model))
    both = F.transform(named, lambda p: F.when(p["after"].rlike(QUALIFIERS) & (F.length(p["after"]) <= 8), F.array(F.concat_ws(" ", p["w"], p["after"]), p["w"])).otherwise(F.array(p["w"])))
    return distinct_terms(F.flatten(both))


def distinctive_tags(products: DataFrame, product: str, tags: str, least_words: int = 2) -> DataFrame:
    """tag, n of tags of several words that no more than a third of the products (or three) have: one count a tag, one number for the ceiling.

    Tags are dealt out by product and tag before they are made distinct, about ROWS to a task, so what a task holds doesn't grow with the table; for that they are counted first."""
    size = products.agg(F.countDistinct(product).alias("products"), F.sum(F.greatest(F.size(tags), F.lit(0)).cast("long")).alias("rows")).first()
    tasks = max(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.rows or 0) // ROWS))
    each = products.select(product, F.explode(F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))).alias("tag")).repartition(tasks, product, "tag").distinct()
    counts = each.groupBy("tag").agg(F.count("*").alias("n")).where((F.col("tag") != "") & (F.size(F.split("tag", r"\s+")) >= least_words))
    return counts.where(F.col("n") <= max(3, size.products // 3)).select("tag", "n")


def phrase_batches(phrases: DataFrame, phrase: str, order: list[str], size: int = BATCH) -> DataFrame:
    """batch (from 0), query: distinct phrases in their order, `size` of them in one query. Numbers come from running sums of range partitions."""
    once = phrases.withColumn("__key", F.lower(F.trim(phrase))).where("__key != ''").groupBy("__key").agg(F.min(F.struct(*order, F.trim(phrase).alias("__phrase"))).alias("x")).select("x.*")
    numbered = running_sum(once, [*order, "__phrase"], F.lit(1), "__n")
    items = F.array_sort(F.collect_list(F.struct("__n", F.col("__phrase").alias("p"))))
    return numbered.groupBy(F.floor(F.col("__n") / size).alias("batch")).agg(any_of(F.transform(items, lambda x: x["p"])).alias("query"))


def useful_tags(tags: Column, stopped: Iterable[str], kept_codes: str | None = None) -> Column:
    """Tags of three characters or more that don't begin with a digit, aren't letters with a number (but for codes that fit kept_codes), leftovers of markup or stopped words."""
    words = sorted({w.lower() for w in stopped})

    def useful(tag: Column) -> Column:
        t = F.lower(F.trim(tag))
        code = t.rlike(r"^[a-z]+-?\d+") & (~t.rlike(kept_codes) if kept_codes else F.lit(True))
        return (F.length(t) >= 3) & ~t.rlike(r"^\d") & ~code & ~F.contains(t, F.lit("&#")) & (~t.isin(words) if words else F.lit(True))

    return F.filter(tags, lambda t: F.coalesce(useful(t), F.lit(False)))


def catalogue(products: DataFrame, key: str, title: Column, kinds: list[tuple[Column, str, list[str], list[str]]], otherwise: tuple[str, list[str], list[str]], tags: Column, texts: list[Column], model: str, stopped: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """The columns `keep`, product_id, name, category, areas, tags, description, is_active of product rows.

    kinds: (condition, category, areas, tags), the first condition that holds decides, else `otherwise`. texts: the first that isn't blank is the description.
    """
    none = F.array().cast("array<string>")
    lists = lambda items: F.array(*map(F.lit, items)).cast("array<string>") if items else none
    kind = F.struct(F.lit(otherwise[0]).alias("category"), lists(otherwise[1]).alias("areas"), lists(otherwise[2]).alias("tags"))
    for condition, category, areas, own in reversed(kinds):
        kind = F.when(condition, F.struct(F.lit(category).alias("category"), lists(areas).alias("areas"), lists(own).alias("tags"))).otherwise(kind)
    tokens = F.filter(F.split(F.lower(title), r"[\s/(),]+"), lambda w: w.rlike(model))
    joined = F.array_distinct(F.concat(F.col("__kind.tags"), F.coalesce(tokens, none), F.coalesce(useful_tags(tags, stopped), none)))
    description = F.substring(F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts)), 1, DESCRIPTION)
    return products.withColumn("__kind", kind).select(
        *keep, slug(key).alias("product_id"), title.alias("name"), "__kind.category", F.array_distinct("__kind.areas").alias("areas"), F.slice(joined, 1, TAGS).alias("tags"), description.alias("description"), F.lit(True).alias("is_active")
    )
