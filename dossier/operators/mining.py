"""Terms, snippets, sections and names in texts, as Spark columns over lexicons given as data."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import around, squeeze

EDGES = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
# Headings that begin a methods section, and those that end it; a heading is a line of its own, numbered or not, with a colon or not.
METHODS = r"materials?\s+and\s+methods?|experimental(?:\s+(?:section|details|methods?|procedures?))?|methods?(?:\s+and\s+materials?)?|methodology|instrumentation|apparatus|electrochemical\s+measurements?|characteri[sz]ation|measurements?"
AFTER_METHODS = r"results(?:\s+and\s+discussion)?|discussion|conclusions?|acknowledge?ments?|references|bibliography"
HEADING = r"^\s*(?:\d+(?:\.\d+)*\.?\s*)?(?:{})\s*:?\s*$"


def detect(df: DataFrame, text: str, lexicon: list[tuple[str, str, str]], name: str, limit: int | None = None) -> DataFrame:
    """df with an array<struct(brand, model, evidence)>: for each brand (name, brand pattern, model pattern) that the text names its models, the most specific ones only, or the brand alone. All of them, or the first `limit` over all brands.

    Matches and their sorted models are columns of their own before anything looks at them twice: each pattern runs once a row, models are looked for only in
    texts that name their brand, and a model is compared with its neighbour in the order only."""
    hits, models, entries = {}, {}, []
    for k, (brand, brand_pattern, model_pattern) in enumerate(lexicon):
        hit = F.regexp_extract(text, "(?iu)" + EDGES.format(f"(?:{brand_pattern})"), 0)
        words = brand_pattern.split("|")
        if all(re.fullmatch(r"[\w ]+", w) for w in words):  # plain words: a look for them costs less than the pattern
            hit = F.when(reduce(or_, (F.contains("__low", F.lit(w.lower())) for w in words)), hit)
        hits[f"__hit{k}"] = F.coalesce(hit, F.lit(""))  # a null text names nothing
        every = F.filter(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(" + EDGES.format(f"(?:{model_pattern})") + ")"), F.lit(1))), lambda m: F.length(m) >= 3)
        models[f"__models{k}"] = F.when(F.col(f"__hit{k}") != "", F.array_sort(F.transform(every, lambda m, i: F.struct(F.lower(m).alias("low"), i.alias("at"), m.alias("m")))))
        entries.append(_entries(text, brand, f"__hit{k}", f"__models{k}"))
    found = df.withColumn("__low", F.lower(text)).withColumns(hits).withColumns(models)
    every = F.flatten(F.array(*entries))
    return found.withColumn(name, every if limit is None else F.slice(every, 1, limit)).drop("__low", *hits, *models)


def _entries(text: str, brand: str, hit: str, models: str) -> Column:
    def entry(model: Column, shown: Column) -> Column:
        return F.struct(F.lit(brand).alias("brand"), model.alias("model"), around(F.col(text), F.instr(text, shown), F.length(shown)).alias("evidence"))

    own = F.filter(models, lambda x, i: ~F.coalesce(F.startswith(F.get(models, i + 1)["low"], x["low"]), F.lit(False)))
    first = F.array_sort(F.transform(own, lambda x: F.struct(x["at"].alias("at"), x["m"].alias("m"))))
    alone = F.array(entry(F.lit(None).cast("string"), F.col(hit)))
    return F.when(F.col(hit) == "", F.slice(alone, 1, 0)).when(F.size(models) > 0, F.transform(first, lambda x: entry(x["m"], x["m"]))).otherwise(alone)


def merged_detections(items: Column, limit: int = 12) -> Column:
    """Distinct by brand and model in their order; a brand alone goes if a model of it is there. For short lists (those of detect, one after another)."""
    key = lambda x: F.concat(x["brand"], F.lit("|"), F.lower(F.coalesce(x["model"], F.lit(""))))
    keys = F.transform(items, key)
    one = F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)
    return F.slice(F.filter(one, lambda x: x["model"].isNotNull() | ~F.exists(one, lambda y: (y["brand"] == x["brand"]) & y["model"].isNotNull())), 1, limit)


# Words that begin a new clause rather than another part of a name, and how titles before names are written.
CONNECTIVES = ["And", "Or", "The", "A", "An", "At", "In", "Of", "For", "With"]
NAME_TITLES = r"Professor|Prof\.?|Dr\.?"
NAME_WORD = r"[A-ZÀ-ɏ][A-Za-zÀ-ɏ'’-]+"


def spelled(term: str) -> str:
    """A pattern for a term as it stands; between letters and digits it may have a space or hyphen."""
    return re.sub(r"(?<=[A-Za-z])(?:\\ )?(?=\d)", "[ -]?", re.escape(term))


def snippets(text: Column, terms: list[str], window: int = 260, limit: int = 30) -> Column:
    """Sentences and lines that have a term of three characters or more as a whole word, distinct but for case, in their order. A longer one is cut to a window around the first term in it, with dots where it goes on."""
    known = [spelled(t.strip()) for t in terms if len(t.strip()) >= 3]
    if not known:
        return F.array().cast("array<string>")
    term = rf"(?<![A-Za-z0-9])(?:{'|'.join(known)})(?![A-Za-z0-9])"

    def cut(s: Column) -> Column:
        begin = F.greatest(F.lit(0), F.length(F.regexp_extract(s, rf"(?is)^(.*?){term}", 1)) - window // 2)
        middle = F.trim(F.substring(s, begin + 1, F.lit(window)))
        return F.when(F.length(s) <= window, s).otherwise(F.concat(F.when(begin > 0, "…").otherwise(""), middle, F.when(begin + window < F.length(s), "…").otherwise("")))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+"), squeeze)
    found = F.transform(F.filter(lines, lambda s: s.rlike("(?i)" + term)), cut)
    keys = F.slice(F.array_distinct(F.transform(found, F.lower)), 1, limit)
    return F.transform(keys, lambda k: F.get(F.filter(found, lambda s: F.lower(s) == k), F.lit(0)))


def mentions(text: Column, titles: str = NAME_TITLES, limit: int = 10) -> Column:
    """Names after a title, distinct, in their order: a first name, an initial if there is one, a surname and perhaps a second one. A capitalised connective ends a name."""
    more = rf"\s+(?!(?:{'|'.join(CONNECTIVES)})\b){NAME_WORD}"
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?:{titles})\s+({NAME_WORD}(?:\s+[A-Z]\.?)?{more}(?:{more})?)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, squeeze)), 1, limit)


def methods_section(text: Column, limit: int = 12_000, least: int = 80, heading: bool = True) -> Column:
    """The longest stretch from a methods heading to the next heading that ends it, with its own heading or without. If it has fewer than `least` characters with the heading, the text itself."""
    begin = HEADING.format(METHODS)
    found = F.regexp_extract_all(text, F.lit(rf"(?imdU){begin}(?s:.*?)(?={HEADING.format(AFTER_METHODS)}|\z)"), F.lit(0))
    best = F.aggregate(found, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    stripped = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    body = lambda b: b if heading else stripped(F.regexp_replace(b, rf"(?imdU)\A{begin}", ""))
    return F.substring(F.get(F.transform(F.array(best), lambda b: F.when(F.length(stripped(b)) < least, text).otherwise(body(b))), 0), 1, limit)
