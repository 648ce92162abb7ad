"""Institutions and how they are called: profiles, spellings with their keys, targets and directory pages that belong to them, addresses where departments usually are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import expanded_institution_key, institution_key
from dossier.operators import containment

# Families of institutes with their short forms; names worth a search; codes of departments and what they stand for; words of a feed.
FAMILIES = {"Indian Institute of Technology": "IIT", "National Institute of Technology": "NIT", "Indian Institute of Information Technology": "IIIT", "International Institute of Information Technology": "IIIT"}
TELLING = r"(?i)institute|technology|IIT|NIT"
DEPARTMENT_CODES = [
    ("chem", "chemistry"), ("chemistry", "chemistry"), ("che", "chemical"), ("chemical", "chemical"), ("cheme", "chemical"), ("bsbe", "bioscience"), ("bio", "biolog"), ("biotech", "biotech"), ("bt", "biotech"), ("dbeb", "biochem"), ("bioscience", "bioscience"),
    ("biosciences", "bioscience"), ("biology", "biolog"), ("mems", "metallurg"), ("mme", "metallurg"), ("mm", "metallurg"), ("meta", "metallurg"), ("metallurgy", "metallurg"), ("mat", "material"), ("materials", "material"), ("mse", "material"), ("ese", "energy"),
    ("energy", "energy"), ("dese", "energy"), ("civil", "civil"), ("ce", "civil"), ("me", "mechanical"), ("mech", "mechanical"), ("mechanical", "mechanical"),
]
FEED_HEADS = ["<rss", "<feed", "<rdf:rdf"]


def short_names(name: Column) -> Column:
    """The short forms that people type: family and place ("IIT Bombay"). None for other names."""
    pattern = rf"(?i)^({'|'.join(FAMILIES)})\s+(.+)$"
    family = F.regexp_extract(name, pattern, 1)
    short = F.element_at(F.create_map(*(F.lit(x) for k, v in FAMILIES.items() for x in (k.lower(), v))), F.lower(family))
    return F.when(F.coalesce(family, F.lit("")) != "", F.array(F.concat_ws(" ", short, F.regexp_extract(name, pattern, 2)))).otherwise(F.array().cast("array<string>"))


def profile(df: DataFrame, id_: str = "id", name: str = "display_name") -> DataFrame:
    """Captured institution records (id, display_name, ror, homepage_url, display_name_acronyms, display_name_alternatives) as id without its address, name, ror, homepage, acronyms, alternatives; without an id or a name there is none."""
    none = F.array().cast("array<string>")
    rows = df.where(F.col(id_).isNotNull() & F.col(name).isNotNull())
    return rows.select(
        F.element_at(F.split(id_, "/"), -1).alias("id"), F.col(name).alias("name"), "ror", F.col("homepage_url").alias("homepage"), F.coalesce("display_name_acronyms", none).alias("acronyms"), F.coalesce("display_name_alternatives", none).alias("alternatives")
    )


def spellings(institutions: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """place, name, key: each name an institution (place, name) may go by: its own, its short forms, and of its profile (id: the place) acronyms of three letters and alternatives that name an institute. Equal names are one; a key without letters is null."""
    own = institutions.select("place", F.col("name").alias("__n"))
    if profiles is not None:
        own = own.join(profiles.select(F.col("id").alias("place"), "acronyms", "alternatives"), "place", "left")
    none = F.array().cast("array<string>")
    more = [F.coalesce(F.filter("acronyms", lambda a: F.length(a) >= 3), none), F.coalesce(F.filter("alternatives", lambda a: a.rlike(TELLING)), none)] if profiles is not None else []
    names = F.array_distinct(F.array_compact(F.concat(F.array("__n"), short_names(F.col("__n")), *more)))
    return own.select("place", F.explode(names).alias("name")).withColumn("key", institution_key("name"))


def search_phrases(names: DataFrame, least: int = 6) -> DataFrame:
    """place and the names of so many letters that a registry is asked for."""
    return names.where(F.length("name") >= least).select("place", "name").distinct()


def matched_targets(targets: DataFrame, institutions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """targets (name, more) with the places they belong to: institutions (place, name) whose key is the target's, holds it or lies in it, short forms read in full. wanted: places of a run; without it all. A target of two places is there for each."""
    some = institutions if wanted is None else institutions.join(wanted.select("place").distinct(), "place", "left_semi")
    known = some.select("place", institution_key("name").alias("__k")).where("__k <> ''").distinct()
    rows = targets.withColumn("__t", expanded_institution_key("name"))
    pairs = containment.either_way(rows.select("__t"), "__t", known, "__k").join(known, "__k").select("__t", "place").distinct()
    return rows.join(pairs, "__t").drop("__t")


def directory_urls(institutions: DataFrame, targets: DataFrame) -> DataFrame:
    """place, urls: the pages of the enabled targets of each institution in the order of the list (line); places without one are there, too."""
    found = matched_targets(targets.where("enabled"), institutions)
    urls = found.groupBy("place", "url").agg(F.min("line").alias("line")).groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "url"))), lambda x: x["url"]).alias("urls"))
    return institutions.select("place").distinct().join(urls, "place", "left").select("place", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def url_seeds(institutions: DataFrame, homepage: str, hints: list[str]) -> DataFrame:
    """institutions with url, label, hint: where departments usually are, with www. and without it, and below the home page; one row an address, the first code that gives it."""
    root = F.col(homepage)
    scheme, host = F.regexp_extract(root, r"^([a-zA-Z][\w+.-]*)://", 1), F.regexp_extract(root, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    wanted = {h.lower() for h in hints}
    seed = lambda url, code, hint: F.struct(url.alias("url"), F.lit(f"{code} department").alias("label"), F.lit(hint).alias("hint"))
    below = F.regexp_replace(root, "/+$", "")
    every = [seed(u, c, h) for c, h in DEPARTMENT_CODES if h in wanted for u in (F.concat(scheme, F.lit(f"://www.{c}."), bare), F.concat(scheme, F.lit(f"://{c}."), bare), F.concat(below, F.lit(f"/{c}")))]
    if not every:
        return institutions.select("*", *(F.lit(None).cast("string").alias(c) for c in ("url", "label", "hint"))).limit(0)
    return institutions.where(host != "").select("*", F.explode(F.array(*every)).alias("__s")).select(*institutions.columns, "__s.*")


def looks_like_feed(text: Column) -> Column:
    """Whether the first thousand characters speak of a feed."""
    head = F.lower(F.substring(text, 1, 1000))
    hits = [F.contains(head, F.lit(w)) for w in FEED_HEADS]
    return F.coalesce(hits[0] | hits[1] | hits[2], F.lit(False))
