"""Captured records of papers, authors, employments and grants: nested rows turned into candidates and evidence by columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import expanded_institution_key, from_inverted_index, short_id, year
from dossier.operators.order import top_per_group

PLACE = "struct<id:string,display_name:string,country_code:string>"
WORKS = f"""id string, doi string, title string, publication_year int, topics array<struct<display_name:string>>, abstract_inverted_index map<string,array<int>>,
authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,is_corresponding:boolean,institutions:array<{PLACE}>,raw_affiliation_strings:array<string>>>"""
EVIDENCE = 1500


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def chosen_authorships(authorships: Column, targets: list[str], country: str | None = None, every: bool = False) -> Column:
    """The authorship that stands for a paper, as a list of one or none: a corresponding author at a target, an author at one, a corresponding author, the first.
    every: all authors at a target, or of the country without targets."""

    def at_target(a: Column) -> Column:
        return F.coalesce(F.exists(a["institutions"], lambda i: short_id(i["id"]).isin(targets)), F.lit(False)) if targets else F.lit(False)

    if every and (targets or country):
        own = at_target if targets else lambda a: F.coalesce(F.exists(a["institutions"], lambda i: F.upper(i["country_code"]) == country.upper()), F.lit(False))
        return F.filter(authorships, own)
    corresponding = lambda a: F.coalesce(a["is_corresponding"], F.lit(False))
    tries = [lambda a: corresponding(a) & at_target(a), at_target, corresponding, lambda a: F.lit(True)]
    return F.slice(F.concat(*(F.filter(authorships, t) for t in tries)), 1, 1)


def work_candidates(works: DataFrame, targets: list[str], country: str | None = None, every: bool = False) -> DataFrame:
    """A row for each chosen author of each paper (schema WORKS): who, where, the paper, its topics and text. Authors without an id or a name go."""
    rows = works.withColumn("__a", F.explode(chosen_authorships(F.col("authorships"), targets, country, every)))
    named = rows.where("__a.author.id is not null and __a.author.display_name is not null")
    places = F.col("__a.institutions")
    at = F.filter(places, lambda i: short_id(i["id"]).isin(targets)) if targets else F.slice(places, 1, 0)
    named = named.withColumn("__i", F.coalesce(_first(at), _first(places)))
    url = F.coalesce("doi", "id")
    paper = F.struct("title", F.col("publication_year").alias("year"), url.alias("url"), F.col("id").alias("source_id"))
    words = F.when(F.col("abstract_inverted_index").isNotNull(), from_inverted_index(F.col("abstract_inverted_index")))
    return named.select(
        F.col("__a.author.id").alias("source_record_id"),
        url.alias("source_url"),
        F.col("__a.author.display_name").alias("name"),
        F.replace(F.col("__a.author.orcid"), F.lit("https://orcid.org/"), F.lit("")).alias("orcid"),
        F.coalesce("__i.display_name", _first(F.col("__a.raw_affiliation_strings"))).alias("institution_name"),
        short_id("__i.id").alias("institution_id"),
        F.col("__i.country_code").alias("country"),
        F.when(F.col("title").isNotNull(), F.array(paper)).otherwise(F.slice(F.array(paper), 1, 0)).alias("publications"),
        F.array_compact(F.transform("topics", lambda t: t["display_name"])).alias("topics"),
        F.substring(F.concat_ws(". ", "title", F.nullif(words, F.lit(""))), 1, EVIDENCE).alias("evidence_text"),
    )


def years_of(affiliations: Column, institution: Column | None = None) -> Column:
    """Years of all affiliations struct(id, years), or of those with one institution, newest first."""
    own = affiliations if institution is None else F.filter(affiliations, lambda x: short_id(x["id"]) == institution)
    return F.sort_array(F.array_compact(F.flatten(F.transform(own, lambda x: F.coalesce(x["years"], F.array().cast("array<int>"))))), False)


def author_record(affiliations: Column, institution: Column) -> Column:
    """struct(years_here, first_year, last_year)."""
    every = years_of(affiliations)
    return F.struct(years_of(affiliations, institution).alias("years_here"), F.array_min(every).alias("first_year"), F.array_max(every).alias("last_year"))


def topic_profile(works: DataFrame, author: str, topics: str, seq: str, limit: int = 10) -> DataFrame:
    """author and its most frequent topics, at most `limit`; the one seen first among equals. Topics are counted before any list is made."""
    rows = works.select(author, F.col(seq).alias("__s"), F.posexplode(topics).alias("__p", "__t")).where("__t is not null")
    counts = rows.groupBy(author, "__t").agg((-F.count("*")).alias("n"), F.min(F.struct("__s", "__p")).alias("at"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("n", "at", "__t"))), 1, limit)
    return counts.groupBy(author).agg(F.transform(ranked, lambda x: x["__t"]).alias("topics"))


def recent_papers(works: DataFrame, author: str, seq: str, since: Column, published: str, title: str, limit: int = 25) -> DataFrame:
    """author and its newest titled papers since a year; each task keeps an author's own newest ones, then the author's are merged."""
    rows = works.where((F.col(published) >= since) & F.col(title).isNotNull())
    newest = top_per_group(rows, [author], [F.desc(published), F.col(seq)], limit)
    return newest.groupBy(author).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", title))), lambda x: x[title]).alias("titles"))


def employment_here(jobs: Column, institution_id: Column, institution: Column) -> Column:
    """The open employment at an institution, if any: one with a role before one without, then the newest. jobs: array<struct(org_id, organization, role, start_year, current)>.
    A name that is a part of the institution's counts with three words or more."""
    ours = expanded_institution_key(institution)

    def here(j: Column) -> Column:
        k = expanded_institution_key(j["organization"])
        named = F.contains(k, ours) | (F.contains(ours, k) & (F.size(F.split(k, " ")) >= 3))
        return j["current"] & (F.coalesce(F.lower(j["org_id"]) == F.lower(institution_id), F.lit(False)) | F.coalesce(named, F.lit(False)))

    ranked = F.array_sort(F.transform(F.filter(jobs, here), lambda j, i: F.struct((F.coalesce(j["role"], F.lit("")) == "").alias("bare"), (-F.coalesce(j["start_year"], F.lit(0))).alias("s"), i.alias("i"), j.alias("j"))))
    return _first(ranked)["j"]


def project_grants(projects: DataFrame) -> DataFrame:
    """Candidates of funded projects (investigators array<struct(profile_id, full_name, is_contact)>, organization, title, amount, fiscal_year, number, abstract): the contact investigator, else the first."""
    lead = F.coalesce(_first(F.filter("investigators", lambda p: F.coalesce(p["is_contact"], F.lit(False)))), _first(F.col("investigators")))
    rows = projects.withColumn("__p", lead).where("__p.full_name is not null and __p.full_name <> '' and __p.profile_id is not null")
    grant = F.struct("title", F.col("amount").cast("double").alias("amount"), F.col("fiscal_year").cast("int").alias("year"), F.col("number").cast("string").alias("source_id"))
    return rows.select(F.col("__p.profile_id").cast("string").alias("source_record_id"), F.initcap(F.lower("__p.full_name")).alias("name"), F.initcap(F.lower("organization")).alias("institution_name"), grant.alias("grant"), F.substring(F.concat_ws(". ", "title", "abstract"), 1, EVIDENCE).alias("evidence_text"))


def award_grants(awards: DataFrame) -> DataFrame:
    """Candidates of awards (id, first_name, last_name, email, awardee, title, amount and start as text, abstract); a text that begins with no number is no amount."""
    rows = awards.withColumn("name", F.trim(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))))).where("name <> '' and id is not null")
    amount = F.regexp_extract(F.col("amount").cast("string"), r"^\s*(-?\d+)", 1).try_cast("double")
    grant = F.struct("title", amount.alias("amount"), year(F.col("start").cast("string")).alias("year"), F.col("id").cast("string").alias("source_id"))
    return rows.select(F.regexp_replace(F.lower("name"), r"\s+", "-").alias("source_record_id"), "name", F.col("awardee").alias("institution_name"), F.lower("email").alias("email"), grant.alias("grant"), F.substring(F.concat_ws(". ", "title", "abstract"), 1, EVIDENCE).alias("evidence_text"))
