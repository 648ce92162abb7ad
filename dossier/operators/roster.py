"""Rosters of people: who is kept and why, how drafts meet members, who becomes a lead, whose instruments were seen, what a review changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.operators.identity import cascade
from dossier.operators.mining import merged_detections

#: Years after the first paper from which an open entry as a student is taken for a stale one.
STALE_STUDENT = 12
# Paths and labels of listings that hold no current faculty, and words of a student's title.
NON_FACULTY_PAGE = r"(?i)(visiting|adjunct|retired|former|emerit|alumni|student|scholar|phd|postdoc|off-staff|staff-directory|technical-staff|non-teaching|office|/staff/?$)"
STUDENT = r"(?i)student|scholar|ph\.?\s?d|doctoral|m\.?\s?tech|m\.?\s?sc|candidate|graduate"


def decision(role: Column, senior: Column, domain: Column, pinned: Column | None = None, infer: bool = True, stale_title: Column | None = None) -> Column:
    """struct(outcome, role) of a draft: kept, excludedRole, excludedDomain or droppedUnconfirmed.

    senior: does the publication record speak for a researcher; it stands in for an unknown role, and for a student's title that is stale. A pinned person is
    kept whatever the domain, unless the role is excluded."""
    senior = F.coalesce(senior, F.lit(False)) & F.lit(infer)
    pinned = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    stale = F.coalesce(stale_title, F.lit(False)) if stale_title is not None else F.lit(False)
    rescued = senior & ~pinned & ((role == "unknown") | ((role == "excluded") & stale))
    final = F.when(rescued, "inferred").when(pinned & ~role.isin([*rules.FACULTY_ROLES, "excluded"]), "professor").otherwise(role)
    outcome = F.when(final == "excluded", "excludedRole").when(~final.isin(rules.FACULTY_ROLES), "droppedUnconfirmed").when(pinned | domain["kept"], "kept").otherwise("excludedDomain")
    return F.struct(outcome.alias("outcome"), final.alias("role"))


def stale_student(source: Column, matched: Column, first_year: Column, as_of_year: int) -> Column:
    """A student's title in a self-kept record of somebody who has published for long."""
    return (source == "orcid") & F.coalesce(matched, F.lit("")).rlike(STUDENT) & (as_of_year - first_year >= STALE_STUDENT)


def non_faculty(path: Column) -> Column:
    """Whether a listing's path speaks of guests, staff, students or people who left."""
    return F.coalesce(path.rlike(NON_FACULTY_PAGE), F.lit(False))


def page_role(title: Column, url: Column, label: Column) -> Column:
    """struct(category, matched) of somebody on a page: by the title; without one a professor where the address or the label of its link says faculty and neither speaks of others."""
    words = F.concat_ws(" ", url, F.coalesce(label, F.lit("")))
    path = F.concat_ws(" ", F.regexp_replace(url, r"^[a-zA-Z]+://[^/]*|[?#].*$", ""), F.coalesce(label, F.lit("")))
    listed = words.rlike("(?i)faculty|professor") & ~non_faculty(path)
    by_list = F.struct(F.when(listed, "professor").otherwise("unknown").alias("category"), F.when(listed, "listed on a faculty page").alias("matched"))
    return F.when(F.coalesce(title, F.lit("")) != "", rules.role(title)).otherwise(by_list)


def pinned_by(drafts: DataFrame, entries: DataFrame, keys: list[tuple[str, list[Column], list[Column]]], entry_id: str, name: str = "pinned") -> DataFrame:
    """drafts with whether an entry of the list shares any of the keys: equi-joins in turn, so no pair is compared that shares none."""
    return cascade(drafts, entries, keys, entry_id, "__entry", "__via").withColumn(name, F.col("__entry").isNotNull()).drop("__entry", "__via")


def merge_members(members: DataFrame, drafts: DataFrame, key: str, blanks: list[str], largest: list[str], union: dict[str, int], status: str = "status") -> DataFrame:
    """Members after drafts of the same key: blanks are filled, the larger number stays, lists are joined without repeats up to a length, an excluded one is eligible
    again and a promoted one is left so. Drafts of no member become eligible ones. One shuffle by key; both sides must have one row a key."""
    old, new = members.select(key, F.struct(*members.columns).alias("o")), drafts.select(key, F.struct(*drafts.columns).alias("d"))
    out = []
    for c in members.columns:
        o, d = F.col(f"o.{c}"), F.col(f"d.{c}") if c in drafts.columns else F.lit(None)
        if c == key:
            out.append(F.col(key))
        elif c == status:
            out.append(F.when(F.col("o").isNull() | (F.col("d").isNotNull() & (o == "excluded")), "eligible").otherwise(o).alias(c))
        elif c in blanks:
            out.append(F.coalesce(F.nullif(o, F.lit("")), d).alias(c))
        elif c in largest:
            out.append(F.greatest(o, d).alias(c))
        elif c in union:
            none = F.array().cast(members.schema[c].dataType)
            out.append(F.slice(F.array_distinct(F.concat(F.coalesce(o, none), F.coalesce(d, none))), 1, union[c]).alias(c))
        else:
            out.append(F.coalesce(o, d).alias(c))
    seen = F.when(F.col("o").isNull(), "created").when(F.col("d").isNull(), "kept").otherwise("updated")
    return old.join(new, key, "full_outer").select(*out, seen.alias("change"))


def promotion(members: DataFrame, leads: DataFrame, keys: list[tuple[str, list[Column], list[Column]]], lead_id: str, score: Column, owner: Column, eligible: Column, threshold: float = 40) -> DataFrame:
    """Eligible members with `outcome`: belowThreshold, alreadyInCrm (a lead shares a key, the first of them by order) or promoted; and whether an instrument alone lets them in."""
    below = F.coalesce(score, F.lit(-1)) < threshold
    owner = F.coalesce(owner, F.lit(False))
    rows = cascade(members.where(eligible).withColumns({"__below": below & ~owner, "by_instrument": below & owner}), leads, keys, lead_id, "lead_id", "via")
    out = F.when(F.col("__below"), "belowThreshold").when(F.col("lead_id").isNotNull(), "alreadyInCrm").otherwise("promoted")
    return rows.withColumn("outcome", out).withColumn("lead_id", F.when(~F.col("__below"), F.col("lead_id"))).drop("__below", "via")


def swept(members: DataFrame, sightings: DataFrame, keys: list[tuple[str, list[Column], list[Column]]], member_id: str, seq: str, brand: str, model: str, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """Members with the instruments seen, in the order seen, and how many they are; and sightings of nobody known.

    A sighting finds its member by the first key with a hit; sightings are made distinct by member, brand and model before a list is built."""
    found = cascade(sightings, members, keys, member_id, "__member", "__via")
    own = found.where("__member is not null").groupBy("__member", brand, F.lower(F.coalesce(model, F.lit(""))).alias("__low")).agg(F.min(seq).alias("__s"), F.min_by(model, seq).alias("__m"))
    item = F.struct(F.col("__s").alias("s"), F.col(brand).alias("brand"), F.col("__m").alias("model"))
    lists = own.groupBy(F.col("__member").alias(member_id)).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["brand"].alias("brand"), x["model"].alias("model"))).alias("__all"))
    tagged = lists.select(member_id, merged_detections(F.col("__all"), limit).alias("instruments"))
    return members.join(tagged, member_id), found.where("__member is null").drop("__member", "__via")


def same_instruments(a: Column, b: Column) -> Column:
    """Whether two lists name the same brands and models, whatever their order."""
    key = lambda xs: F.array_join(F.array_sort(F.transform(xs, lambda x: F.concat_ws("|", x["brand"], F.coalesce(x["model"], F.lit(""))))), ",")
    return key(a) == key(b)


def review(leads: DataFrame, decided: str, chosen: Column, status: str = "status", pending: str = "pending_review") -> DataFrame:
    """leads with those decided that are chosen and still wait; `reviewed` tells which."""
    now = F.coalesce((F.col(status) == pending) & chosen, F.lit(False))
    return leads.withColumn("reviewed", now).withColumn(status, F.when(F.col("reviewed"), decided).otherwise(F.col(status)))
