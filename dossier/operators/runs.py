"""Whole runs over captured records: a roster built from several sources, imports, exclusions, verification, and the refreshing of known leads.

A roster is built source by source: each sighting looks for the draft of its person among those of the sources before it, by equi-joins on keys, so no step holds
an institution in one task. Decisions and writes are columns and one join each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.functions.text import expanded_institution_key, name_key, short_name_keys
from dossier.operators import containment, identity, roster
from dossier.session import cut, spread

#: What a sighting may tell beside place, seq, source, name and orcid; all strings but the last ones.
FACTS = ["author_id", "title", "department", "email", "phone", "website", "profile_url", "keywords", "bio"]
RECORD = {"works": "int", "h_index": "int", "first_year": "int", "last_year": "int", "years_here": "array<int>", "topics": "array<struct<name:string,count:bigint,subfield:string,field:string>>", "role": "string", "role_text": "string"}
SIGHTING = "place string, seq long, source string, name string, orcid string, " + ", ".join(f"{c} string" for c in FACTS) + ", " + ", ".join(f"{c} {t}" for c, t in RECORD.items())
#: Sources whose names a parser has read, so that labels may stand among them.
PARSED = ("registry", "faculty_page")
# Labels that a parser may take for a name.
NOT_A_NAME = r"(?i)\b(professor|emerit|faculty|staff|department|chemistry|physics|engineering|science|sciences|biology|centre|center|laboratory|school|read more|view profile)\b"
EVIDENCE, REVIEW = 2000, "review-role"


def sightings(df: DataFrame) -> DataFrame:
    """df with all columns of SIGHTING; those it doesn't have are null."""
    kinds = dict(c.split(" ", 1) for c in SIGHTING.split(", ", 5 + len(FACTS))[: 5 + len(FACTS)]) | RECORD
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


#: What a sighting is matched by.
KEYS = ["__row", "seq", "place", "orcid", "full", "short"]


def _matched(index: DataFrame, rows: DataFrame, with_orcid: bool) -> DataFrame:
    """rows with the draft of the same ORCID, else of the same name (the first one), else the only one that a short form of the name fits; none whose ORCID is another.

    with_orcid: whether rows have one; those without aren't looked up by it, since all of a place would be one task."""
    by_name = index.where("full <> ''").groupBy("place", "full").agg(F.min(F.struct("draft", F.col("orcid").alias("o"))).alias("d2"))
    each = index.select("place", F.explode("short").alias("key"), F.struct("draft", F.col("orcid").alias("o")).alias("d"))
    short = each.groupBy("place", "key").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    hits = rows.select("__row", "place", F.explode("short").alias("key")).join(spread(short), ["place", "key"]).groupBy("__row").agg(F.min("low").alias("d3"), F.max("high").alias("high"))
    hits = hits.where("d3.draft = high.draft").select("__row", "d3")
    if with_orcid:
        by_orcid = index.where("orcid is not null").groupBy("place", "orcid").agg(F.min("draft").alias("d1"))
        rows = rows.join(spread(by_orcid), ["place", "orcid"], "left")
    else:
        rows = rows.withColumn("d1", F.lit(None).cast("long"))
    found = rows.join(spread(by_name), ["place", "full"], "left").join(spread(hits), "__row", "left")
    fits = lambda d: F.coalesce(F.col("orcid") == F.col(f"{d}.o"), F.lit(True))
    own = F.when(F.col("d1").isNotNull(), F.col("d1")).when(F.col("d2").isNotNull(), F.when(fits("d2"), F.col("d2.draft"))).when(F.col("d3").isNotNull() & fits("d3"), F.col("d3.draft"))
    return found.select(*KEYS, own.alias("draft"))


def drafted(seen: DataFrame, sources: list[str], listed: tuple[str, ...] = ("openalex",), parsed: tuple[str, ...] = PARSED) -> DataFrame:
    """Sightings with the draft that each belongs to (the smallest seq of its sightings), taken source by source; of a source those with an ORCID first.

    Rows of the sources `listed` are a person each; in those of `parsed` labels are no names. Of the rows that find the same draft without an ORCID, those of the ORCID that comes first
    stay; another ORCID is another person. New rows of one step with the same ORCID, or without one and with the same name, are one person.

    Rows are dealt out first, for a small file of many rows would be the work of one task; their keys are worked out once, and only keys go from step to step."""
    label = F.col("source").isin(*parsed) & F.col("name").rlike(NOT_A_NAME)
    rows = seen.where(F.col("source").isin(*sources) & ~F.coalesce(label, F.lit(False)))
    rows = cut(rows.repartition(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq").withColumn("__row", F.monotonically_increasing_id()))
    keys = cut(rows.select("__row", "seq", "place", "orcid", "source", name_key("name").alias("full"), short_name_keys("name").alias("short")))
    present = {tuple(r) for r in keys.select("source", F.col("orcid").isNotNull()).distinct().collect()}  # two a source at most
    done = []
    for source in sources:
        for with_orcid in (True, False):
            if (source, with_orcid) not in present:
                continue
            own = keys.where((F.col("source") == source) & (F.col("orcid").isNotNull() if with_orcid else F.col("orcid").isNull())).select(*KEYS)
            if source in listed or (source == sources[0] and with_orcid):
                done.append(own.withColumn("draft", F.col("seq")))
                continue
            if done:
                named, told = F.min(F.struct("seq", "place", "full", "short")).alias("x"), F.min_by("orcid", F.when(F.col("orcid").isNotNull(), F.col("seq"))).alias("orcid")
                known = reduce(DataFrame.unionByName, done).groupBy("draft").agg(named, told).select("draft", "x.place", "x.full", "x.short", "orcid")
                met = cut(_matched(known, own, with_orcid)) if with_orcid else _matched(known, own, with_orcid)
            else:
                met = own.withColumn("draft", F.lit(None).cast("long"))
            if with_orcid:
                # what found its draft by another key than the ORCID: the first ORCID takes the draft
                old = met.where("draft is not null")
                taken = old.groupBy("draft").agg(F.min_by("orcid", "seq").alias("__first"))
                old = old.join(spread(taken), "draft").withColumn("draft", F.when(F.col("orcid") == F.col("__first"), F.col("draft"))).drop("__first")
                met = met.where("draft is null").unionByName(old)
            first = F.min("seq").over(W.partitionBy("place", F.coalesce("orcid", F.concat(F.lit("name:"), "full"))))
            done.append(cut(met.withColumn("draft", F.coalesce("draft", F.when(F.col("draft").isNull(), first)))))
    drafts = reduce(DataFrame.unionByName, done).select("__row", "draft") if done else keys.select("__row", F.col("seq").alias("draft"))
    return cut(rows.join(spread(drafts), "__row").drop("__row"))


def people(assigned: DataFrame, as_of_year: int) -> DataFrame:
    """One row a draft: of each fact the first that a source tells, all keywords, the strongest role with its source and words, whether the record speaks for seniority, and the key of the name."""
    facts = ["place", "name", "orcid", *FACTS[:-2], "bio", *[c for c in RECORD if c not in ("role", "role_text")]]
    one = identity.first_values(assigned, "draft", "seq", facts)
    category = F.coalesce("role", F.when(F.col("title").isNotNull(), rules.role(F.col("title"))["category"]), F.lit("unknown"))
    roles = assigned.where(~F.col("source").isin("openalex")).withColumn("category", category).withColumn("own", F.struct("seq", "source", "category", "title", "role_text"))
    # a list of distinct statements: the first of each source and category is all that the fold can choose
    roles = roles.groupBy("draft", "source", "category").agg(F.min("own").alias("own")).groupBy("draft").agg(rules.strongest_role(F.collect_list("own")).alias("stated"))
    said = assigned.where("keywords is not null").groupBy("draft", "keywords").agg(F.min("seq").alias("seq"))
    words = said.groupBy("draft").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "keywords"))), lambda x: x["keywords"])).alias("words"))
    sources = assigned.groupBy("draft").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or((F.col("source") == "faculty_page") & F.col("title").isNotNull()).alias("titled"))
    out = one.join(roles, "draft", "left").join(words, "draft", "left").join(sources, "draft")
    senior = rules.seniority(F.col("works"), F.col("h_index"), F.col("first_year"), F.col("last_year"), F.col("years_here"), F.col("name"), as_of_year)
    words_of = F.when(F.col("stated.category") == "excluded", F.coalesce("stated.role_text", rules.excluded_match(F.col("stated.title")))).otherwise(F.col("stated.role_text"))
    out = out.withColumns({"senior": F.coalesce(senior, F.lit(False)), "stated_text": words_of})
    stale = roster.stale_student(F.col("stated.source"), F.col("stated_text"), F.col("first_year"), as_of_year)
    return out.withColumns({"stale_title": F.coalesce(stale, F.lit(False)), "stated": F.coalesce("stated.category", F.lit("unknown")), "name_key": name_key("name")})


def _key(drafts: DataFrame) -> Column:
    """The key of a draft's name, as people has left it."""
    return F.col("name_key") if "name_key" in drafts.columns else name_key("name")


def _domain(drafts: DataFrame) -> DataFrame:
    topics = F.coalesce("topics", F.array().cast(RECORD["topics"]))
    return rules.with_domain(drafts, F.col("department"), topics, F.concat_ws(" ", "words", "bio", F.transform(topics, lambda t: t["name"])), "domain")


def decided(drafts: DataFrame, pinned: Column | None = None, infer: bool = True, persons: DataFrame | None = None) -> DataFrame:
    """drafts with decision (outcome, role), domain and reason (why one is excluded); a name without letters that a key can hold is dropped.

    persons: orcid, keywords, emails, urls (as lists.orcid_person leaves them), one row an ORCID. Who would be excluded for a domain that needs words of their own, and has an ORCID, is
    looked up there: the keywords join the words, gaps of e-mail and website are filled, and the domain is decided once more."""
    stale = F.col("stale_title") if "stale_title" in drafts.columns else None
    choose = lambda rows: rows.withColumn("decision", roster.decision(F.col("stated"), F.col("senior"), F.col("domain"), pinned, infer, stale))
    rows = choose(_domain(drafts))
    if persons is not None:
        rows = cut(rows)
        again = (F.col("decision.outcome") == "excludedDomain") & F.col("orcid").isNotNull() & F.col("domain.domain").isin(*rules.GATED, "other")
        p = persons.select("orcid", F.col("keywords").alias("__k"), F.get("emails", F.lit(0)).alias("__e"), F.get("urls", F.lit(0))["url"].alias("__u"))
        asked = rows.where(again).drop("domain", "decision").join(p, "orcid", "left")
        asked = asked.withColumns({"words": F.concat_ws(" ", "words", F.concat_ws(" ", "__k")), "email": F.coalesce("email", "__e"), "website": F.coalesce("website", "__u")}).drop("__k", "__e", "__u")
        rows = rows.where(~F.coalesce(again, F.lit(False))).unionByName(choose(_domain(asked)))
    unnamed = F.struct(F.lit("droppedUnconfirmed").alias("outcome"), F.col("stated").alias("role"))
    rows = rows.withColumn("decision", F.when(_key(drafts) == "", unnamed).otherwise(F.col("decision")))
    title = F.coalesce("title", "stated_text") if "stated_text" in rows.columns else F.col("title")
    by = F.col("decision.outcome")
    return rows.withColumn("reason", F.when(by == "excludedRole", F.concat(F.lit("role: "), F.coalesce(title, F.lit("")))).when(by == "excludedDomain", rules.domain_reason(F.col("domain.domain"), F.col("department"))))


def known_members(drafts: DataFrame, members: DataFrame) -> DataFrame:
    """drafts with the member (column member) that the first of ORCID, author id, name at the place, and e-mail finds."""
    c = F.col
    keys = [
        ("orcid", [c("orcid")], [c("m_orcid")]), ("author", [c("author_id")], [c("m_author_id")]),
        ("name", [c("place"), F.nullif(_key(drafts), F.lit(""))], [c("m_place"), F.nullif(name_key("m_name"), F.lit(""))]), ("email", [F.lower("email")], [F.lower("m_email")]),
    ]
    known = members.select("member_id", *(c(k).alias(f"m_{k}") for k in ("orcid", "author_id", "place", "name", "email")))
    return identity.cascade(drafts, known, keys, "member_id", "member", "via")


def stored(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """decisions with the outcome of the write: kept ones are created or updated."""
    rows = known_members(decisions, members)
    kept = F.col("decision.outcome") == "kept"
    return rows.withColumn("outcome", F.when(kept, F.when(F.col("member").isNull(), "created").otherwise("updated")).otherwise(F.col("decision.outcome")))


def excluded_if_known(outcomes: DataFrame, members: DataFrame) -> DataFrame:
    """Members after the drafts that were excluded: they are excluded too unless more is known of them than the draft tells (a department of record against a draft without one, a title
    from a page against a role); promoted ones get a tag for review instead. members: member_id, status, tags, department, sources array<struct(type, title)>; a column exclusion_reason
    gets the reason of the first such draft (by seq)."""
    c = F.col
    out = outcomes.where(c("outcome").isin("excludedRole", "excludedDomain") & c("member").isNotNull())
    why = F.struct(c("seq") if "seq" in out.columns else F.lit(0), c("reason") if "reason" in out.columns else F.lit(None).cast("string").alias("reason"))
    kind = F.when(c("outcome") == "excludedRole", "by_role").when(c("department").isNotNull(), "by_department").otherwise("by_topics")
    first = out.select(c("member").alias("member_id"), kind.alias("kind"), why.alias("why")).groupBy("member_id").agg(*(F.min(F.when(c("kind") == k, c("why"))).alias(k) for k in ("by_role", "by_department", "by_topics")))
    titled = F.exists("sources", lambda s: (s["type"] == "faculty_page") & s["title"].isNotNull())
    reasons = F.least(F.when(~F.coalesce(titled, F.lit(False)), c("by_role")), c("by_department"), F.when(c("department").isNull(), c("by_topics")))
    rows = members.join(first, "member_id", "left").withColumn("__why", F.when(c("status") != "excluded", reasons))
    promoted, hit = c("status") == "promoted", c("__why").isNotNull()
    marked = hit & ~(promoted & F.array_contains("tags", REVIEW))
    new = {"tags": F.when(hit & promoted, F.array_union("tags", F.array(F.lit(REVIEW)))).otherwise(c("tags")), "status": F.when(hit & ~promoted, "excluded").otherwise(c("status"))}
    if "exclusion_reason" in members.columns:
        new["exclusion_reason"] = F.when(marked, c("__why.reason")).otherwise(c("exclusion_reason"))
    return rows.withColumns(new).select(*members.columns)


OUTCOMES = ["created", "updated", "excludedRole", "excludedDomain", "droppedUnconfirmed"]


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """How many drafts ended in each way, by place or in all."""
    return outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def pinned_places(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Entries of an always-keep list (orcid, author_id, name, institution) with the places their institution may be: one that holds the other by its key. Without an institution the name
    counts anywhere (place null), with one that is nowhere known at no place (an empty one)."""
    known = places.select("place", expanded_institution_key("institution").alias("k")).where("k <> ''").distinct()
    rows = entries.withColumn("key", expanded_institution_key("institution"))
    pairs = containment.either_way(rows.select("key"), "key", known, "k").join(known, "k").select("key", F.col("place").alias("found")).distinct()
    where = F.when(F.coalesce(F.trim("institution"), F.lit("")) != "", F.coalesce("found", F.lit("")))
    return rows.join(pairs, "key", "left").select("orcid", "author_id", "name", where.alias("place"))


def _pinned(drafts: DataFrame, pinned: DataFrame) -> DataFrame:
    c = F.col
    own, theirs = (F.nullif(k, F.lit("")) for k in (_key(drafts), name_key("p_name")))
    keys = [("orcid", [c("orcid")], [c("p_orcid")]), ("author", [c("author_id")], [c("p_author_id")]), ("here", [own, c("place")], [theirs, c("p_place")]), ("name", [own], [F.when(c("p_place").isNull(), theirs)])]
    entries = pinned.select(*(c(k).alias(f"p_{k}") for k in ("orcid", "author_id", "name", "place"))).withColumn("entry", F.lit(1))
    return roster.pinned_by(drafts, entries, keys, "entry")


def build(seen: DataFrame, members: DataFrame, as_of_year: int, sources: list[str], pinned: DataFrame | None = None, infer: bool = True, persons: DataFrame | None = None) -> DataFrame:
    """A roster build: sightings of all sources to drafts, decisions and outcomes. pinned: orcid, author_id, name, place (null: anywhere) of people who are kept whatever their department;
    persons: see decided."""
    drafts = cut(people(drafted(sightings(seen), sources), as_of_year))
    if pinned is not None:
        drafts = _pinned(drafts, pinned)
    return stored(decided(drafts, F.col("pinned") if pinned is not None else None, infer, persons), members)


def registry_rows(cards: DataFrame, names: DataFrame, as_of_year: int) -> DataFrame:
    """Cards of a registry that speak of a place: not a label, not a position that ended, no student's or guest's designation, and the institute named there is the place.

    cards: place, name, institute, card_text, designation, years; names: place, name (all spellings of a place). An institute's key equals or holds one of the place's keys, or lies in
    it with three words or more; or a spelling of six letters stands in its text."""
    own = cards.withColumn("__row", F.xxhash64(*cards.columns))
    span = F.regexp_extract("years", r"(\d{4})\s*[-–]\s*(\d{4})", 2)
    ended = F.coalesce(F.nullif(span, F.lit("")).cast("int") < as_of_year, F.lit(False))
    fit = (F.coalesce(F.trim("name"), F.lit("")) != "") & ~F.col("name").rlike(NOT_A_NAME) & ~ended & (rules.role(F.col("designation"))["category"] != "excluded")
    own = own.where(fit).withColumns({"__key": expanded_institution_key("institute"), "__text": F.concat_ws(" ", F.coalesce("institute", F.lit("")), F.coalesce("card_text", F.lit("")))})
    known = names.select("place", "name", expanded_institution_key("name").alias("__k")).distinct()
    by_key = containment.either_way(known, "__k", own, "__key", 3).join(known, "__k").select("place", "__key").distinct()
    by_name = containment.named_in(own, "__text", known, "name").join(known.select("place", "name"), "name").select("place", "__text").distinct()
    here = own.join(by_key, ["place", "__key"], "left_semi").unionByName(own.join(by_name, ["place", "__text"], "left_semi")).dropDuplicates(["__row"])
    return here.select(*cards.columns)


def employed_here(employments: DataFrame, names: DataFrame) -> DataFrame:
    """place, orcid and the employment that places somebody there: a current one at the place's registry number, or at an organisation whose key equals or holds one of the place's, or
    lies in one with three words or more. One with a role first, then the latest.

    employments: orcid, organization, org_id, role, department, start_year, current; names: place, name, ror."""
    now = employments.where("current").withColumn("key", expanded_institution_key("organization"))
    known = names.select("place", F.lower("ror").alias("ror"), expanded_institution_key("name").alias("k")).distinct()
    by_key = containment.either_way(known, "k", now, "key", 3).join(known.select("place", "k"), "k").select("place", "key").distinct()
    here = now.join(by_key, "key").unionByName(now.join(known.select("place", "ror").distinct().withColumnRenamed("ror", "__r"), F.lower("org_id") == F.col("__r")).drop("__r").select(*now.columns, "place"))
    best = F.struct(F.col("role").isNotNull().alias("has"), F.coalesce("start_year", F.lit(0)).alias("year"), F.struct("organization", "role", "department", "start_year").alias("job"))
    return here.groupBy("place", "orcid").agg(F.max(best).alias("x")).select("place", "orcid", "x.job.*")


def imported(rows: DataFrame, places: DataFrame, members: DataFrame, pinned: DataFrame | None = None, persons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes of an imported list (name, institution, department, title, email, orcid, profile_url, keywords, phone, website, bio) under the same decisions, and rows of institutions that aren't known.

    places: place, institution. A row belongs to the first place, in their order, whose institution's key is the row's, holds it or lies in it. A list of staff is evidence of rank where no
    title is given. pinned: orcid, author_id, name, institution of people who are always kept; persons: see decided."""
    known = places.select("place", expanded_institution_key("institution").alias("k")).where("k is not null")
    keyed = cut(rows.where(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn("key", expanded_institution_key("institution")))
    own = keyed.join(containment.first_place(keyed.select("key"), "key", known, "k", "place"), "key", "left")
    clean = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in FACTS if c in rows.columns}
    own = own.withColumns(clean).withColumns({"email": F.lower("email"), "orcid": F.nullif(F.regexp_extract("orcid", r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", 0), F.lit("")), "website": F.when(F.col("website").rlike("(?i)^https?://"), F.col("website")), "bio": F.substring("bio", 1, 4000)})
    seen = sightings(own.where("place is not null").withColumns({"source": F.lit("import"), "role": F.when(F.col("title").isNull(), "professor")}).withColumn("seq", F.col("row_id")))
    drafts = cut(people(seen.withColumn("draft", F.col("seq")), 0))
    if pinned is not None:
        drafts = _pinned(drafts, pinned_places(pinned, places))
    return stored(decided(drafts, F.col("pinned") if pinned is not None else None, False, persons), members), own.where("place is null").select(*rows.columns)


def refreshed(leads: DataFrame, candidates: DataFrame, key: str, blanks: list[str], lists: dict[str, int]) -> DataFrame:
    """Known leads after candidates of the same key (one row each): gaps are filled, never a value that is there; lists are joined without repeats up to a length, the lead's own first; `change` says what happened.

    change: unchanged where the candidate's content_hash is the lead's and it was scored, else refreshed; kept without a candidate; created for a new one."""
    old, new = leads.select(key, F.struct(*leads.columns).alias("o")), candidates.select(key, F.struct(*candidates.columns).alias("n"))
    both = old.join(new, key, "full_outer")
    same = F.coalesce((F.col("o.content_hash") == F.col("n.content_hash")) & F.col("o.scored"), F.lit(False))
    change = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "kept").when(same, "unchanged").otherwise("refreshed")
    out = []
    for c in leads.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in candidates.columns else F.lit(None)
        if c == key:
            out.append(F.col(key))
        elif c in lists:
            none = F.array().cast(leads.schema[c].dataType)
            joined = F.slice(F.array_distinct(F.concat(F.coalesce(o, none), F.coalesce(n, none))), 1, lists[c])
            out.append(F.when(change == "unchanged", o).otherwise(joined).alias(c))
        elif c in blanks:
            out.append(F.when(change == "unchanged", o).otherwise(F.coalesce(F.nullif(o, F.lit("")), n)).alias(c))
        elif c == "content_hash":
            out.append(F.coalesce(n, o).alias(c))
        else:
            out.append(F.coalesce(o, n).alias(c))
    return both.select(*out, change.alias("change"))


def verified(members: DataFrame, assessment: Column, targets: DataFrame, name: str = "affiliation") -> DataFrame:
    """Members after a verification: status and place of the assessment struct(status, name, id), whether the new place is outside the targets (target_id), which only those who moved can be."""
    wanted = targets.select(F.col("target_id").alias("__t")).distinct()
    rows = members.withColumn(name, assessment)
    rows = rows.join(wanted, F.col(f"{name}.id") == F.col("__t"), "left")
    moved = F.col(f"{name}.status") == "moved"
    return rows.withColumn("outside_target", moved & F.col("__t").isNull()).drop("__t")


def verify_counts(rows: DataFrame, name: str = "affiliation") -> DataFrame:
    status = F.col(f"{name}.status")
    return rows.agg(F.count("*").alias("checked"), *(F.count_if(status == s).alias(s) for s in ("current", "moved", "unknown")), F.count_if(status.isNull()).alias("unverified"), F.count_if(F.col("outside_target")).alias("outside"))
