"""Is a person still at an institution? Evidence of several sources under one precedence, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import expanded_institution_key, institution_key, once


def same_institution(name: Column, id_: Column, other: Column, key: Column | None = None) -> Column:
    """By id, by the id of a unit's parents, or by names of which one holds the other. other: struct(id, name, lineage); key: the expanded key of name, where it is known."""
    a = expanded_institution_key(name) if key is None else key
    by_id = F.coalesce((id_ == other["id"]) | F.array_contains(other["lineage"], id_), F.lit(False))
    return by_id | F.coalesce(once(expanded_institution_key(other["name"]), lambda b: F.contains(a, b) | F.contains(b, a)), F.lit(False))


def assessment(name: Column, id_: Column, last_known: Column, history: Column, as_of_year: int, key: Column | None = None) -> Column:
    """struct(status, name, id, last_seen). last_known: array of struct(id, name, lineage); history: the same with years."""
    ours = F.get(F.filter(history, lambda h: same_institution(name, id_, h, key)), F.lit(0))
    first = F.get(last_known, F.lit(0))
    there = F.get(F.filter(history, lambda h: h["id"] == first["id"]), F.lit(0))
    year_there = F.when(there.isNull(), as_of_year).otherwise(F.coalesce(F.array_max(there["years"]), F.lit(0)))
    still = F.filter(last_known, lambda k: same_institution(name, id_, k, key))
    found = F.struct(F.coalesce(F.array_max(ours["years"]), F.lit(0)).alias("here"), still.alias("still"), first.alias("first"), year_there.alias("year_there"))

    def told(x: Column) -> Column:
        here, still, first = x["here"], x["still"], x["first"]
        status = F.when(F.size(still) > 0, "current").when(first.isNotNull(), F.when((here > 0) & (here >= x["year_there"]), "current").otherwise("moved")).when(here >= as_of_year - 2, "current").otherwise("unknown")
        new_name = F.when(status == "current", name).when(status == "moved", first["name"])
        new_id = F.when(status == "current", F.coalesce(id_, F.get(still, F.lit(0))["id"])).when(status == "moved", first["id"])
        return F.struct(status.alias("status"), new_name.alias("name"), new_id.alias("id"), F.nullif(here, F.lit(0)).alias("last_seen"))

    return once(found, told)


#: What a source says of somebody.
EVIDENCE = "struct<source:string,institution:string,current:boolean,url:string,detail:string>"


def _said(source, institution=None, current=None, url=None, detail=None) -> Column:
    value = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(value(source, "string").alias("source"), value(institution, "string").alias("institution"), value(current, "boolean").alias("current"), value(url, "string").alias("url"), value(detail, "string").alias("detail"))


def _words(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def evidence(name: Column, registry: Column, orcid: Column, papers: Column) -> Column:
    """array<EVIDENCE> of all that the sources say, whichever decides: the directory, registries, open employments, the latest papers; a source that was asked and knows nothing says so.

    registry: struct(directory_checked, directory_listed, directory_url, hits array<struct(source, institution, profile_url, designation, department)>); orcid: struct(employments
    array<struct(organization, role, department, start_year, current)>); papers: struct(last_known array<struct(id, name, lineage, country)>, affiliations array<struct(id, name, lineage,
    years)>). Each may be null: it wasn't asked."""
    none = F.array().cast(f"array<{EVIDENCE}>")
    part = lambda on, rows: F.when(F.coalesce(on, F.lit(False)), rows).otherwise(none)
    listed = registry["directory_listed"]
    directory = _said("directory", F.when(listed, name), listed, registry["directory_url"], F.when(listed, "Listed in the institute faculty directory").otherwise("Not found in the institute faculty directory"))
    hits = F.transform(F.filter(registry["hits"], lambda h: h["source"] != "directory"), lambda h: _said(h["source"], h["institution"], F.when(F.coalesce(h["institution"], F.lit("")) != "", True), h["profile_url"], _words(h["designation"], h["department"])))
    jobs = F.filter(orcid["employments"], lambda e: e["current"])
    since = lambda e: F.when(F.coalesce(e["start_year"], F.lit(0)) != 0, F.concat(F.lit("since "), e["start_year"]))
    open_jobs = F.transform(jobs, lambda e: _said("orcid", e["organization"], True, None, _words(e["role"], e["department"], since(e))))
    years = lambda i: F.array_max(F.get(F.filter(papers["affiliations"], lambda a: a["id"] == i["id"]), F.lit(0))["years"])
    named = F.transform(papers["last_known"], lambda i: _said("openalex", i["name"], True, None, F.concat(F.lit("Named on the latest indexed work"), F.coalesce(F.concat(F.lit(" ("), years(i), F.lit(")")), F.lit("")))))
    return F.concat(
        part(registry["directory_checked"], F.array(directory)), F.coalesce(hits, none), F.coalesce(open_jobs, none), part(orcid.isNotNull() & (F.coalesce(F.size(jobs), F.lit(0)) <= 0), F.array(_said("orcid", detail="No current employment on the ORCID record"))),
        F.coalesce(named, none), part(papers.isNotNull() & (F.coalesce(F.size(papers["last_known"]), F.lit(0)) <= 0), F.array(_said("openalex", detail="No last-known institution on the author record"))),
    )


def with_affiliation(df: DataFrame, name: Column, id_: Column, registry: Column, orcid: Column, papers: Column, as_of_year: int, out: str = "affiliation", known: Column | None = None) -> DataFrame:
    """df with struct(status, source, name, id, country, previous, previous_id, last_seen, directory_listed, note, evidence): where somebody is now.

    The first source with a positive answer decides: a directory that lists the person; a registry's profile that names an institution (irins before others); an open employment, if the papers don't
    place the person here after it began; then what the latest papers say; else unverified. known: a map of institution keys to ids, for institutions that only have a name. What patterns
    find is in columns of its own, so each name is looked at once. Rows are dealt out first: a small file of many rows would be the work of one task."""
    inst = lambda n: F.struct(F.lit(None).cast("string").alias("id"), n.alias("name"), F.lit(None).cast("array<string>").alias("lineage"))
    here = lambda n: same_institution(name, id_, inst(n), F.col("__key"))
    hits = F.filter(registry["hits"], lambda h: (h["source"] != "directory") & (F.coalesce(h["institution"], F.lit("")) != ""))
    first = lambda rows: F.get(rows, F.lit(0))
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.withColumn("__key", expanded_institution_key(name)).withColumns({
        "__hit": F.coalesce(first(F.filter(hits, lambda h: h["source"] == "irins")), first(hits)), "__jobs": F.coalesce(F.filter(orcid["employments"], lambda e: e["current"]), F.filter(F.array(F.lit(None)).cast("array<struct<organization:string,role:string,department:string,start_year:int,current:boolean>>"), lambda e: e.isNotNull())),
        "__there": F.when(papers.isNotNull(), assessment(name, id_, papers["last_known"], papers["affiliations"], as_of_year, F.col("__key"))), "__listed": F.when(F.coalesce(registry["directory_checked"], F.lit(False)), F.coalesce(registry["directory_listed"], F.lit(False))),
        "__evidence": evidence(name, registry, orcid, papers),
    })
    rows = rows.withColumns({"__hit_here": here(F.col("__hit.institution")), "__job": first(F.filter("__jobs", lambda e: here(e["organization"]))), "__new": first(F.col("__jobs"))})
    c, t = F.col, F.col("__there")
    last, year = t["last_seen"], F.concat
    elsewhere = first(papers["last_known"])
    was = F.coalesce(F.nullif(name, F.lit("")), F.lit("the previous institute"))
    found_id = lambda n: F.element_at(known, institution_key(n)) if known is not None else F.lit(None).cast("string")
    title = F.when(c("__hit.source") == "irins", "IRINS").otherwise("Vidwan")
    since = F.when(F.coalesce(c("__job.start_year"), F.lit(0)) != 0, F.concat(F.lit(" since "), c("__job.start_year"))).otherwise("")
    since_new = F.when(F.coalesce(c("__new.start_year"), F.lit(0)) != 0, F.concat(F.lit(" since "), c("__new.start_year"))).otherwise("")
    stale_job = F.coalesce(F.coalesce(last, F.lit(0)) > c("__new.start_year"), F.lit(False))
    there = first(F.filter(papers["affiliations"], lambda h: h["id"] == elsewhere["id"]))
    year_there = F.when(there.isNull(), as_of_year).otherwise(F.coalesce(F.array_max(there["years"]), F.lit(0)))
    still = F.exists(papers["last_known"], lambda k: same_institution(name, id_, k, F.col("__key")))
    told = F.when(t["status"] == "moved", year(F.lit("Latest work ("), year_there, F.lit(") is from "), elsewhere["name"], F.lit("; last seen at "), was, F.lit(" in "), F.coalesce(last.cast("string"), F.lit("an earlier year")), F.lit(".")))
    told = told.when(t["status"] == "unknown", F.when(last.isNotNull(), year(F.lit("Last seen at "), F.coalesce(name, F.lit("")), F.lit(" in "), last, F.lit("; no current affiliation on record."))).otherwise("No affiliation history on record."))
    told = told.when((t["status"] == "current") & elsewhere.isNotNull() & ~F.coalesce(still, F.lit(False)), year(F.lit("Also affiliated with "), elsewhere["name"]))
    missing = F.when(c("__listed") == F.lit(False), "Not found in the institute faculty directory.")

    def decide(status, source, n, i, note, moved=None, seen=None, listed=c("__listed"), country=None) -> Column:
        value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
        moved = moved if moved is not None else F.lit(False)
        return F.struct(
            value(status).alias("status"), value(source).alias("source"), value(n).alias("name"), value(i).alias("id"), value(country).alias("country"), F.when(moved, name).alias("previous"), F.when(moved, id_).alias("previous_id"),
            (seen if seen is not None else F.lit(None)).cast("int").alias("last_seen"), listed.cast("boolean").alias("directory_listed"), value(note).alias("note"), c("__evidence").alias("evidence"),
        )

    yes, hit, new = F.lit(True), c("__hit.institution"), c("__new.organization")
    out_ = (
        F.when(c("__listed"), decide("current", "directory", name, id_, "Listed in the institute faculty directory.", listed=yes))
        .when(c("__hit").isNotNull() & c("__hit_here"), decide("current", c("__hit.source"), name, id_, F.concat(title, F.lit(" profile names "), hit, F.lit("."))))
        .when(c("__hit").isNotNull(), decide("moved", c("__hit.source"), hit, found_id(hit), F.concat(title, F.lit(" profile names "), hit, F.lit("; was "), was, F.lit(".")), yes))
        .when(c("__job").isNotNull(), decide("current", "orcid", name, id_, F.concat(F.lit("ORCID employment at "), c("__job.organization"), since, F.lit(" with no end date."))))
        .when(c("__new").isNotNull() & ~stale_job, decide("moved", "orcid", new, found_id(new), F.concat(F.lit("ORCID lists a current employment at "), new, since_new, F.lit("; was "), was, F.lit(".")), yes, last))
        .when(t.isNotNull(), decide(t["status"], "openalex", t["name"], t["id"], F.nullif(F.concat_ws(" ", told, missing), F.lit("")), t["status"] != "current", last, country=F.when(t["status"] == "moved", elsewhere["country"])))
        .otherwise(decide("unverified", "openalex", name, id_, "No source had an affiliation record for this person.", listed=F.lit(None)))
    )
    return rows.withColumn(out, out_).drop("__key", "__hit", "__jobs", "__there", "__listed", "__evidence", "__hit_here", "__job", "__new")


#: Fields of an assessment that a record keeps beside its institution.
KEPT = ["status", "source", "previous", "previous_id", "last_seen", "directory_listed", "note", "evidence"]


def affiliation_patch(a: Column) -> tuple[Column, Column]:
    """The patch of an institution (struct of name, name_key, id, country, affiliation) that an assessment makes, and the paths to empty, for store.merge_patch: a blank institution is a
    result, a department doesn't follow a move, and of somebody nowhere to be found the country goes too."""
    key = institution_key(a["name"])
    patch = F.struct(a["name"].alias("name"), F.when(a["name"].isNotNull(), key).alias("name_key"), a["id"].alias("id"), a["country"].alias("country"), F.struct(*(a[k].alias(k) for k in KEPT)).alias("affiliation"))
    gone = lambda on, *paths: F.when(on, F.array(*(F.lit(f"institution.{p}") for p in paths))).otherwise(F.array().cast("array<string>"))
    unset = F.concat(gone(a["name"].isNull(), "name", "name_key"), gone(a["id"].isNull(), "id"), gone(a["status"] != "current", "department"), gone(a["status"] == "unknown", "country"))
    return patch, unset


def combined(listed: Column, registry: Column, registry_here: Column, employment: Column, employment_here: Column, employment_stale: Column, bibliographic: Column) -> Column:
    """struct(status, source): a directory that lists the person, then a registry, an open employment, the latest papers, or nothing. The columns are booleans (has it, says here) and the assessment's status."""
    status = F.when(listed, "current").when(registry, F.when(registry_here, "current").otherwise("moved"))
    status = status.when(employment & (employment_here | ~employment_stale), F.when(employment_here, "current").otherwise("moved")).when(bibliographic.isNotNull(), bibliographic).otherwise("unverified")
    source = F.when(listed, "directory").when(registry, "registry").when(employment & (employment_here | ~employment_stale), "employment").when(bibliographic.isNotNull(), "bibliographic").otherwise("none")
    return F.struct(status.alias("status"), source.alias("source"))


def stale(verified: Column, as_of: Column, days: int = 30) -> Column:
    """Never looked at, or longer ago than that."""
    return verified.isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp(verified) > days * 86400)


def fresh(old_hash: Column, new_hash: Column, scored: Column, as_of: Column, days: int = 30) -> Column:
    """The same material, and scored within the days."""
    return F.coalesce((old_hash == new_hash) & (F.unix_timestamp(as_of) - F.unix_timestamp(scored) < days * 86400), F.lit(False))
