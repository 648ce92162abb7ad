"""What becomes of leads: where somebody is now, by the evidence of all sources, and the patch that follows from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import affiliation, fill, reports, store
from dossier.plans.queries import query, table
from dossier.session import shared_folder

HERE, ELSEWHERE = "Zorbia Tech", "Quuxland Poly"
REGISTRY = "struct<directory_checked:boolean,directory_listed:boolean,directory_url:string,hits:array<struct<source:string,institution:string,profile_url:string,designation:string,department:string>>>"
ORCID = "struct<employments:array<struct<organization:string,role:string,department:string,start_year:int,current:boolean>>>"
PAPERS = "struct<last_known:array<struct<id:string,name:string,lineage:array<string>,country:string>>,affiliations:array<struct<id:string,name:string,lineage:array<string>,years:array<int>>>>"


def _asked(spark, sf_dir) -> DataFrame:
    """A customer is a lead at one place; the remainder of its number by eight says which sources know it, and what."""
    k, none = F.col("c_custkey"), F.lit(None)
    case = k % 8
    hit = lambda source, name, title=None: F.struct(F.lit(source), F.lit(name), F.lit("u"), F.lit(title).cast("string"), none.cast("string"))
    hits = F.when(case == 1, F.array(hit("vidwan", ELSEWHERE, "Dean"), hit("irins", HERE))).when(case == 2, F.array(hit("vidwan", ELSEWHERE)))
    registry = F.when(case <= 2, F.struct(case.isin(0, 2), case == 0, F.lit("d"), hits))
    job = lambda name, year, now=True: F.struct(F.lit(name), F.lit("Prof"), none.cast("string"), F.lit(year), F.lit(now))
    orcid = F.when(case == 3, F.struct(F.array(job(ELSEWHERE, 2001, False), job(ELSEWHERE, 2009), job(HERE, 2010)))).when(case == 4, F.struct(F.array(job(ELSEWHERE, 2015)))).when(case == 5, F.struct(F.array(job(ELSEWHERE, 2011)))).when(case == 6, F.struct(F.array(job(HERE, 2000, False))))
    place = lambda i, name: F.struct(F.lit(i), F.lit(name), F.array(F.lit("L")), F.lit("XX"))
    at = lambda i, name, *years: F.struct(F.lit(i), F.lit(name), F.array(F.lit("L")), F.array(*map(F.lit, years)))
    papers = F.when(case.isin(4, 6), F.struct(F.array(place("q", ELSEWHERE)), F.array(at("z", HERE, 2010, 2012), at("q", ELSEWHERE, 2023)))).when(case == 5, F.struct(F.array(place("z", HERE)), F.array(at("z", HERE, 2020))))
    institution = F.struct(F.lit(HERE).alias("name"), F.lit("zorbia tech").alias("name_key"), F.lit("z").alias("id"), F.lit("IN").alias("country"), F.concat(F.lit("Dept "), F.col("c_nationkey")).alias("department"), F.lit(None).cast("struct<status:string,source:string,previous:string,note:string,verified:int>").alias("affiliation"))
    return table(spark, sf_dir, "customer").select(k, institution.alias("institution"), registry.cast(REGISTRY).alias("registry"), orcid.cast(ORCID).alias("orcid"), papers.cast(PAPERS).alias("papers"))


def _verified(spark, sf_dir) -> DataFrame:
    return affiliation.with_affiliation(_asked(spark, sf_dir), F.col("institution.name"), F.col("institution.id"), F.col("registry"), F.col("orcid"), F.col("papers"), 2024, "found")


_CASES = """WITH c AS (SELECT c_custkey, c_nationkey, (['current', 'current', 'moved', 'current', 'moved', 'current', 'moved', 'unverified'])[c_custkey % 8 + 1] AS status, (['directory', 'irins', 'vidwan', 'orcid', 'orcid', 'openalex', 'openalex', 'openalex'])[c_custkey % 8 + 1] AS source FROM customer)"""
_NOTES = [
    "Listed in the institute faculty directory.", "IRINS profile names Zorbia Tech.", "Vidwan profile names Quuxland Poly; was Zorbia Tech.", "ORCID employment at Zorbia Tech since 2010 with no end date.",
    "ORCID lists a current employment at Quuxland Poly since 2015; was Zorbia Tech.", "", "Latest work (2023) is from Quuxland Poly; last seen at Zorbia Tech in 2012.", "No source had an affiliation record for this person.",
]
_TRAIL = [
    "directory/Zorbia Tech/true/Listed in the institute faculty directory", "vidwan/Quuxland Poly/true/Dean; irins/Zorbia Tech/true/", "directory//false/Not found in the institute faculty directory; vidwan/Quuxland Poly/true/", "orcid/Quuxland Poly/true/Prof, since 2009; orcid/Zorbia Tech/true/Prof, since 2010",
    "orcid/Quuxland Poly/true/Prof, since 2015; openalex/Quuxland Poly/true/Named on the latest indexed work (2023)", "orcid/Quuxland Poly/true/Prof, since 2011; openalex/Zorbia Tech/true/Named on the latest indexed work (2020)",
    "orcid///No current employment on the ORCID record; openalex/Quuxland Poly/true/Named on the latest indexed work (2023)", "",
]


@query(_CASES + f""" SELECT c_custkey, status, source, CASE WHEN status = 'moved' THEN '{ELSEWHERE}' ELSE '{HERE}' END AS place, CASE WHEN status = 'moved' THEN '{HERE}' END AS previous, ({_NOTES})[c_custkey % 8 + 1] AS note, ({_TRAIL})[c_custkey % 8 + 1] AS trail FROM c""")
def verify_lead(spark, sf_dir):
    """Where each lead is now, with the evidence of every source that was asked, whichever decided."""
    e = F.transform("found.evidence", lambda x: F.concat_ws("/", x["source"], F.coalesce(x["institution"], F.lit("")), F.coalesce(x["current"].cast("string"), F.lit("")), F.coalesce(x["detail"], F.lit(""))))
    return _verified(spark, sf_dir).select("c_custkey", "found.status", "found.source", F.col("found.name").alias("place"), "found.previous", F.coalesce("found.note", F.lit("")).alias("note"), F.array_join(e, "; ").alias("trail"))


@query(_CASES + f""", i AS (SELECT c_custkey, {{'name': '{HERE}', 'id': 'z', 'country': 'IN', 'department': 'Dept ' || c_nationkey}} AS i, status, source FROM c),
p AS (SELECT c_custkey, status, source, CASE WHEN status = 'moved' THEN struct_pack(name := '{ELSEWHERE}', id := CASE WHEN c_custkey % 8 = 6 THEN 'q' END, country := CASE WHEN c_custkey % 8 = 6 THEN 'XX' ELSE i.country END, department := NULL) WHEN status = 'unverified' THEN struct_pack(name := i.name, id := i.id, country := i.country, department := NULL) ELSE i END AS i FROM i)
SELECT c_custkey, i.name, i.id, i.country, i.department, status, source FROM p""")
def affiliation_patch(spark, sf_dir):
    """Institutions after the patches of their leads' assessments: what a patch names is set, what it empties is empty, all else stays, down to the fields of the nested record."""
    rows = _verified(spark, sf_dir)
    patch, unset = affiliation.affiliation_patch(F.col("found"))
    own = F.struct("name", "name_key", "id", "country", F.struct("affiliation.status", "affiliation.source", "affiliation.previous", "affiliation.note").alias("affiliation"))
    patches = rows.select("c_custkey", patch.alias("p"), unset.alias("unset")).select("c_custkey", "unset", "p.*").select("c_custkey", "unset", own.alias("institution"))
    out = store.merge_patch(rows.select("c_custkey", "institution"), patches, "c_custkey", "unset")
    return out.select("c_custkey", "institution.name", "institution.id", "institution.country", "institution.department", "institution.affiliation.status", "institution.affiliation.source")


def _gaps(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Customers as leads with gaps, suppliers as members of the roster, orders as employments of their customers, own records of every third customer, pages of every fifth."""
    k, none, t = F.col("c_custkey"), F.lit(None).cast("string"), lambda name: table(spark, sf_dir, name)
    some = lambda on, text: F.when(on, F.concat(F.lit(text), k))
    leads = t("customer").select(k.alias("lead_id"), k.cast("string").alias("orcid"), F.lit(HERE).alias("institution"), F.concat(F.lit("p"), k).alias("profile_url"), some(k % 2 == 0, "own").alias("email"), F.when(k % 4 == 0, "Dean").otherwise("").alias("title"), none.alias("department"), none.alias("phone"), some(k % 7 == 0, "https://own").alias("website"))
    s = F.col("s_suppkey")
    members = t("supplier").select(s.alias("member_id"), F.when(s % 5 != 0, "promoted").otherwise("eligible").alias("status"), F.when(s % 6 != 0, s.cast("long")).alias("lead_id"), none.alias("profile_url"), F.when(s % 3 == 0, F.concat(F.lit("m"), s)).alias("email"), *(none.alias(c) for c in ("title", "department", "phone", "website")))
    url = lambda u: F.struct(F.lit("x").alias("name"), u.alias("url"))
    persons = t("customer").where(k % 3 == 0).select(k.cast("string").alias("orcid"), F.array(F.concat(F.lit("o"), k)).alias("emails"), F.array(url(F.lit("https://orcid.org/1")), url(F.concat(F.lit("https://site"), k))).alias("urls"))
    o = F.col("o_orderkey")
    jobs = t("orders").select(F.col("o_custkey").cast("string").alias("orcid"), o.alias("seq"), F.when(o % 2 == 0, HERE).otherwise(ELSEWHERE).alias("organization"), F.when(o % 3 == 0, "PhD student").otherwise("Professor").alias("role"), F.concat(F.lit("D"), o % 4).alias("department"), (F.col("o_orderstatus") != "F").alias("current"))
    web = t("customer").where(k % 5 == 0).select(k.alias("lead_id"), F.concat(F.lit("w"), k).alias("email"), F.lit("Head").alias("title"), F.lit("").alias("department"), F.concat(F.lit("+"), k).alias("phone"), none.alias("website"))
    return leads, members, persons, jobs, web


_FILLED = f"""WITH j AS (SELECT o_custkey AS k, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Professor' END, o_orderkey) AS role, min_by('D' || o_orderkey % 4, o_orderkey) AS dep, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F' GROUP BY 1),
h AS (SELECT k, CASE WHEN o % 3 = 0 THEN NULL ELSE 'Professor' END AS role, dep FROM j), w AS (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0),
l AS (SELECT c_custkey AS k, w.k IS NOT NULL AS wanted, CASE WHEN c_custkey % 2 = 0 THEN 'own' || c_custkey END AS email, CASE WHEN c_custkey % 4 = 0 THEN 'Dean' END AS title, CASE WHEN c_custkey % 7 = 0 THEN 'https://own' || c_custkey END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN 'o' || c_custkey END AS o_email, h.role AS o_title, h.dep AS o_dep, CASE WHEN c_custkey % 3 = 0 THEN 'https://site' || c_custkey END AS o_site, c_custkey % 5 = 0 AS web FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN h ON h.k = c_custkey),
f AS (SELECT k, CASE WHEN NOT wanted THEN '' ELSE array_to_string(list_filter([CASE WHEN email IS NULL AND o_email IS NOT NULL THEN 'email' END, CASE WHEN title IS NULL AND o_title IS NOT NULL THEN 'title' END, CASE WHEN o_dep IS NOT NULL THEN 'department' END, CASE WHEN website IS NULL AND o_site IS NOT NULL THEN 'website' END], lambda x: x IS NOT NULL), ',') END AS filled,
  CASE WHEN NOT (wanted AND web) THEN '' ELSE array_to_string(list_filter([CASE WHEN email IS NULL AND o_email IS NULL THEN 'email' END, CASE WHEN title IS NULL AND o_title IS NULL THEN 'title' END, 'phone'], lambda x: x IS NOT NULL), ',') END AS from_web,
  CASE WHEN wanted THEN coalesce(email, o_email, CASE WHEN web THEN 'w' || k END) ELSE email END AS email, CASE WHEN wanted THEN coalesce(title, o_title, CASE WHEN web THEN 'Head' END, '') ELSE coalesce(title, '') END AS title,
  CASE WHEN wanted THEN o_dep END AS department, CASE WHEN wanted AND web THEN '+' || k END AS phone, CASE WHEN wanted THEN coalesce(website, o_site) ELSE website END AS website FROM l)"""


@query(_FILLED + """ SELECT 'lead' AS kind, k AS id, filled, from_web, email, title, department, phone, website FROM f
UNION ALL SELECT 'member', s_suppkey, '', '', coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'm' || s_suppkey END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0 THEN f.email END), CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0 THEN nullif(f.title, '') END,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0 THEN f.department END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0 THEN f.phone END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0 THEN f.website END FROM supplier LEFT JOIN f ON f.k = s_suppkey""")
def fill_missing(spark, sf_dir):
    """Leads and members after a fill, read back from the one version that both were written as: gaps from own records, then from pages, with the names of what was filled; members mirror their leads."""
    leads, members, persons, jobs, web = _gaps(spark, sf_dir)
    folder = f"{shared_folder(spark)}/fill-{uuid.uuid4().hex}"
    after, roster = fill.fill_missing(leads, members, persons, jobs, web)
    fill.commit(spark, folder, leads=after, members=roster)
    named = [F.array_join("filled", ",").alias("filled"), F.array_join("filled_from_web", ",").alias("from_web")]
    out = fill.committed(spark, folder, "leads").select(F.lit("lead").alias("kind"), F.col("lead_id").alias("id"), *named, *fill.FIELDS)
    return out.unionByName(fill.committed(spark, folder, "members").select(F.lit("member").alias("kind"), F.col("member_id").alias("id"), F.lit("").alias("filled"), F.lit("").alias("from_web"), *fill.FIELDS))


_DOMAINS = ["chemistry", "materials", "civil", "other"]
_LABELS = ["Chemistry", "Materials / Metallurgy", "Civil Engineering (corrosion)", "Other"]


@query(f"""WITH i AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS b FROM orders GROUP BY 1), m AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_nationkey AS n, coalesce(b, []) AS b FROM customer LEFT JOIN i ON o_custkey = c_custkey)
SELECT c_name || ',"Head, ""of"" ' || seg || '",professor,=Dept ' || n || ',' || ({_LABELS})[k % 4 + 1] || ',' || CASE WHEN k % 3 = 0 THEN '' ELSE 'Inst ' || n END || ',,' || CASE k % 3 WHEN 0 THEN 'unverified,,,' WHEN 1 THEN 'current,orcid,2024-01-02,' ELSE 'moved,registry,2024-01-02,Old' END || ','
  || CASE WHEN k % 5 = 0 THEN 'yes' ELSE '' END || ',' || CASE WHEN k % 2 = 0 THEN 'e' || k || '@x' ELSE '' END || ',,,,' || CASE WHEN k % 7 = 0 THEN '0000' ELSE '' END || ',A' || k || ',' || CASE WHEN k % 4 = 0 THEN '' ELSE CAST(k % 101 AS VARCHAR) END || ','
  || array_to_string(b, '; ') || ',' || array_to_string(list_transform(list_filter(b, lambda x: x = 'F'), lambda x: x || ' m1; ' || x || ' m2'), '; ') || ',' || CASE WHEN list_contains(b, 'O') THEN 'yes' ELSE '' END || ',t1; t2; t3; t4; t5; t6; t7; t8,' || k || ',' || n || ',orcid; openalex,eligible,a; b,"one
two"' AS line FROM m""")
def roster_export(spark, sf_dir):
    """The export of a roster, all twenty-nine columns: labels, joined lists, yes or nothing, line ends in quotes, formulas as they are."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    item = lambda b, model, vendor: F.struct(b.alias("brand"), F.lit(model).cast("string").alias("model"), F.lit(vendor).cast("string").alias("vendor"))
    both = lambda b: F.when(b == "F", F.array(*(item(b, m, "competitor") for m in ("m1", "m2", "m1")))).when(b == "O", F.array(item(b, None, "own"))).otherwise(F.array(item(b, "", None)))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.flatten(F.transform(F.array_sort(F.collect_set("o_orderstatus")), both)).alias("instruments"))
    status = F.struct(F.when(k % 3 == 1, "current").otherwise("moved").alias("status"), F.when(k % 3 == 1, "orcid").otherwise("registry").alias("source"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("verified_at"), F.when(k % 3 == 2, "Old").alias("previous"))
    rows = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").select(
        F.col("c_name").alias("name"), F.concat(F.lit('Head, "of" '), "c_mktsegment").alias("title"), F.lit("professor").alias("role"), F.concat(F.lit("=Dept "), "c_nationkey").alias("department"), F.element_at(F.array(*map(F.lit, _DOMAINS)), (k % 4 + 1).cast("int")).alias("domain"),
        F.when(k % 3 != 0, F.concat(F.lit("Inst "), "c_nationkey")).alias("institution"), F.when(k % 3 != 0, status).alias("affiliation"), (k % 5 == 0).alias("outside_target"), F.when(k % 2 == 0, F.concat(F.lit("e"), k, F.lit("@x"))).alias("email"), *(none.alias(c) for c in ("discovered_name", "phone", "website", "profile_url")),
        F.when(k % 7 == 0, "0000").alias("orcid"), F.concat(F.lit("A"), k).alias("author_id"), F.when(k % 4 != 0, k % 101).alias("score"), F.coalesce("instruments", F.array().cast("array<struct<brand:string,model:string,vendor:string>>")).alias("instruments"),
        F.array(*(F.lit(f"t{n}") for n in range(1, 11))).alias("topics"), k.alias("works"), F.col("c_nationkey").alias("h_index"), F.array(F.lit("orcid"), F.lit("openalex"), F.lit("orcid")).alias("sources"), F.lit("eligible").alias("status"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("one\ntwo").alias("reasoning"),
    )
    return reports.roster_export(rows, reports.roster_columns())
