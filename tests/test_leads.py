"""Patches down to nested fields, and every way in which evidence decides where somebody is."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import affiliation, store
from dossier.plans.leads import ORCID, PAPERS, REGISTRY

LEADS = "id int, p struct<x:string,y:int,q:struct<a:string,b:array<int>>>, n int"


def test_what_a_patch_doesn_t_name_stays(spark):
    leads = spark.createDataFrame([(1, ("a", 2, ("s", [1, 2])), 7), (2, None, 8), (3, ("c", 4, None), 9), (4, ("d", 5, ("t", [])), 1)], LEADS)
    patch = spark.createDataFrame([(1, ("b", ([9],)), None), (2, ("new", ([3],)), []), (3, (None, None), ["p.y", "n"]), (5, ("z", None), None)], "id int, p struct<x:string,q:struct<b:array<int>>>, off array<string>")
    got = {r.id: r for r in store.merge_patch(leads, patch, "id", "off").collect()}
    plain = {k: (r.p and (r.p.x, r.p.y, r.p.q and (r.p.q.a, r.p.q.b)), r.n) for k, r in got.items()}
    assert plain == {1: (("b", 2, ("s", [9])), 7), 2: (("new", None, (None, [3])), 8), 3: (("c", None, None), None), 4: (("d", 5, ("t", [])), 1)}
    gone = spark.createDataFrame([(1, ["p.q.a"]), (4, ["p.q"]), (3, ["p"]), (2, ["p.x"])], "id int, off array<string>")
    got = {r.id: r.p for r in store.merge_patch(leads, gone, "id", "off").collect()}
    assert got[1].q.a is None and got[1].q.b == [1, 2] and got[4].q is None and got[4].x == "d" and got[3] is None and got[2] is None
    assert store.merge_patch(leads, patch.drop("off"), "id").schema == leads.schema
    for wrong in ("id int, zz int", "id int, p struct<zz:int>", "id int, p struct<q:int>"):
        with pytest.raises(ValueError, match="p.zz is no|zz is no|p.q is a struct"):
            store.merge_patch(leads, spark.createDataFrame([], wrong), "id")


def test_keys_that_come_twice(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, s int")
    rows = spark.createDataFrame([(1, "x", 5), (1, "z", 3), (3, "n", 1), (3, "m", 1)], "k int, v string, s int")
    assert sorted(map(tuple, store.upsert(df, rows, "k", "s").select("k", "v").collect())) == [(1, "x"), (2, "b"), (3, "n")]
    assert sorted(map(tuple, store.upsert(df, rows, "k").select("k", "v").collect())) == [(1, "z"), (2, "b"), (3, "n")]


HIT = lambda source, institution: (source, institution, "u", "Dean", "Chem")
JOB = lambda name, year, now=True, role="Prof": (name, role, None, year, now)
AT = lambda i, name: (i, name, [], "XX")
IN = lambda i, name, *years: (i, name, [], list(years))
H, E = "Zorbia Tech", "Quuxland Poly"

CASES = {
    # registry, orcid, papers -> status, source, name, previous, last_seen, directory_listed, note, sources of the evidence
    "listed wins": ((True, True, "d", [HIT("irins", E)]), ([JOB(E, 2000)],), ([AT("q", E)], []), ("current", "directory", H, None, None, True, "Listed in the institute faculty directory.", ["directory", "irins", "orcid", "openalex"])),
    "irins before vidwan": ((True, False, "d", [HIT("vidwan", E), HIT("irins", H)]), None, None, ("current", "irins", H, None, None, False, "IRINS profile names Zorbia Tech.", ["directory", "vidwan", "irins"])),
    "a registry elsewhere": ((False, None, None, [HIT("vidwan", E), HIT("directory", H), HIT("vidwan", None)]), None, None, ("moved", "vidwan", E, H, None, None, "Vidwan profile names Quuxland Poly; was Zorbia Tech.", ["vidwan", "vidwan"])),
    "an open employment here": (None, ([JOB(E, 2020), JOB(H, None)],), None, ("current", "orcid", H, None, None, None, "ORCID employment at Zorbia Tech with no end date.", ["orcid", "orcid"])),
    "an open employment elsewhere": ((True, False, None, []), ([JOB(E, 2015)],), ([], [IN("z", H, 2009, 2012)]), ("moved", "orcid", E, H, 2012, False, "ORCID lists a current employment at Quuxland Poly since 2015; was Zorbia Tech.", ["directory", "orcid", "openalex"])),
    "an employment older than papers here": (None, ([JOB(E, 2011)],), ([AT("z", H)], [IN("z", H, 2020)]), ("current", "openalex", H, None, 2020, None, None, ["orcid", "openalex"])),
    "an employment without a year": (None, ([JOB(E, None)],), ([AT("z", H)], [IN("z", H, 2020)]), ("moved", "orcid", E, H, 2020, None, "ORCID lists a current employment at Quuxland Poly; was Zorbia Tech.", ["orcid", "openalex"])),
    "papers elsewhere": ((True, False, None, []), ([JOB(H, 2000, False)],), ([AT("q", E)], [IN("z", H, 2012), IN("q", E, 2023)]), ("moved", "openalex", E, H, 2012, False, "Latest work (2023) is from Quuxland Poly; last seen at Zorbia Tech in 2012. Not found in the institute faculty directory.", ["directory", "orcid", "openalex"])),
    "two places at once": (None, None, ([AT("q", E)], [IN("z", H, 2023), IN("q", E, 2023)]), ("current", "openalex", H, None, 2023, None, "Also affiliated with Quuxland Poly", ["openalex"])),
    "recent papers, no last place": (None, None, ([], [IN("z", H, 2023)]), ("current", "openalex", H, None, 2023, None, None, ["openalex"])),
    "old papers only": (None, None, ([], [IN("z", H, 2001)]), ("unknown", "openalex", None, H, 2001, None, "Last seen at Zorbia Tech in 2001; no current affiliation on record.", ["openalex"])),
    "no history": (None, None, ([], []), ("unknown", "openalex", None, H, None, None, "No affiliation history on record.", ["openalex"])),
    "nothing asked": (None, None, None, ("unverified", "openalex", H, None, None, None, "No source had an affiliation record for this person.", [])),
}


def test_evidence_decides_in_its_order(spark):
    rows = [(k, H, "z", *c[:3]) for k, c in CASES.items()]
    df = spark.createDataFrame(rows, f"case string, name string, id string, registry {REGISTRY}, orcid {ORCID}, papers {PAPERS}")
    known = F.create_map(F.lit("quuxland poly"), F.lit("q9"))
    out = affiliation.with_affiliation(df, F.col("name"), F.col("id"), F.col("registry"), F.col("orcid"), F.col("papers"), 2024, "a", known)
    patch, unset = affiliation.affiliation_patch(F.col("a"))
    got = {r.case: r for r in out.withColumn("patch", patch).withColumn("unset", unset).collect()}
    for case, (*_, want) in CASES.items():
        a = got[case].a
        assert (a.status, a.source, a.name, a.previous, a.last_seen, a.directory_listed, a.note, [e.source for e in a.evidence]) == want, case
    assert got["a registry elsewhere"].a.id == "q9" and got["papers elsewhere"].a.country == "XX" and got["papers elsewhere"].a.previous_id == "z"
    assert [e.current for e in got["irins before vidwan"].a.evidence] == [False, True, True] and got["irins before vidwan"].a.evidence[1].detail == "Dean, Chem"
    assert got["old papers only"].unset == [f"institution.{x}" for x in ("name", "name_key", "id", "department", "country")] and got["papers elsewhere"].unset == ["institution.department"]
    assert got["listed wins"].unset == [] and got["listed wins"].patch.affiliation.status == "current" and got["papers elsewhere"].patch.name == E


def test_names_of_papers_are_looked_at_once(spark):
    """A list's names get their keys in one place of the assessment, however often it reads what they say."""
    c = affiliation.assessment(F.col("name"), F.col("id"), F.col("last_known"), F.col("history"), 2024, F.col("key"))
    assert str(c).count("Indian Institute of Information Technology") == 2
