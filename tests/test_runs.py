"""Whole runs on small records whose outcomes are known by hand."""

import contextlib
import io

from pyspark.sql import functions as F

from dossier.operators import lists, roster, runs

SOURCES = ["openalex", "orcid", "registry", "faculty_page"]


def seen(spark, rows):
    names = ["source", "name", "orcid", "title", "department", "email", "role", "keywords"]
    df = spark.createDataFrame([(k, *[dict(zip(names, [*r, *[None] * 8], strict=False)).get(n) for n in names]) for k, r in enumerate(rows)], "seq long, " + ", ".join(f"{n} string" for n in names))
    return runs.sightings(df.withColumn("place", F.lit("p")))


def test_sightings_find_their_drafts(spark):
    rows = [
        ("openalex", "Ann Lee", "o1"), ("openalex", "Bo Chen", None), ("openalex", "Bo Chen", None), ("openalex", "Cy Zorn", "o3"),
        ("orcid", "A. Leigh", "o1"), ("orcid", "Cy Zorn", "o4"), ("orcid", "Dora Quill", "o5"),  # by number; a namesake with another number; new
        ("registry", "Dr. Lee Ann", None), ("registry", "C. Zorn", None), ("registry", "Eve Novak", None), ("registry", "Eve Novak", None), ("registry", "D Quill", None),
        ("faculty_page", "Bo Chen", None), ("faculty_page", "Department of Chemistry", None), ("faculty_page", "E. Novak", None), ("faculty_page", "漢字", None),
    ]
    got = {r.seq: r.draft for r in runs.drafted(seen(spark, rows), SOURCES).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6, 7: 0, 8: 8, 9: 9, 10: 9, 11: 6, 12: 1, 14: 9, 15: 15}


def test_a_build(spark):
    rows = [
        ("openalex", "Ann Lee", "o1"), ("orcid", "Ann Lee", "o1", "PhD student", None, "ANN@x"), ("faculty_page", "Ann Lee", None, "Assistant Professor", "Chemistry"),  # a page stands against a student's entry
        ("orcid", "Bo Chen", "o2", "Professor", "Physics"), ("orcid", "Cy Zorn", "o3", "PhD student", "Chemistry"), ("registry", "Dora Quill", None, None, "Chemistry"),
        ("registry", "Eve Novak", None, "Professor", "Civil Engineering", None, None, "pitting corrosion"), ("faculty_page", "漢字", None, "Professor", "Chemistry"), ("orcid", "Gil Hart", "o7", "Professor", "History"),
    ]
    members = spark.createDataFrame([(1, None, None, "p", "Lee Ann", None), (2, "o3", None, "q", "x y", None)], "member_id long, orcid string, author_id string, place string, name string, email string")
    pinned = spark.createDataFrame([(None, None, "Gil Hart", "p"), (None, None, "Bo Chen", "elsewhere")], "orcid string, author_id string, name string, place string")
    out = runs.build(seen(spark, rows), members, 2024, SOURCES, pinned)
    assert {r["name"]: (r.outcome, r.member) for r in out.collect()} == {
        "Ann Lee": ("updated", 1), "Bo Chen": ("excludedDomain", None), "Cy Zorn": ("excludedRole", 2), "Dora Quill": ("droppedUnconfirmed", None), "Eve Novak": ("created", None), "漢字": ("droppedUnconfirmed", None), "Gil Hart": ("created", None),
    }
    assert tuple(runs.outcome_counts(out).first()) == (2, 1, 1, 1, 2)
    store = spark.createDataFrame([(2, "eligible", ["t"], None, []), (3, "eligible", [], None, [])], "member_id long, status string, tags array<string>, department string, sources array<struct<type:string,title:string>>")
    assert [tuple(r) for r in runs.excluded_if_known(out, store).select("member_id", "status", "tags").orderBy("member_id").collect()] == [(2, "excluded", ["t"]), (3, "eligible", [])]


def test_exclusions_that_know_less(spark):
    members = spark.createDataFrame(
        [(1, "eligible", [], "Chemistry", []), (2, "promoted", ["a"], None, []), (3, "eligible", [], None, [("faculty_page", "Professor")]), (4, "eligible", [], "Chemistry", []), (5, "excluded", [], None, [])],
        "member_id long, status string, tags array<string>, department string, sources array<struct<type:string,title:string>>",
    )
    out = spark.createDataFrame([(1, "excludedDomain", None), (2, "excludedRole", None), (3, "excludedRole", None), (4, "excludedDomain", "Physics"), (5, "excludedRole", None), (9, "created", None)], "member long, outcome string, department string")
    got = {r.member_id: (r.status, r.tags) for r in runs.excluded_if_known(out, members).collect()}
    assert got == {1: ("eligible", []), 2: ("promoted", ["a", "review-role"]), 3: ("eligible", []), 4: ("excluded", []), 5: ("excluded", [])}


def test_refreshing_leads(spark):
    leads = spark.createDataFrame([(1, None, "Dean", ["a"], "h", True), (2, "e", "", ["a"], "h", True), (3, "e", None, ["a"], "h", False)], "id int, email string, title string, topics array<string>, content_hash string, scored boolean")
    found = spark.createDataFrame([(1, "n", "x", ["b", "a"], "g"), (2, "n", "x", ["b"], "h"), (3, "n", "x", ["b"], "h"), (4, "n", "x", ["b"], "g")], "id int, email string, title string, topics array<string>, content_hash string")
    got = {r.id: (r.change, r.email, r.title, r.topics, r.content_hash) for r in runs.refreshed(leads, found, "id", ["email", "title"], {"topics": 2}).collect()}
    assert got == {1: ("refreshed", "n", "Dean", ["a", "b"], "g"), 2: ("unchanged", "e", "", ["a"], "h"), 3: ("refreshed", "e", "x", ["a", "b"], "h"), 4: ("created", "n", "x", ["b"], "g")}


def test_small_facts(spark):
    df = spark.createDataFrame([(" a ", "", None, ["x", "y", "x"])], "a string, b string, c string, t array<string>")
    r = df.select(lists.missing_fields({"A": "a", "B": "b", "C": "c"}).alias("m"), lists.tagged(F.col("t"), ["z"], ["y"]).alias("t"), lists.described(F.col("a"), F.col("b"), F.lit("c")).alias("d")).first()
    assert (r.m, r.t, r.d) == (["B", "C"], ["x", "z"], "a, c")
    assert tuple(lists.without_blanks(df).select("a", "b", "c").first()) == ("a", None, None)
    sites = spark.createDataFrame([("https://ann.example.org",), ("https://orcid.org/1",), (None,)], "u string")
    assert [r.o for r in sites.select(lists.own_site(F.col("u")).alias("o")).collect()] == [True, False, False]
    person = spark.createDataFrame([([" A@X ", "a@x"], ["k", " "], [("n", "HTTP://a"), ("m", "ftp://b")])], "emails array<string>, keywords array<string>, urls array<struct<name:string,url:string>>")
    r = lists.orcid_person(person).first()
    assert (r.emails, r.keywords, [u.url for u in r.urls]) == (["a@x"], ["k"], ["HTTP://a"])
    kinds = spark.createDataFrame([("i1", "a"), ("i2", "b"), ("i3", "a")], "institution_id string, kind string")
    off = spark.createDataFrame([("i3",)], "institution_id string")
    assert [r.institution_id for r in lists.active_institutions(kinds, ["a"], off).collect()] == ["i1"] and lists.active_institutions(kinds, [], off).count() == 2


def record(spark, rows):
    """Sightings with a publication record: source, name, orcid, title, department, works, h_index, first_year."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, source string, name string, orcid string, title string, department string, works int, h_index int, first_year int")
    return runs.sightings(df.withColumns({"place": F.lit("p"), "last_year": F.lit(2024), "years_here": F.array(*map(F.lit, range(2015, 2025)))}))


def test_a_student_with_a_long_record_is_kept(spark):
    rows = [
        ("openalex", "Ann Lee", "o1", None, "Chemistry", 60, 30, 1990), ("orcid", "Ann Lee", "o1", "PhD student", None, None, None, None),  # nobody closed the entry
        ("openalex", "Bo Chen", "o2", None, "Chemistry", 60, 30, 2015), ("orcid", "Bo Chen", "o2", "PhD student", None, None, None, None),  # too short a record
        ("openalex", "Cy Zorn", "o3", None, "Chemistry", 60, 30, 1990), ("orcid", "Cy Zorn", "o3", "Visiting Professor", None, None, None, None),  # no student
        ("openalex", "Di Hart", "o4", None, "Chemistry", 60, 30, 1990), ("registry", "Di Hart", None, "PhD scholar", None, None, None, None),  # not a self-kept record
        ("openalex", "Ed Kim", "o5", None, "Chemistry", 60, 5, 1990), ("orcid", "Ed Kim", "o5", "PhD student", None, None, None, None),  # not senior
    ]
    none = spark.createDataFrame([], "member_id long, orcid string, author_id string, place string, name string, email string")
    out = {r["name"]: (r.outcome, r.decision.role, r.reason) for r in runs.build(record(spark, rows), none, 2024, SOURCES).collect()}
    assert out == {"Ann Lee": ("created", "inferred", None), "Bo Chen": ("excludedRole", "excluded", "role: PhD student"), "Cy Zorn": ("excludedRole", "excluded", "role: Visiting Professor"), "Di Hart": ("excludedRole", "excluded", "role: PhD scholar"), "Ed Kim": ("excludedRole", "excluded", "role: PhD student")}
    assert {r.outcome for r in runs.build(record(spark, rows[:2]), none, 2024, SOURCES, infer=False).collect()} == {"excludedRole"}


def test_two_numbers_are_two_people(spark):
    rows = [("openalex", "Ann Lee"), ("orcid", "Ann Lee", "o1"), ("orcid", "Ann Lee", "o2"), ("orcid", "Lee Ann", "o2"), ("orcid", "Ann Lee", "o1"), ("openalex", "Anna Center"), ("registry", "Anna Center"), ("faculty_page", "Read more")]
    assert {r.seq: r.draft for r in runs.drafted(seen(spark, rows), SOURCES).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0, 5: 5}


def test_sources_without_numbers(spark):
    """No step is left out where the first source has nobody with an ORCID, or a source nobody at all; rows of other sources are nobody's."""
    rows = [("registry", "Ann Lee"), ("registry", "Lee Ann"), ("faculty_page", "A. Lee"), ("faculty_page", "Bo Chen"), ("import", "Ann Lee")]
    assert {r.seq: r.draft for r in runs.drafted(seen(spark, rows), ["registry", "orcid", "faculty_page"]).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert runs.drafted(seen(spark, rows[4:]), SOURCES).collect() == []


def test_keys_of_sightings_are_worked_out_once(spark, monkeypatch):
    """Rows are dealt out before their keys, and only one of the steps that are written has the patterns of keys in its plan."""
    plans, cut = [], runs.cut
    monkeypatch.setattr(runs, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    rows = [("openalex", "Ann Lee", "o1"), ("orcid", "Ann Lee", "o1"), ("registry", "A. Lee"), ("faculty_page", "Bo Chen")]
    assert {r.seq: r.draft for r in runs.drafted(seen(spark, rows), SOURCES).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert [k for k, p in enumerate(plans) if "regexp_replace" in p] == [1] and "REPARTITION_BY_NUM" in plans[0]


def test_the_key_of_a_name_is_read_from_its_draft(spark):
    """Decisions and members look at the key that people has left, not at the name again."""
    members = spark.createDataFrame([(1, None, None, "p", "Zed Quill", None)], "member_id long, orcid string, author_id string, place string, name string, email string")
    drafts = runs.people(runs.drafted(seen(spark, [("registry", "Dr. Lee Ann", None, "Professor", "Chemistry")]), SOURCES), 2024)
    assert drafts.first().name_key == "ann lee"
    for key, want in (("ann lee", ("created", None)), ("quill zed", ("updated", 1)), ("", ("droppedUnconfirmed", None))):
        got = runs.stored(runs.decided(drafts.withColumn("name_key", F.lit(key))), members).first()
        assert (got.outcome, got.member) == want


def test_own_keywords_open_a_gate(spark):
    rows = [("orcid", n, o, "Professor", d) for n, o, d in (("Ann Lee", "o1", "Civil Engineering"), ("Bo Chen", "o2", "Civil Engineering"), ("Cy Zorn", "o3", "History"), ("Di Hart", None, "Mechanical Engineering"))]
    persons = spark.createDataFrame([("o1", ["pitting corrosion"], ["a@x", "b@x"], [("h", "https://a")]), ("o3", ["potentiostat"], [], [])], "orcid string, keywords array<string>, emails array<string>, urls array<struct<name:string,url:string>>")
    none = spark.createDataFrame([], "member_id long, orcid string, author_id string, place string, name string, email string")
    got = {r["name"]: (r.outcome, r.domain.gate, r.email, r.website, r.reason) for r in runs.build(seen(spark, rows), none, 2024, SOURCES, persons=persons).collect()}
    assert got == {
        "Ann Lee": ("created", "corrosion", "a@x", "https://a", None), "Bo Chen": ("excludedDomain", None, None, None, "domain: Civil Engineering (corrosion) without corrosion-related work"),
        "Cy Zorn": ("created", "electrochemistry", None, None, None), "Di Hart": ("excludedDomain", None, None, None, "domain: Mechanical Engineering (corrosion) without corrosion-related work"),
    }


IMPORT = "row_id long, name string, institution string, department string, title string, email string, orcid string, profile_url string, keywords string, phone string, website string, bio string"


def test_imports(spark):
    none = [None] * 7
    rows = spark.createDataFrame(
        [
            (1, "Ann Lee", "IIT Zorbia", "History", None, *none), (2, "Bo Chen", "Dept of Chemistry, Indian Institute of Technology Zorbia", "Chemistry", None, *none), (3, "Cy Zorn", "Nowhere", "Chemistry", None, *none), (4, " ", "IIT Zorbia", None, None, *none),
            (5, "Di Hart", "IIT Zorbia", "History", "PhD student", *none), (6, "Ed Kim", "IIT Zorbia", "History", None, *none), (7, "Ann Lee", "University of Quux", "History", None, *none),
        ],
        IMPORT,
    )
    places = spark.createDataFrame([("p1", "Indian Institute of Technology Zorbia"), ("p2", "University of Quux"), ("p0", "Technology Zorbia Campus Institute")], "place string, institution string")
    members = spark.createDataFrame([], "member_id long, orcid string, author_id string, place string, name string, email string")
    pinned = spark.createDataFrame([(None, None, "Lee, Ann", "IIT Zorbia"), (None, None, "Di Hart", None), (None, None, "Ed Kim", "Somewhere Else")], "orcid string, author_id string, name string, institution string")
    outcomes, unknown = runs.imported(rows, places, members, pinned)
    assert {r.draft: (r.place, r.outcome) for r in outcomes.collect()} == {1: ("p1", "created"), 2: ("p1", "created"), 5: ("p1", "excludedRole"), 6: ("p1", "excludedDomain"), 7: ("p2", "excludedDomain")}
    assert [r.row_id for r in unknown.collect()] == [3]
    with contextlib.redirect_stdout(io.StringIO()) as out:
        outcomes.explain("formatted")
    assert "NestedLoop" not in out.getvalue()


def test_reasons_of_exclusions(spark):
    members = spark.createDataFrame([(1, "eligible", [], None, [], None), (2, "promoted", ["review-role"], None, [], "old")], "member_id long, status string, tags array<string>, department string, sources array<struct<type:string,title:string>>, exclusion_reason string")
    out = spark.createDataFrame([(9, 1, "excludedRole", None, "role: b"), (3, 1, "excludedDomain", "X", "domain: X"), (4, 2, "excludedRole", None, "role: c")], "seq long, member long, outcome string, department string, reason string")
    assert {r.member_id: (r.status, r.tags, r.exclusion_reason) for r in runs.excluded_if_known(out, members).collect()} == {1: ("excluded", [], "domain: X"), 2: ("promoted", ["review-role"], "old")}


def test_pages_without_faculty(spark):
    rows = [("Professor", "https://x/people", None, "professor"), (None, "https://x/faculty/list", None, "professor"), (None, "https://x/people", "Faculty", "professor"), (None, "https://x/visiting-faculty", None, "unknown"), (None, "https://x/faculty", "Retired faculty", "unknown"), (None, "https://x/people", None, "unknown"), ("PhD student", "https://x/faculty", None, "excluded"), (None, "https://x/faculty/staff/?p=1", None, "professor"), (None, "https://x/faculty/office", None, "unknown")]
    df = spark.createDataFrame(rows, "title string, url string, label string, want string")
    assert [r.c for r in df.select(roster.page_role(F.col("title"), F.col("url"), F.col("label"))["category"].alias("c")).collect()] == [r[3] for r in rows]


def test_registry_and_employments_by_keys(spark):
    cards = spark.createDataFrame(
        [("p", "Ann", "IIT Zorbia", None, "Professor", None), ("p", "Bo", "Elsewhere", "now at iit zorbia, India", None, "2001 - 2030"), ("p", "Cy", "IIT Zorbia", None, "Professor", "(1986 - 2022)"), ("p", "Di", "Elsewhere", None, "Professor", None), ("p", "Ed", "IIT Zorbia", None, "PhD student", None), ("p", "Faculty", "IIT Zorbia", None, None, None), ("q", "Flo", "IIT Zorbia", None, None, None), ("p", "Gil", "Indian Institute of Technology", None, None, None), ("p", "Hal", "Technology", None, None, None)],
        "place string, name string, institute string, card_text string, designation string, years string",
    )
    names = spark.createDataFrame([("p", "Indian Institute of Technology Zorbia", "ror1"), ("p", "IIT Zorbia", "ror1"), ("q", "University of Quux", "ror2")], "place string, name string, ror string")
    got = {r["name"] for r in runs.registry_rows(cards, names.select("place", "name"), 2024).collect()}
    assert {"Ann", "Bo"} <= got and not got & {"Cy", "Di", "Ed", "Faculty", "Flo", "Hal"}
    jobs = spark.createDataFrame([("o1", "IIT Zorbia", None, None, None, 2020, True), ("o1", "IIT Zorbia", None, "Dean", "Chem", 2010, True), ("o1", "IIT Zorbia", None, "Head", None, 2023, False), ("o2", "Some Lab", "ROR2", "Fellow", None, None, True), ("o3", "Nowhere", None, "Dean", None, 2000, True)], "orcid string, organization string, org_id string, role string, department string, start_year int, current boolean")
    assert sorted((r.place, r.orcid, r.role) for r in runs.employed_here(jobs, names).collect()) == [("p", "o1", "Dean"), ("q", "o2", "Fellow")]
