import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import fuzzy, rules, scoring, text, where
from dossier.operators import affiliation, identity, mining, order, roster, store
from dossier.sources import files, html, records


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1).alias("one")).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b"), [("Dr. Ann Example", "Example, Ann"), ("Prof Zoë  Müller", "zoe muller"), ("O'Neil Bo", "bo oneil")])
def test_name_key(spark, a, b):
    assert one(spark, text.name_key("a"), a=a) == one(spark, text.name_key("a"), a=b) != ""


def test_keys(spark):
    assert one(spark, text.name_key("a"), a="prof dr x") == "dr x"
    assert one(spark, text.short_name_keys("a"), a="Ann B Example") == ["a example", "e ann"]
    assert one(spark, text.institution_key("a"), a="The University of Oslo") == "oslo"
    assert one(spark, text.institution_key("a"), a="University") is None
    assert one(spark, text.expanded_institution_key("a"), a="IIT Example") == "indian technology example"
    assert one(spark, text.slug("a"), a=" Éa b--c! ") == "ea-b-c"
    assert one(spark, text.canonical_department("a"), a="Dept. of chemistry & physics Of MEMS (North)") == "Chemistry and Physics of MEMS"
    assert one(spark, text.canonical_department("a"), a="(x)") == "(none)"


def test_cells(spark):
    assert one(spark, text.csv_cell("a"), a='x "y"\r\n z') == '"x ""y"" z"'
    assert one(spark, text.csv_cell("a"), a="=1+2") == "'=1+2"
    assert one(spark, text.csv_cell("a", False), a="=1") == "=1"
    assert one(spark, text.csv_cell(F.lit(None))) == ""
    assert one(spark, text.occurrences(F.col("a"), "aa"), a="aaaaa") == 2
    assert one(spark, text.from_inverted_index(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"


@pytest.mark.parametrize(
    ("title", "role"),
    [("Assistant Professor", "professor"), ("PhD Scholar", "excluded"), ("INSPIRE Faculty Fellow", "fellow"), ("National Post-Doctoral Fellow", "excluded"), ("Visiting Professor", "excluded"), ("Project Research Scientist", "excluded"), ("Scientist E", "scientist"), ("Technical Officer", "officer"), ("Fellow", "unknown"), ("", "unknown"), (None, "unknown")],
)
def test_roles(spark, title, role):
    assert one(spark, rules.role(F.lit(title).cast("string"))["category"]) == role


@pytest.mark.parametrize(("name", "domain"), [("Bio-Chemical Engineering", "biochemical_engineering"), ("Chemical Engineering", "chemical_engineering"), ("Chemistry", "chemistry"), ("EEE", "electrical"), ("Physics", "other"), (None, "other")])
def test_domains(spark, name, domain):
    assert one(spark, rules.department_domain(F.lit(name).cast("string"))) == domain


def test_role_fold_depends_on_order(spark):
    def fold(*roles):
        rows = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(s).alias("source"), F.lit(c).alias("category")) for k, (s, c) in enumerate(roles)))
        return one(spark, rules.stronger_role(rows))

    page, old, students = ("faculty_page", "professor"), ("orcid", "excluded"), ("faculty_page", "excluded")
    assert fold(page, old, students) == "excluded"
    assert fold(old, students, page) == "professor"


def test_fuzzy(spark):
    score = lambda q, name, *other: one(spark, F.round(fuzzy.fuzzy_score(q, F.col("n"), [F.lit(x) for x in other], []), 3), n=name)
    assert score("ann example", "Ann Example") == 1
    assert score("exampel", "Ann Example") > 0
    assert score("ann zzz", "Ann Example") == 0
    assert score("a example", "Ann Example") == 0.85
    assert score("chem", "Ann", "Chemistry") == 0.855
    assert score("", "Ann") == 1
    assert one(spark, fuzzy.fuzzy_score("ann@x.org", F.lit("Bo"), [], [F.lit("Ann@X.org")])) == 1


def test_where(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, []), (3, "b", None)], "id int, v string, l array<string>")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    assert ids(where.eq("v", None)) == [2] and ids(where.ne("v", "a")) == [2, 3] and ids(where.ne("v", None)) == [1, 3]
    assert ids(where.nin("v", ["a"])) == [2, 3] and ids(where.in_("v", ["b", None])) == [2, 3] and ids(where.lt("v", "b")) == [1]
    assert ids(where.contains("l", "x")) == [1] and ids(where.none_in("l", ["x"])) == [2, 3] and ids(where.empty("l")) == [2]
    assert ids(where.search("A", ["v"])) == [1] and ids(where.search("", ["v"])) == [1, 2, 3]
    with pytest.raises(ValueError, match="unknown"):
        where.all_of([("like", "v", "a")])


def test_store(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id int, v string, on boolean")
    new = spark.createDataFrame([(2, "c", True), (3, None, True)], "id int, v string, on boolean")
    assert sorted(map(tuple, store.upsert(df, new, "id").collect())) == [(1, "a", True), (2, "c", True), (3, None, True)]
    assert sorted(map(tuple, store.retire_except(df, new, "id", "on").collect())) == [(1, "a", False), (2, "b", True)]
    assert store.flat_patch({"a": {"b": 1, "c": {"d": [2]}}, "e": 3}) == {"a.b": 1, "a.c.d": [2], "e": 3}
    nested = spark.createDataFrame([(1, ("n", "m"))], "id int, p struct<a string, b string>")
    assert store.set_fields(nested, {"p.a": F.lit("x"), "p.b": None}).first().p == ("x", None)
    assert store.empty_like(df).count() == 0


def test_identity(spark):
    rows = spark.createDataFrame([(1, "k", None, "s2"), (2, "k", "m", "s1"), (3, "k", "n", "s2"), (4, "j", None, None)], "seq int, k string, mail string, s string")
    got = {r.k: r for r in identity.first_values(rows, "k", "seq", ["mail"]).collect()}
    assert (got["k"].seq, got["k"].sightings, got["k"].mail, got["j"].mail) == (1, 3, "m", None)
    assert identity.ordered_union(rows, "k", "seq", "s", 5, "s").first().s == ["s2", "s1"]
    assert one(spark, identity.merged_evidence(F.array(F.lit("a"), F.lit("a b"), F.lit("b"), F.lit("c")))) == "a b\n\nc"
    known = spark.createDataFrame([(10, "r example"), (11, "r example"), (12, "a other")], "id int, s string")
    asked = spark.createDataFrame([(1, "r example"), (2, "a other")], "q int, s string")
    hits = identity.unique_matches(asked, "q", F.array("s"), known, "id", F.array("s"), "m").collect()
    assert [tuple(r) for r in hits] == [(2, 12)]


def test_order(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    sums = {r.id: r.s for r in order.running_sum(rows, ["id"], F.col("id"), "s").collect()}
    assert sums == {i: sum(range(i)) for i in range(100)}
    turns = {r.id: r.turn for r in order.interleaved(rows, "g", ["id"]).collect()}
    assert turns == {i: i // 3 + 1 for i in range(100)}
    assert order.within_budget(rows, ["id"], F.lit(10), 35).count() == 4


def test_mining(spark):
    df = spark.createDataFrame([("A µZorb Cellar4S and Cellar here. Nothing. Dr. Ann Example met Prof Bo Other.",)], "t string")
    found = mining.detect(df, "t", [("zorb", "Zorb", "Cellar[0-9A-Z]*"), ("none", "zzz", "z+")], "f").first().f
    assert [(x.brand, x.model) for x in found] == [("zorb", "Cellar4S")]
    assert one(spark, mining.mentions(F.col("t")), t="Dr. Ann Example met Prof Bo Other and Dr. Ann Example") == ["Ann Example", "Bo Other"]
    assert one(spark, mining.methods_section(F.col("t"), least=0, heading=False), t="Intro\nMethods\nshort\nResults\nx\nMaterials and Methods\nmuch longer text\nReferences\n") == "much longer text"
    assert one(spark, mining.snippets(F.col("t"), ["QX200"]), t="We used QX-200 here. Other QX2001. The QX 200.") == ["We used QX-200 here.", "The QX 200."]


def test_scores(spark):
    assert one(spark, scoring.relevance(F.lit("aa bb aa"), {"aa": 10, "bb": 4})) == 19
    assert one(spark, scoring.recency(F.lit(2018), 2020)) == 60 and one(spark, scoring.recency(F.lit(None).cast("int"), 2020)) == 50
    assert one(spark, scoring.rounded(F.lit(-2.5))) == -2


def test_affiliation(spark):
    place = "struct<id:string,name:string,lineage:array<string>,years:array<int>>"

    def status(known, history):
        df = spark.createDataFrame([("Oslo University", "i1", known, history)], f"n string, i string, k array<{place}>, h array<{place}>")
        return df.select(affiliation.assessment(F.col("n"), F.col("i"), F.col("k"), F.col("h"), 2024).alias("x")).first().x.status

    here, there = ("i1", "University of Oslo", [], [2023]), ("i2", "Bergen", [], [2024])
    assert status([here], [here]) == "current" and status([there], [here, there]) == "moved"
    assert status([there], [("i1", "Oslo", [], [2024]), there]) == "current"
    assert status([], [here]) == "current" and status([], [("i1", "Oslo", [], [2001])]) == "unknown"
    assert status([("i9", "Lab", ["i1"], [2024])], []) == "current"


def test_pages(spark):
    page = "<html><script>x</script><div><h3>Dr. Ann Example</h3></div><a href='/faculty'>People</a></html>"
    pages = spark.createDataFrame([(1, "http://x.org/a/", page), (2, None, None), (3, "http://x.org", "<a href='http://[bad'>q</a>")], "page_id long, url string, html string")
    assert html.page_people(pages).collect() == []  # one card is no listing
    links = {r.page_id: r for r in html.page_links(pages).collect()}
    assert links[1].link == "http://x.org/faculty" and links[3].link is None
    assert {r.page_id: r.text for r in html.page_text(pages).collect()}[2] == ""
    best = html.personal_email(F.array(F.lit("info@x.org"), F.lit("a.example@x.org"), F.lit("bo@x.org")), F.array(F.lit("ann"), F.lit("example")))
    assert one(spark, best) == "a.example@x.org"


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Full_Name,Institute,E-mail\n"Doe, A",X,"a ""b"""\n,Y,z\n')
    got = files.by_alias(files.read_csv(spark, str(tmp_path / "in.csv"))).collect()
    assert [(r.name, r.institution, r.email) for r in got] == [("Doe, A", "X", 'a "b"')]
    feed = "<rss><channel><item><title>T</title><link>L</link><pubDate>Mon, 02 Jan 2023 10:00:00 +0000</pubDate></item></channel></rss>"
    item = files.feed_items(spark.createDataFrame([(1, feed)], "k int, xml string"), "k", "xml").first()
    assert (item.title, item.link, item.published.year) == ("T", "L", 2023)


TOPIC = "name string, count long, subfield string, field string"


@pytest.mark.parametrize(
    ("department", "topics", "words", "want"),
    [
        ("Chemistry", [], "", ("chemistry", True, None)),
        ("Civil Engineering", [], "rebar Corrosion", ("civil", True, "corrosion")),
        ("Civil Engineering", [], "bridges", ("civil", False, None)),
        ("Physics", [("x", 9, "Chemistry", None)], "", ("other", False, None)),
        ("Physics", [], "a potentiostat", ("other", True, "electrochemistry")),
        (None, [("x", 4, "Biotechnology", None), ("y", 6, None, "Nuclear and High Energy Physics")], "", ("biotechnology", True, None)),
        (None, [("x", 3, "Biotechnology", None), ("y", 6, None, "Poetry")], "", ("other", False, None)),
        (None, [("x", 2, None, "Materials Science"), ("y", 2, "Chemistry", None)], None, ("materials", True, None)),
        (None, None, None, ("other", False, None)),
    ],
)
def test_domain_decisions(spark, department, topics, words, want):
    df = spark.createDataFrame([(department, topics, words)], f"d string, t array<struct<{TOPIC.replace(' string', ':string').replace(' long', ':bigint')}>>, w string")
    x = rules.with_domain(df, F.col("d"), F.col("t"), F.col("w"), "x").first().x
    assert (x.domain, x.kept, x.gate) == want


@pytest.mark.parametrize(("a", "b", "same"), [("S. Tal", "Sid Tal", True), ("Anil Kum", "Sunil Kum", False), ("M Anil Kum", "Anil Kum", True), ("Ann Example", "Ann Other", False), ("", "Ann", False), (None, "Ann", False)])
def test_same_person(spark, a, b, same):
    got = text.same_person(text.name_tokens(F.lit(a).cast("string")), text.name_tokens(F.lit(b)))
    assert one(spark, got) is same


def test_roster(spark):
    domain = F.struct(F.lit(False).alias("kept"))
    outcome = lambda role, senior, pinned=False, **more: tuple(one(spark, roster.decision(F.lit(role), F.lit(senior), domain, F.lit(pinned), **more)))
    assert outcome("professor", False) == ("excludedDomain", "professor") and outcome("professor", False, True) == ("kept", "professor")
    assert outcome("unknown", True) == ("excludedDomain", "inferred") and outcome("unknown", True, infer=False) == ("droppedUnconfirmed", "unknown")
    assert outcome("excluded", True, True) == ("excludedRole", "excluded") and outcome("excluded", True, stale_title=F.lit(True)) == ("excludedDomain", "inferred")
    members = spark.createDataFrame([("a", "", 3, ["x"], "excluded"), ("b", "t", 9, None, "promoted")], "k string, title string, works int, topics array<string>, status string")
    drafts = spark.createDataFrame([("a", "new", 2, ["x", "y"]), ("b", "new", None, ["z"]), ("c", None, 1, None)], "k string, title string, works int, topics array<string>")
    got = sorted(map(tuple, roster.merge_members(members, drafts, "k", ["title"], ["works"], {"topics": 2}).collect()))
    assert got == [("a", "new", 3, ["x", "y"], "eligible", "updated"), ("b", "t", 9, ["z"], "promoted", "updated"), ("c", None, 1, [], "eligible", "created")]
    again = roster.merge_members(members.limit(0), drafts, "k", ["title"], ["works"], {"topics": 2})
    assert {r.change for r in again.collect()} == {"created"}


def test_sweep(spark):
    members = spark.createDataFrame([(1, "ann"), (2, "bo")], "id int, name string")
    seen = spark.createDataFrame([(1, "ann", "Zorb", None), (2, "ann", "Zorb", "X1"), (3, "ann", "Zorb", "x1"), (4, "cy", "Zorb", None), (5, "bo", "Q", None)], "seq int, who string, brand string, model string")
    tagged, unknown = roster.swept(members, seen, [("name", [F.col("who")], [F.col("name")])], "id", "seq", "brand", "model")
    assert {r.id: [tuple(x) for x in r.instruments] for r in tagged.collect()} == {1: [("Zorb", "X1")], 2: [("Q", None)]}
    assert [r.who for r in unknown.collect()] == ["cy"]


def test_captured_works(spark):
    place = lambda k: ("https://x.org/" + k, k.upper(), "XX")
    author = lambda k, corresponding, *at: ((k, k, "https://orcid.org/0"), corresponding, [place(p) for p in at], ["raw"])
    rows = [
        ("w1", None, "T", 2020, [("t",), (None,)], {"b": [1], "a": [0]}, [author("p", True, "far"), author("q", False, "far", "here"), author("r", True, "here")]),
        ("w2", "doi", None, 2020, None, None, [author("p", None), author("q", True)]),
        ("w3", None, "T", 2020, None, None, []),
        ("w4", None, "T", 2020, None, None, None),
    ]
    works = spark.createDataFrame(rows, records.WORKS)
    got = {r.source_url: r for r in records.work_candidates(works, ["here"]).collect()}
    assert (got["w1"].name, got["w1"].institution_name, got["w1"].evidence_text, got["w1"].topics, got["w1"].orcid) == ("r", "HERE", "T. a b", ["t"], "0")
    assert (got["doi"].name, got["doi"].institution_name, got["doi"].publications) == ("q", "raw", []) and len(got) == 2
    assert sorted(r.name for r in records.work_candidates(works, ["here"], every=True).collect()) == ["q", "r"]


def test_awards(spark):
    rows = [("1", "Ann", "Example", "A@X.org", "U", "T", "12000 USD", "01/02/2021", "abs"), ("2", None, "", None, "U", "T", "1", "x", None), ("3", "Bo", None, None, None, None, "none", None, None)]
    awards = spark.createDataFrame(rows, "id string, first_name string, last_name string, email string, awardee string, title string, amount string, start string, abstract string")
    got = {r.name: r for r in records.award_grants(awards).collect()}
    assert set(got) == {"Ann Example", "Bo"} and (got["Ann Example"].grant.amount, got["Ann Example"].grant.year, got["Ann Example"].evidence_text) == (12000.0, 2021, "T. abs")
    assert (got["Bo"].grant.amount, got["Bo"].grant.year) == (None, None)


@pytest.mark.parametrize("t", ["a@b.com.x@y.org", "x a.b+c@D.org, A.b+c@d.org;e@f", "no address", "@x.org q@-.ab", "aaaa" * 50 + "@b.cd", "a@b@c.de", ""])
def test_emails_are_those_of_the_plain_pattern(spark, t):
    assert one(spark, html.emails(F.col("t")), t=t) == list(dict.fromkeys(x.lower() for x in re.findall(html.EMAIL, t)))


def test_models_only_with_their_brand(spark):
    df = spark.createDataFrame([("X1 alone",), ("Zorb X1 X1b",), (None,)], "t string")
    found = [r.f for r in mining.detect(df, "t", [("zorb", "Zorb", "X1[a-z]?")], "f").collect()]
    assert found[0] == [] and [x.model for x in found[1]] == ["X1b"] and found[2] == []


def test_every_model_is_detected(spark):
    lexicon = [("zorb", "Zorb", "Z[0-9]+[a-z]?"), ("quux", "Quux", "Q[0-9]+"), ("mimp", "Mimp", "M[0-9]+")]
    t = "Zorb Quux Mimp " + " ".join([*(f"Z{k}" for k in range(300, 280, -1)), "Z290b", *(f"Q{k}" for k in range(10, 30)), "M77"])
    want = []
    for brand, _, pattern in lexicon:
        models = list(dict.fromkeys(re.findall(rf"\b{pattern}\b", t)))
        want += [(brand, m) for m in models if not any(o != m and o.lower().startswith(m.lower()) for o in models)]
    found = mining.detect(spark.createDataFrame([(t,)], "t string"), "t", lexicon, "f")
    assert [(x.brand, x.model) for x in found.first().f] == want and len(want) == 41 and ("zorb", "Z290") not in want
    assert len(found.select(mining.merged_detections(F.col("f")).alias("f")).first().f) == 12


@pytest.mark.parametrize("heading", ["Instrumentation", "APPARATUS:", "2.1 Electrochemical measurements", "3.2. Characterisation", "Experimental details", "experimental procedures :", "Methods and Materials", "Materials  and Methods"])
def test_methods_headings(spark, heading):
    body = "A zorb was used for all of it, in a room of its own, and its readings were noted down twice."
    section = lambda t: one(spark, mining.methods_section(F.col("t"), heading=False), t=t)
    assert section(f"Intro\nwords\n\n{heading}\n{body}\n4. Results:\nmore words") == body
    assert section(f"Intro\nwords\n{heading}\nBibliography\n{body}") == f"Intro\nwords\n{heading}\nBibliography\n{body}"  # an empty section


def test_methods_fall_back_to_the_text(spark):
    section = lambda t: one(spark, mining.methods_section(F.col("t"), heading=False), t=t)
    assert section("No heading here.\nA zorb was used.") == "No heading here.\nA zorb was used."
    assert section("Intro\nMethods\nshort\nResults\nx") == "Intro\nMethods\nshort\nResults\nx" and section("") == ""
    assert section("our methods\n" + "x" * 30_000) == ("our methods\n" + "x" * 30_000)[:12_000]
