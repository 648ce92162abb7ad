"""Blocks of pages and what is read from them, phrases and catalogues, on invented fixtures."""

import pytest
from pyspark.sql import functions as F

from dossier.functions.text import name_tokens
from dossier.operators import keywords
from dossier.sources import html, profiles

PROFILE = """<html><body><nav><a href="/login">Login</a></nav><h1>Dr. Ann <i>Example</i></h1><table><tr><th>Designation</th><td>Associate Professor</td></tr>
<tr><td>Department:</td><td>Chemistry</td></tr></table><p><b>Affiliation:</b> Institute of Samples</p><p>Phone: +00 1234 5678</p><dl><dt>Expertise<dd>Corrosion</dl>
<a href="https://orcid.org/0000-0001-2345-678X">id</a> <a href="/lab">Our lab</a> <a href="/lab/">again</a> <a href="https://elsewhere.example/a.pdf">paper</a> <a href="https://elsewhere.example/x">My pages</a>
<a href="/facilities">Facilities</a><a href="/news.pdf">research</a><a href="#top">lab</a><script>x = "<p>Phone: 999999999</p>"</script></body></html>"""
NEWS = """<header><h2>A heading that is in the header</h2></header><h2 class="t"><a href="/n/1">New instrument <span class="x">installed</span> here</a></h2><p>Prof. Bo Sample opened it.</p>
<h3>Short</h3><h3>new instrument INSTALLED here</h3><div><a href="n/2"><h3>Another item of some length</h3></a></div><footer><h3>Footer heading of some length</h3></footer>"""
LISTING = """<p>1,234 Total Experts</p><div class="exp-card"><div class="exp-title"><a href="/profile/12">Prof. Dr. Cy Fiction</a></div><span class="exp-role-text">Professor</span>
<div class="exp-meta-row-university"><span>University of Tests</span></div></div><div class="exp-card"><a href="/profile/13">Di Novel</a><a href="/profile/12">again</a></div><a href="/other/5">no</a>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.example/p", PROFILE), (2, "https://a.example/news/", NEWS), (3, "https://r.example/", LISTING), (4, None, None), (5, "https://a.example/e", ""), (6, "https://a.example/z", "<b>" * 3000 + "deep" + "<p>x" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def blocks(pages):
    return profiles.page_blocks(pages).cache()


def test_profile(blocks):
    got = {r.page_id: r.p for r in blocks.select("page_id", profiles.profile(F.col("blocks")).alias("p")).collect()}
    p = got[1]
    assert (p.name, p.institution, p.department, p.designation, p.phone, p.orcid, p.expertise) == ("Ann Example", "Institute of Samples", "Chemistry", "Associate Professor", "+00 1234 5678", "0000-0001-2345-678X", "Corrosion")
    assert "999999999" not in p.text
    assert got[4].name is None and got[5].institution is None and "deep" in got[6].text


def test_known_institution_and_free_fields(spark, blocks):
    got = blocks.where("page_id = 3").select(profiles.affiliation(F.col("blocks"), ["Elsewhere", "university of tests"]).alias("a"), profiles.listed_total(profiles.whole_text(F.col("blocks"))).alias("n")).first()
    assert got.a.institution == "university of tests" and got.n == 1234
    text = spark.createDataFrame([("x, head of the department, Department of Applied Things. Tel 12-34",), (None,)], "t string")
    rows = text.select(profiles.designation(F.col("t")).alias("d"), profiles.department(F.col("t")).alias("p"), profiles.phone(F.col("t")).alias("n")).collect()
    assert tuple(rows[0]) == ("Head of the Department", "Department of Applied Things", None) and tuple(rows[1]) == (None, None, None)


def test_headlines(blocks):
    got = profiles.headlines(blocks).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.title, r.link, r.summary) for r in got] == [(2, "New instrument installed here", "https://a.example/n/1", "Prof. Bo Sample opened it."), (2, "Another item of some length", "https://a.example/news/n/2", None)]
    assert list(got[0].names) == ["Bo Sample"]
    assert profiles.headlines(blocks, limit=1).count() == 1


def test_cards(blocks):
    got = [tuple(r) for r in profiles.registry_cards(blocks).orderBy("registry_id").select("registry_id", "profile_url", "name", "designation", "institute", "subject").collect()]
    assert got == [("12", "https://r.example/profile/12", "Cy Fiction", "Professor", "University of Tests", None), ("13", "https://r.example/profile/13", "Di Novel", None, None, None)]


def test_links(spark, pages):
    links = html.page_links(pages)
    assert [r.link for r in profiles.websites(links).orderBy("position").collect()] == ["https://a.example/lab", "https://elsewhere.example/x"]
    assert [(r.link, r.score) for r in profiles.equipment_pages(links.where("page_id = 1")).orderBy(F.desc("score")).collect()] == [("https://a.example/facilities", 8), ("https://a.example/lab", 3)]
    wanted = name_tokens(F.lit("C. Fiction"))
    assert [r.link for r in profiles.profile_links(links, wanted).collect()] == ["https://r.example/profile/12"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


def test_queries_of_models_and_brands(spark):
    assert one(spark, keywords.spellings(F.lit("CHI660E"))) == ["CHI660E", "CHI 660E", "CHI-660E", "CHI 660 E"]
    assert one(spark, keywords.spellings(F.lit("SP-150")))[:2] == ["SP-150", "SP150"]
    assert one(spark, keywords.model_query(F.lit("Some Brand"), F.lit("Go"), F.lit(False))) == '"Some Brand" Go'
    assert one(spark, keywords.brand_query(F.lit("Brand (Owner)"), strings("X1", "x1", None), strings("Bra-nd", "brand"))) == 'Brand OR X1 OR "Bra-nd"'
    assert one(spark, keywords.any_of(strings(" a b ", "", "c"))) == '"a b" OR c'


def test_phrases(spark):
    cases = {"abc": False, "redox flow": True, "one two three four five": False, "sw202 part": False, "18650 battery": False, "li 18650 battery": True, "starter kit": False, "Sensors": False, "abx12 use of it": False, None: False}
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.x for r in rows.select("p", keywords.searchable(F.col("p"), ["sensors"], ["acme"], r"^abx\d").alias("x")).collect()}
    assert got == cases
    assert one(spark, keywords.model_tokens(F.lit("Abx Pico Abx4 (kit) abx"), "(?i)^abx")) == ["Abx Pico", "Abx", "Abx4 kit", "Abx4"]
    phrases = spark.createDataFrame([(k, p) for k, p in enumerate(["b b", "a", "B B", " ", None, "c", "d"])], "k int, p string")
    assert [tuple(r) for r in keywords.phrase_batches(phrases, "p", ["k"], 3).orderBy("batch").collect()] == [(0, '"b b" OR a OR c'), (1, "d")]
    assert keywords.phrase_batches(phrases.where("false"), "p", ["k"], 3).count() == 0


def test_tags_and_catalogue(spark):
    assert one(spark, keywords.useful_tags(strings("80mm", "ab", "cs350", "xy-12", "&#39;s", "Model", "flow cell", None), ["model"], r"^cs\d")) == ["cs350", "flow cell"]
    rows = spark.createDataFrame([(1, "A (b)", "Zed Pro", ["zed", "mesh", "5mm"], None), (2, "c", "Other", None, "Words")], "k int, slug string, title string, tags array<string>, short string")
    made = keywords.catalogue(rows, "slug", F.col("title"), [(F.lower("title").contains("pro"), "pro", ["a", "a"], ["p"])], ("rest", [], []), F.col("tags"), [F.col("short"), F.col("title")], "^zed", keep=["k"])
    assert [tuple(r) for r in made.orderBy("k").collect()] == [(1, "a-b", "Zed Pro", "pro", ["a"], ["p", "zed", "mesh"], "Zed Pro", True), (2, "c", "Other", "rest", [], [], "Words", True)]
    tags = spark.createDataFrame([(k, ["in all", f"own {k}", "single"]) for k in range(12)], "id int, tags array<string>")
    assert {r.tag for r in keywords.distinctive_tags(tags, "id", "tags").collect()} == {f"own {k}" for k in range(12)}
