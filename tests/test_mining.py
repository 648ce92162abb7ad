"""Texts and pages as the wild has them: names, sections, snippets, cards of people and links to them."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import mining
from dossier.sources import html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_mentions(spark):
    t = "Dr. Jane Smith And Colleagues; Prof. R. K. Rao; Dr Émile Zola; Prof. Mary O'Neil; Dr. Mary A. Lee; Professor Maria Garcia Lopez of Spain; Dr.\n José  Núñez; dr. no one; Dr Jane Smith The Third"
    assert one(spark, mining.mentions(F.col("t")), t=t) == ["Jane Smith", "Émile Zola", "Mary O'Neil", "Mary A. Lee", "Maria Garcia Lopez", "José Núñez"]
    assert one(spark, mining.mentions(F.col("t")), t=" ".join(f"Dr. Ann {a}aa." for a in "BCDEFGHIJKLMN")) == [f"Ann {a}aa" for a in "BCDEFGHIJK"]


@pytest.mark.parametrize("heading", ["Experimental Details", "Instrumentation", "2.1 Apparatus", "Materials and Methods:", "ELECTROCHEMICAL MEASUREMENTS", "Characterisation"])
@pytest.mark.parametrize("end", ["Bibliography", "4. Results and Discussion", "Acknowledgements:", "References"])
def test_methods_section(spark, heading, end):
    body = "A potentiostat was used for all of the measurements. " * 3
    t = f"Title\n{heading}\nshort\n{end}\nIntro\n{heading}\n{body}\n{end}\nmore"
    assert one(spark, mining.methods_section(F.col("t")), t=t).strip() == f"{heading}\n{body}".strip()
    assert one(spark, mining.methods_section(F.col("t"), limit=30), t=t).strip() == f"{heading}\n{body}"[:30].strip()


def test_methods_section_falls_back_to_the_text(spark):
    for t in ("no heading at all, " * 30, "Intro\nMethods\nshort\nReferences\nx"):
        assert one(spark, mining.methods_section(F.col("t")), t=t) == t
    assert one(spark, mining.methods_section(F.col("t")), t="x" * 20_000) == "x" * 12_000


def test_snippets(spark):
    find = lambda t, *terms, **kw: one(spark, mining.snippets(F.col("t"), list(terms), **kw), t=t)
    assert find("Zorby here. zorby  here. Not zorbyx; a Zorby-1; on\nZorby line", "Zorby") == ["Zorby here.", "a Zorby-1;", "Zorby line"]
    long = "a" * 200 + " " + "b" * 199 + " Zorby " + "c" * 300 + "."
    got = find(long, "Zorby")
    assert len(got) == 1 and "Zorby" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) == 262
    assert find("Zorby " + "c" * 300, "Zorby") == ["Zorby " + "c" * 254 + "…"]
    assert find("a QXI660E, b QXI 660E. c QXI-660E! d QXI660EX", "QXI660E") == ["a QXI660E, b QXI 660E.", "c QXI-660E!"]
    assert find("an A+B (x) here. ax", "A+B (x)", "ax", "x") == ["an A+B (x) here."]  # patterns are plain text, short terms say nothing
    assert find("one two. " * 3 + "".join(f"three {k}. " for k in range(40)), "three", limit=5) == [f"three {k}." for k in range(5)]
    assert find("anything", "xy") == []


CARDS = """<nav><div class="p"><a href="/people/x">Guest Lecture</a></div></nav>
<div class="grid"><div class="p c"><h3>Dr. José Núñez</h3><p>Professor</p></div>
<div class="c p"><span>PhD MIT</span><strong>Ann Lee</strong><a href="mailto:Ann.Lee@x.ac.in?subject=hi">write</a> or lee@x.ac.in</div>
<div class="p c"><a href="people/mary">Mary A. O'Neil</a></div>
<div class="p c"><a href="https://other.org/people/z">Zed Zorn</a></div>
<div class="p c"><h4>Ann Lee</h4><p>Reader</p></div><div class="p c"><h4>Grievance Redressal</h4><a href="/faculty/1">x</a></div></div>
<ul><li class="n"><a href="/a">Project Work</a><li class="n"><a href="/b">Explore More</a><li class="n">Notice</ul>"""


def test_people_on_a_page_of_cards(spark):
    pages = spark.createDataFrame([(1, "https://chem.x.ac.in/a/b.html", CARDS), (2, "https://x.org", "<div class=a>Ann Lee</div>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.name: (r.title, r.email, r.profile_url) for r in html.page_people(pages).collect()}
    assert got == {
        "Dr. José Núñez": ("Professor", None, None),
        "Ann Lee": (None, "ann.lee@x.ac.in", None),
        "Mary A. O'Neil": (None, None, "https://chem.x.ac.in/a/people/mary"),
    }


@pytest.mark.parametrize(
    ("name", "fits"),
    [("Ann Lee", True), ("Prof. Jan van Dyk", True), ("Ann B. Lee", True), ("Ana María de Souza", False), ("Bob", False), ("Ann Lee 2", False), ("Guest Lecture", False), ("Ann lee", False), ("Ludwig von Mises", True), ("Ällen Örn", True), ("Ann", False)],
)
def test_names(spark, name, fits):
    assert one(spark, html.is_name(F.col("t")), t=name) is fits


@pytest.mark.parametrize(
    ("link", "label", "score"),
    [("https://x.in/faculty", "Our faculty", 10 + 5 + 6), ("https://chem.x.in/people/", "People", 10 + 8 + 6), ("https://x.in/a/b/c/d/e/f", "staff", 10 - 2), ("https://x.in/a", "b", 0), ("https://x.in/Nano", "our-team", 18)],
)
def test_link_scores(spark, link, label, score):
    assert one(spark, html.link_score(F.col("a"), F.col("b")), a=link, b=label) == score


def test_directory_links(spark):
    page = '<a href="/faculty/">F</a><a href="/faculty#x">again faculty</a><a href="https://chem.x.ac.in/people">P</a><a href="https://other.org/people">O</a><a href="/staff/news">N</a><a href="mailto:faculty@x">m</a><a href="/plain">p</a>'
    pages = spark.createDataFrame([(1, "https://www.x.ac.in/", page)], "page_id long, url string, html string")
    assert {r.link: r.score for r in html.directory_links(pages).collect()} == {"https://www.x.ac.in/faculty": 21, "https://chem.x.ac.in/people": 24}


@pytest.mark.parametrize(("href", "want"), [("/a", "https://h.org/a"), ("b", "https://h.org/x/b"), ("//c.org/d", "https://c.org/d"), ("http://e.org", "http://e.org"), ("?q=1", "https://h.org/x/y.html?q=1")])
def test_absolute(spark, href, want):
    assert one(spark, html.absolute(F.col("h"), F.lit("https://h.org/x/y.html?z#t")), h=href) == want


def test_campuses(spark):
    key = lambda t: one(spark, text.expanded_institution_key(F.col("t")), t=t)
    assert key("IITB-Monash Research Academy") == key("Indian Institute of Technology Bombay - Monash Research Academy")
    assert key("iit goa") == key("Indian Institute of Technology Goa") and key("IIT KGP") == key("IITKGP") == key("Indian Institute of Technology, Kharagpur")
    assert key("NITK") == key("National Institute of Technology Karnataka") and key("iitb") == "iitb"
