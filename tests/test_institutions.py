from pyspark.sql import functions as F

from dossier.operators import institutions, paging


def test_names_and_targets(spark):
    raw = spark.createDataFrame([("https://o/I1", "Indian Institute of Technology Zorbia", "r1", "https://www.z.ac.in/", ["IITZ", "ZI"], ["Zorbia Institute", "Old College"]), ("https://o/I2", None, None, None, None, None), ("https://o/I3", "Quux College", None, None, None, None)], "id string, display_name string, ror string, homepage_url string, display_name_acronyms array<string>, display_name_alternatives array<string>")
    own = institutions.profile(raw)
    assert [(r.id, r.name, r.acronyms) for r in own.orderBy("id").collect()] == [("I1", "Indian Institute of Technology Zorbia", ["IITZ", "ZI"]), ("I3", "Quux College", [])]
    places = own.select(F.col("id").alias("place"), "name")
    names = institutions.spellings(places, own)
    assert sorted((r.place, r.name) for r in names.collect()) == [("I1", "IIT Zorbia"), ("I1", "IITZ"), ("I1", "Indian Institute of Technology Zorbia"), ("I1", "Zorbia Institute"), ("I3", "Quux College")]
    assert sorted(r.name for r in institutions.search_phrases(names).collect()) == ["IIT Zorbia", "Indian Institute of Technology Zorbia", "Quux College", "Zorbia Institute"]
    targets = spark.createDataFrame([("IIT Zorbia", "u1", True, 1), ("Indian Institute of Technology Zorbia, Chemistry", "u2", True, 2), ("Nowhere", "u3", True, 3), ("Quux College", "u4", False, 4), ("IIT Zorbia", "u0", True, 5), ("", "u5", True, 6)], "name string, url string, enabled boolean, line int")
    assert sorted((r.place, r.url) for r in institutions.matched_targets(targets, places).collect()) == [("I1", "u0"), ("I1", "u1"), ("I1", "u2"), ("I3", "u4")]
    assert [r.url for r in institutions.matched_targets(targets, places, places.where("place = 'I3'")).collect()] == ["u4"]
    assert {r.place: r.urls for r in institutions.directory_urls(places, targets).collect()} == {"I1": ["u1", "u2", "u0"], "I3": []}


def test_seeds_and_feeds(spark):
    df = spark.createDataFrame([("a", "https://www.z.ac.in/"), ("b", "no address"), ("c", None)], "place string, homepage string")
    got = [(r.place, r.url, r.label, r.hint) for r in institutions.url_seeds(df, "homepage", ["Civil", "x"]).collect()]
    assert got == [("a", u, f"{c} department", "civil") for c in ("civil", "ce") for u in (f"https://www.{c}.z.ac.in", f"https://{c}.z.ac.in", f"https://www.z.ac.in/{c}")]
    assert institutions.url_seeds(df, "homepage", []).count() == 0
    texts = spark.createDataFrame([("<?xml?><RSS version='2'>",), ("<html>",), (" " * 1000 + "<rss",), (None,), ("<rdf:RDF>",)], "t string")
    assert [r.f for r in texts.select(institutions.looks_like_feed(F.col("t")).alias("f")).collect()] == [True, False, False, False, True]


def test_pages_until(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 1, "c"), (1, 2, "a"), (1, 2, "b"), (1, 3, "z"), (2, 5, "a"), (2, 6, "b"), (2, 7, "c"), (2, 8, "d"), (3, 0, "a"), (3, 1, "b")]
    df = spark.createDataFrame(rows, "s int, p int, i string")
    kept, summary = paging.paged_until(df, "s", "p", "i", most=3)
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 0), (1, "b", 0), (1, "c", 1), (2, "a", 5), (2, "b", 6), (2, "c", 7), (3, "a", 0), (3, "b", 1)]
    assert sorted((r.s, r.pages, r["rows"], r.found, r.stopped, r.truncated) for r in summary.collect()) == [(1, 3, 6, 3, "dry", False), (2, 3, 3, 3, "ceiling", True), (3, 2, 2, 2, "end", False)]
    assert {r.s: (r.pages, r.stopped) for r in paging.paged_until(df, "s", "p", "i", budget=3)[1].collect()} == {1: (2, "budget"), 2: (3, "budget"), 3: (2, "end")}
    assert paging.paged_until(df.limit(0), "s", "p", "i")[1].collect() == []
