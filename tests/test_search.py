"""Search by queries and by parts of keys, against every pair of a small table."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.operators import containment, search

PEOPLE = [
    (1, "Sagar Mitra", "sm@x.in", "Professor", ["batteries", "corrosion"], "0000-0001", 5, True), (2, "Siddharth Tallur", "st@x.in", "Associate Professor", ["sensors"], None, 9, True), (3, "Sagar Patil", None, "Dean", [], "A512", 1, True),
    (4, "Zoë Müller", "zoe@y", None, ["metallurgical engineering"], None, 7, True), (5, "", None, None, None, None, 2, True), (6, None, "", "x", ["x"], "", 3, True), (7, "Sagar Mitra", "other@x", "Professor", ["batteries"], None, 5, False),
    (8, "aaaa bbbb", None, "aaaaaaaaaaaa", ["abababab"], None, 4, True), (9, "Mitra Sagar", "m@z", "Emeritus", ["corrosions", "batterys"], None, 5, True),
]
QUERIES = ["Sagar Mitra", "talur", "s tallur", "mitra", "prof", "muller", "x.in", "0000-0001", "512", "batery", "corosions", "metalurgicl", "", None, "  ", "漢字", "sagar sagar", "aaaaaaaa", "aaaa", "abababba", "zzz", "m", "professors dean", "ba"]
SCHEMA = "id int, name string, email string, title string, topics array<string>, orcid string, works int, listed boolean"


def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def test_search_finds_what_the_ladder_finds(spark):
    rows, ids = people(spark).where("listed"), ["email", "orcid"]
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, q string")
    got = {(r.query_id, r.id): (round(r.score, 9), r["rank"], r.total) for r in search.fuzzy_search(asked, "query_id", "q", people(spark), "id", "name", ["title", "topics", "email"], ids, where=F.col("listed"), ties=[F.desc("works")], limit=100).collect()}
    want = {}
    for n, q in enumerate(QUERIES):
        score = fuzzy.fuzzy_score(q or "", F.coalesce("name", F.lit("")), [F.coalesce(c, F.lit("")) for c in ("title", "email")] + [F.coalesce(F.array_join("topics", " "), F.lit(""))], [F.col(c) for c in ids])
        found = [(-round(r.s, 9), -r.works, r.id) for r in rows.select("id", "works", score.alias("s")).collect() if r.s >= 0.6]
        want |= {(n, i): (-s, k + 1, len(found)) for k, (s, _, i) in enumerate(sorted(found))}
    assert got == want and len(want) >= 60


def test_pages(spark):
    asked = spark.createDataFrame([(1, "sagar"), (2, "SAGAR ")], "query_id int, q string")
    one = lambda page: sorted((r.query_id, r.id, r["rank"], r.total) for r in search.fuzzy_search(asked, "query_id", "q", people(spark), "id", "name", [], [], page=page, limit=2).collect())
    assert one(1) == [(1, 1, 1, 4), (1, 3, 2, 4), (2, 1, 1, 4), (2, 3, 2, 4)] and one(2) == [(1, 7, 3, 4), (1, 9, 4, 4), (2, 7, 3, 4), (2, 9, 4, 4)] and one(3) == []
    none = people(spark).limit(0)
    assert search.fuzzy_search(asked, "query_id", "q", none, "id", "name", [], ["orcid"]).collect() == [] and search.fuzzy_search(asked.limit(0), "query_id", "q", people(spark), "id", "name", [], []).collect() == []


def test_all_fitting_words_are_found(spark):
    """Random words of few letters, where grams repeat: no pair that the ladder lets fit is missed."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 12)))
    words, terms = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    asked, known = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, 1) for t in terms], "term string, people long")
    got = {(x.word, x.term): x.score for x in search.fitting(asked, known).collect()}
    every = asked.crossJoin(known.select("term")).withColumn("s", search.ladder(F.col("word"), F.col("term"))).where("s > 0")
    assert got == {(x.word, x.term): x.s for x in every.collect()} and len(got) > 500
    some = known.select("term", *(fuzzy.token_score(w, F.col("term")).alias(str(k)) for k, w in enumerate(words[:20]))).collect()
    assert all(got.get((w, x.term), 0.0) == x[str(k)] for x in some for k, w in enumerate(words[:20]))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_keys_in_keys(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab ") for _ in range(r.randint(0, n)))
    keys, texts = [word(7) for _ in range(80)] + [None, "", "zz", "a"], [word(30) for _ in range(80)] + [None, "", "a"]
    k, t = spark.createDataFrame([(x,) for x in keys], "k string"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = containment.holders(k, "k", t, "t")
    assert {(x.key, x.text) for x in got.collect()} == {(a, b) for a in keys for b in texts if a and b and a in b} and got.count() == got.distinct().count()
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert containment.holders(k.limit(0), "k", t, "t").collect() == [] and containment.holders(k, "k", t.limit(0), "t").collect() == []
    both = {(x.k, x.t) for x in containment.either_way(k, "k", t, "t", 3).collect()}
    assert both == {(a, b) for a in keys for b in texts if a and b and (a in b or (b in a and len(b.split(" ")) >= 3))}


def test_names_in_texts(spark):
    texts = spark.createDataFrame([("Prof. X, IIT BOMBAY campus",), ("Delhi",), (None,)], "card string")
    names = spark.createDataFrame([("IIT Bombay",), ("Delhi",), ("X",)], "name string")
    assert [tuple(r) for r in containment.named_in(texts, "card", names, "name").collect()] == [("Prof. X, IIT BOMBAY campus", "IIT Bombay")]
    pairs = spark.createDataFrame([("t", "ab"), ("t", "abc"), ("t", "abd")], "t string, k string")
    assert [tuple(r) for r in containment.longest_held(pairs, "t", "k").collect()] == [("t", "abc")]
