"""Queries against their SQL on tables that the given ones don't have: folders of files, more keys, odd pages; and steps that must not grow with a group's square."""

import os
from itertools import groupby

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.operators import containment, keywords, lists, search
from dossier.plans import built, found, leads, pages, people, runs, streams  # noqa: F401
from dossier.plans.queries import ORACLE_SQL, QUERIES
from dossier.sources import html
from dossier.streaming import activity


@pytest.fixture
def agrees(spark, sf, tmp_path):
    """agrees(name, table=DataFrame, ...): whether a query and its SQL give the same rows over the given tables and, for the rest, the smallest ones."""

    def run(name, **tables):
        folder, duck = tmp_path / "in", duckdb.connect()
        folder.mkdir()
        for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split():
            at = folder / f"{t}.parquet"
            if t in tables:
                tables[t].write.parquet(str(at))
            else:
                os.symlink(f"{sf}/{t}.parquet", at)
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
        got, own = QUERIES[name](spark, str(folder)), duck.sql(ORACLE_SQL[name])
        columns = sorted(got.columns)
        assert sorted(own.columns) == columns
        at = [own.columns.index(c) for c in columns]
        return sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in own.fetchall())

    return run


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize(("name", "of"), [("thread_state", "conversations"), ("incremental_upsert", "events")])
def test_streams_of_a_table_in_several_files(spark, sf, agrees, name, of):
    assert agrees(name, **{of: table(spark, sf, of).repartition(3)})


def test_numbers_beyond_a_million(spark, sf, agrees):
    part = table(spark, sf, "part")
    far = part.where("p_partkey < 40").withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
    assert agrees("upsert_retire", part=part.unionByName(far))


def test_counts_of_holders_are_those_of_the_pairs(spark):
    """Keys shorter than a gram, as long and longer; a key that all texts hold."""
    texts = spark.createDataFrame([(f"{k:012d}x{k % 7}",) for k in range(300)] + [("",), (None,)], "t string")
    keys = spark.createDataFrame([(x,) for x in ("0", "00", "17", "99", "0000002", "00000025", "0000000250", "000000000250x5", "nowhere", "", None)], "k string")
    pairs = sorted((k, t) for (k,) in keys.collect() for (t,) in texts.collect() if k and t and k in t)
    assert sorted((r.key, r.text) for r in containment.holders(keys, "k", texts, "t").collect()) == pairs
    want = sorted((k, len(x), min(x), max(x)) for k in {k for k, _ in pairs} for x in [[t for o, t in pairs if o == k]])
    assert sorted(map(tuple, containment.holder_counts(keys, "k", texts, "t").collect())) == want


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_pieces_are_not_broadcast(spark, sf):
    """Packed tables look small to Spark: no plan of these queries builds a broadcast of what is exploded from them."""
    assert "BroadcastHashJoin" not in plan_of(QUERIES["key_holders"](spark, sf))
    people = spark.range(100).select("id", F.concat(F.lit("Ann B"), "id").alias("name"))
    found = search.scored(search.index(people, "id", "name", [], []), people.select("id", "name"), "name")
    assert "BroadcastExchange" not in plan_of(found)


def test_who_never_ordered(spark, sf, agrees):
    assert agrees("relevance_blend", orders=table(spark, sf, "orders").where("o_custkey % 3 > 0"))


ODD = "<html><head><title>t &amp;&amp</title></head><body><h1>Say &quot;so&quot; &amp;lt; &lt;&amp;&amp</h1><p>a&quot;b&ampc &copy</p></body></html>"


@pytest.mark.parametrize("name", ["html_text", "news_headlines", "profile_fields"])
def test_references_that_are_cut(spark, sf, agrees, name):
    pages = table(spark, sf, "pages")
    assert agrees(name, pages=pages.limit(20).unionByName(pages.limit(1).withColumns({"page_id": F.lit(-1).cast(pages.schema["page_id"].dataType), "html": F.lit(ODD)})))


def test_pages_are_parsed_a_few_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000))})
    parts = list(html.few([batch]))
    assert max(p.num_rows for p in parts) == html.PAGES and [k for p in parts for k in p["k"].to_pylist()] == list(range(1000))


def test_no_more_authors_than_are_wanted_meet_the_questions(spark):
    """One name that all share: 400 questions and 400 authors, two questions of one number with other names, ties by id."""
    authors = spark.range(400).select(F.when(F.col("id") < 390, "a").otherwise("b").alias("key"), F.col("id").alias("author_id"), (F.col("id") % 9).alias("works"))
    asked = spark.range(400).select(F.col("id").alias("q"), F.lit("a").alias("key")).unionByName(spark.createDataFrame([(7, "b"), (500, "c"), (501, None)], "q long, key string"))
    out = lists.author_candidates(asked, authors, ["key"], "q", 3)
    got = out.collect()
    assert len(got) == 1200 and [r.author_id for r in sorted(got, key=lambda r: r["rank"]) if r.q == 7] == [8, 17, 26]
    assert rows_of_joins(out) <= 401 * 3


def test_every_question_gets_its_authors(spark, agrees, tmp_path):
    """Customers of any number, one that comes twice, one with two places, two without a number; places that nobody shares and none; more and fewer than five authors, ties by number."""
    asked = [(k, k % 4) for k in range(1, 41)] + [(7, 3), (8, 1), (None, 2), (None, 2), (41, 9), (42, None)]
    known = [(k, 0 if k < 3 else k % 3 + 1, None if k == 20 else float(k % 5)) for k in range(1, 31)] + [(31, None, 9.0), (32, 8, 9.0)]
    customer = spark.createDataFrame(asked, "c_custkey long, c_nationkey int")
    assert agrees("author_candidates", customer=customer, supplier=spark.createDataFrame(known, "s_suppkey long, s_nationkey int, s_acctbal double"))
    first = {n: sorted((k for k, m, _ in known if m == n), key=lambda k: (k == 20, -(k % 5), k))[:5] for n in range(4)}
    got = QUERIES["author_candidates"](spark, str(tmp_path / "in")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((c, a, place)) for c, n in asked for place, a in enumerate(first.get(n, []), 1))


def rows_of_joins(df):
    """The most rows that a join of the plan that ran has made."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().get("numOutputRows").get().value())
        todo += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_equal_texts_are_looked_up_once(spark):
    texts = spark.range(500).select("id", F.array(F.lit("ring"), F.lit("bolt"), F.lit("ring"), F.when(F.col("id") % 2 == 0, "wide").otherwise("narrow"), F.lit("on")).alias("w")).unionByName(spark.createDataFrame([(900, None), (901, ["on"])], "id long, w array<string>"))
    products = spark.createDataFrame([(f"p{k}", ["ring", "wide"] if k % 2 else ["bolt", "on"]) for k in range(20)], "p string, t array<string>")
    out = lists.best_products(texts, "id", F.col("w"), products, "p", F.col("t"), 2)
    rows = {k: [(r.p, r.hits) for r in sorted(g, key=lambda r: r["rank"])] for k, g in groupby(sorted(out.collect(), key=lambda r: r.id), key=lambda r: r.id)}
    assert len(rows) == 500 and rows[0] == [("p1", 2), ("p11", 2)] and rows[1] == [("p0", 1), ("p1", 1)]
    assert rows_of_joins(out) <= 1000


def test_runs_keep_their_sources_not_a_sketch(spark, tmp_path):
    rows = [(k % 3, "2024-01-01 00:00:00", "created", None if k == 5 else f"s{k % 40}") for k in range(240)]
    spark.createDataFrame(rows, "run int, at string, outcome string, source string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    counts = activity.run_counts(spark.readStream.schema("run int, at timestamp, outcome string, source string").parquet(str(tmp_path / "in")), ["run"], "at", "outcome", "source", late="1 day")
    assert "approx_count_distinct" not in counts._jdf.queryExecution().analyzed().toString()
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    activity.appended(counts, str(tmp_path / "log"), str(tmp_path / "progress"), "update")
    assert sorted((r.run, r.sources_run, r.candidates_found) for r in activity.last_runs(spark, str(tmp_path / "log"), ["run"]).collect()) == [(0, 40, 80), (1, 40, 80), (2, 40, 80)]


def test_pieces_are_written_without_a_sort(spark, tmp_path):
    """Each remainder is a file of its own; the plans that ran hold no sort."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    out = streams._pieces(spark.range(1000), str(tmp_path / "in"), "id", 4)
    assert out.isStreaming and spark.conf.get(key) == before
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    ran = [x for x in (store.apply(k).physicalPlanDescription() for k in range(store.size())) if str(tmp_path) in x and "InsertIntoHadoopFsRelationCommand" in x]
    assert ran and not any("Sort" in x for x in ran)
    files = [[r.id % 4 for r in spark.read.parquet(str(p)).collect()] for p in (tmp_path / "in").rglob("*.parquet")]
    assert sorted((len(f), f[0], len(set(f))) for f in files) == [(250, k, 1) for k in range(4)]


@pytest.mark.parametrize("name", ["verify_lead", "affiliation_patch"])
def test_costly_rows_of_one_file_are_many_tasks(spark, sf, name):
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, sf))


def test_tags_are_dealt_out_before_they_are_made_distinct(spark, sf, monkeypatch):
    """No set of pairs is built in the tasks that read a file; tasks are as many as rows ask for; rows that occur twice, null lists and null tags count as ever."""
    plan = plan_of(QUERIES["distinctive_tags"](spark, sf))
    assert plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM") and "SortMergeJoin" not in plan
    monkeypatch.setattr(keywords, "ROWS", 10)
    rows = [(k % 40, [f"Own {k % 40}", " own  x ", f"of {k % 2}", "single", "", None]) for k in range(80)] + [(99, None), (98, [])]
    out = keywords.distinctive_tags(spark.createDataFrame(rows, "id int, tags array<string>"), "id", "tags")
    assert "REPARTITION_BY_NUM" in plan_of(out) and ", 48), REPARTITION_BY_NUM" in plan_of(out)
    assert sorted(map(tuple, out.collect())) == sorted((f"own {k}", 1) for k in range(40))
    assert keywords.distinctive_tags(spark.createDataFrame([], "id int, tags array<string>"), "id", "tags").collect() == []
