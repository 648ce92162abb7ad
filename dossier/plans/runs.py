"""Whole runs and filtered lists over the given tables. A person is a number that suppliers, customers, parts and orders share; names are made of its digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import lists, reports, runs
from dossier.plans.built import _name
from dossier.plans.queries import DEPARTMENTS, DOMAINS, ROLES, TITLES, query, table

SOURCES = ["openalex", "orcid", "registry", "faculty_page"]
AS_OF = 2024


def _of(values: dict[str, str], key: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(key))


def _sql(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _seen(spark, sf_dir) -> DataFrame:
    """Sightings of four sources: suppliers as authors, even customers as self-kept records (some still students in them), every third part as a registry's profile, every seventh order as a line of a staff page that shortens the first name."""
    k, place = F.col("k"), (F.col("k") % 5).cast("string").alias("place")
    full = F.concat(F.lit("Ann "), _name("k"))
    years = F.when(k % 3 != 0, F.sequence(F.lit(AS_OF - 6), F.lit(AS_OF)))
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).select(place, k.alias("seq"), F.lit("openalex").alias("source"), full.alias("name"), F.when(k % 2 == 0, k.cast("string")).alias("orcid"), F.concat(F.lit("a"), k).alias("author_id"), F.lit(40).alias("works"), F.lit(10).alias("h_index"), F.lit(1990).alias("first_year"), F.lit(AS_OF).alias("last_year"), years.alias("years_here"))
    o = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").withColumn("k", F.col("c_custkey").cast("long"))
    o = o.select(place, (k + (1 << 40)).alias("seq"), F.lit("orcid").alias("source"), full.alias("name"), k.cast("string").alias("orcid"), F.when(F.col("c_mktsegment") == "BUILDING", "Professor").when(F.col("c_mktsegment") == "HOUSEHOLD", "PhD Student").alias("title"), F.when(F.col("c_nationkey") % 3 == 0, "Dept of Chemistry").when(F.col("c_nationkey") % 3 == 1, "Civil Engg").alias("department"))
    r = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").withColumn("k", F.col("p_partkey").cast("long"))
    r = r.select(place, (k + (2 << 40)).alias("seq"), F.lit("registry").alias("source"), full.alias("name"), _of(TITLES, "p_type").alias("title"), _of(DEPARTMENTS, "p_type").alias("department"))
    p = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").withColumn("k", F.col("o_orderkey").cast("long"))
    p = p.select(place, (k + (3 << 40)).alias("seq"), F.lit("faculty_page").alias("source"), F.concat(F.lit("Dr. A. "), _name("k")).alias("name"), F.lit("professor").alias("role"), F.lit("Chemistry").alias("department"))
    return runs.sightings(a).unionByName(runs.sightings(o)).unionByName(runs.sightings(r)).unionByName(runs.sightings(p))


def _members(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(k.alias("member_id"), (k % 5).cast("string").alias("place"), F.concat(F.lit("Ann "), _name("s_suppkey")).alias("name"), none.alias("orcid"), none.alias("author_id"), none.alias("email"))


def _persons(spark, sf_dir) -> DataFrame:
    """Own records of every fourth customer: a keyword on corrosion, an address and a site."""
    k = F.col("c_custkey").cast("string")
    site = F.array(F.struct(F.lit("home").alias("name"), F.lit("https://x").alias("url")))
    return table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(k.alias("orcid"), F.array(F.lit("pitting corrosion")).alias("keywords"), F.array(F.concat(F.lit("p"), k, F.lit("@x"))).alias("emails"), site.alias("urls"))


_KEPT = "('chemistry', 'materials', 'energy', 'biochemical_engineering')"
_RANK = "CASE {} WHEN 'excluded' THEN 6 WHEN 'professor' THEN 5 WHEN 'scientist' THEN 4 WHEN 'officer' THEN 3 WHEN 'fellow' THEN 3 ELSE 0 END"
_ALL = f"""WITH o AS (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'professor' WHEN 'HOUSEHOLD' THEN 'excluded' ELSE 'unknown' END AS role, CASE c_nationkey % 3 WHEN 0 THEN 'chemistry' WHEN 1 THEN 'civil' END AS domain FROM customer WHERE c_custkey % 2 = 0),
h AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 = 0),
r AS (SELECT p_partkey AS k, coalesce({_sql(ROLES, "p_type")}, 'unknown') AS role, {_sql(DOMAINS, "p_type")} AS domain FROM part WHERE p_partkey % 3 = 0),
p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0),
k AS (SELECT s_suppkey AS k FROM supplier UNION SELECT k FROM o UNION SELECT k FROM r UNION SELECT k FROM p),
j AS (SELECT k.k, s.s_suppkey IS NOT NULL AND k.k % 3 <> 0 AS senior, s.s_suppkey IS NOT NULL AND k.k % 4 = 0 AS known, coalesce(o.domain, r.domain, CASE WHEN p.k IS NOT NULL THEN 'chemistry' END, 'other') AS domain,
  CASE WHEN o.role = 'excluded' AND p.k IS NULL AND coalesce({_RANK.format("r.role")}, 0) NOT IN (3, 4, 5) THEN CASE WHEN s.s_suppkey IS NOT NULL AND k.k % 3 <> 0 THEN 2 ELSE 6 END
    ELSE greatest(CASE WHEN o.role = 'excluded' THEN 0 ELSE {_RANK.format("o.role")} END, CASE WHEN r.role = 'excluded' AND o.role = 'excluded' AND p.k IS NOT NULL THEN 0 ELSE {_RANK.format("r.role")} END, CASE WHEN p.k IS NOT NULL THEN 5 ELSE 0 END) END AS rank,
  o.k IS NOT NULL AND h.k IS NOT NULL AS told
  FROM k LEFT JOIN supplier s ON s.s_suppkey = k.k LEFT JOIN o ON o.k = k.k LEFT JOIN r ON r.k = k.k LEFT JOIN p ON p.k = k.k LEFT JOIN h ON h.k = k.k),
d AS (SELECT k, CASE WHEN rank = 6 THEN 'excludedRole' WHEN rank = 0 AND NOT senior THEN 'droppedUnconfirmed' WHEN domain NOT IN {_KEPT} AND NOT (told AND domain IN ('civil', 'mechanical')) THEN 'excludedDomain' WHEN known THEN 'updated' ELSE 'created' END AS outcome, domain FROM j)"""


@query(_ALL + " SELECT CAST(k % 5 AS VARCHAR) AS place, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS \"{o}\"" for o in runs.OUTCOMES) + " FROM d GROUP BY 1")
def roster_build(spark, sf_dir):
    """A roster from four sources: sightings to drafts, drafts to decisions, decisions to outcomes, counted for each institution."""
    return runs.outcome_counts(runs.build(_seen(spark, sf_dir), _members(spark, sf_dir), AS_OF, SOURCES, persons=_persons(spark, sf_dir)), "place")


@query(_ALL + """ SELECT d.k AS draft, outcome, d.domain, array_to_string(list_filter([CASE WHEN p.k IS NOT NULL THEN 'faculty_page' END, CASE WHEN s_suppkey IS NOT NULL THEN 'openalex' END, CASE WHEN o.k IS NOT NULL THEN 'orcid' END, CASE WHEN r.k IS NOT NULL THEN 'registry' END], lambda x: x IS NOT NULL), ',') AS sources
FROM d LEFT JOIN supplier ON s_suppkey = d.k LEFT JOIN o ON o.k = d.k LEFT JOIN r ON r.k = d.k LEFT JOIN p ON p.k = d.k""")
def roster_drafts(spark, sf_dir):
    """Each person of a build with the sources that saw them, their domain and what became of them."""
    rows = runs.build(_seen(spark, sf_dir), _members(spark, sf_dir), AS_OF, SOURCES, persons=_persons(spark, sf_dir))
    return rows.select((F.col("draft") % (1 << 40)).alias("draft"), "outcome", F.col("domain.domain").alias("domain"), F.array_join("sources", ",").alias("sources"))


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE n_name END AS place, c_mktsegment, {_sql(DOMAINS, "(['ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'])[c_custkey % 6 + 1]")} AS domain FROM customer JOIN nation ON n_nationkey = c_nationkey),
o AS (SELECT place, CASE WHEN place IS NULL THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'excludedRole' WHEN domain NOT IN {_KEPT} AND (s_suppkey IS NULL OR s_suppkey % 11 <> 0) THEN 'excludedDomain' WHEN s_suppkey % 4 = 0 THEN 'updated' ELSE 'created' END AS outcome FROM c LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT coalesce(place, '(unknown)') AS place, count(*) AS n, """ + ", ".join(f"count(*) FILTER (outcome = '{x}') AS \"{x}\"" for x in runs.OUTCOMES) + " FROM o GROUP BY 1")
def roster_import(spark, sf_dir):
    """A list of staff under a build's decisions: institutions by short and full names, rows of unknown ones told apart, people without a title taken for staff, known members found by their e-mail, some people kept whatever their department."""
    nations = table(spark, sf_dir, "nation")
    places = nations.select(F.col("n_name").alias("place"), F.concat(F.lit("Indian Institute of Technology "), _name("n_nationkey")).alias("institution"))
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("IIT "), _name("n_nationkey"))).when(k % 3 == 1, F.concat(F.lit("Indian Institute of Technology, "), _name("n_nationkey"))).otherwise(F.concat(F.lit("Zorb "), k))
    none = F.lit(None).cast("string")
    kinds = F.element_at(F.array(*map(F.lit, DEPARTMENTS)), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("kind", kinds)
    rows = rows.select(k.cast("long").alias("row_id"), F.concat(F.lit("Ann "), _name("c_custkey")).alias("name"), name.alias("institution"), F.when(F.col("c_mktsegment") == "MACHINERY", "PhD student").alias("title"), _of(DEPARTMENTS, "kind").alias("department"), F.concat(F.lit("a@x"), k).alias("email"), *(none.alias(c) for c in ("orcid", "profile_url", "keywords", "phone", "website", "bio")))
    s, own = F.col("s_suppkey"), F.concat(F.lit("Ann "), _name("s_suppkey"))
    supplier = table(spark, sf_dir, "supplier")
    members = supplier.where(s % 4 == 0).select(s.cast("long").alias("member_id"), F.lit("elsewhere").alias("place"), own.alias("name"), none.alias("orcid"), none.alias("author_id"), F.concat(F.lit("A@x"), s).alias("email"))
    pinned = supplier.where((s % 11 == 0) | (s % 13 == 0)).select(none.alias("orcid"), none.alias("author_id"), own.alias("name"), F.when(s % 11 != 0, "Institute of Nowhere").alias("institution"))
    outcomes, unknown = runs.imported(rows, places, members, pinned)
    counted = outcomes.groupBy("place").agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in runs.OUTCOMES))
    return counted.unionByName(unknown.agg(F.count("*").alias("n")).select(F.lit("(unknown)").alias("place"), "n", *(F.lit(0).cast("long").alias(o) for o in runs.OUTCOMES)))


@query("""WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'old' || c_custkey END AS email, [c_mktsegment] AS topics, c_custkey % 4 AS h FROM customer WHERE c_custkey % 2 = 0),
c AS (SELECT c_custkey AS id, 'new' || c_custkey AS email, [c_mktsegment, CAST(c_nationkey AS VARCHAR)] AS topics, c_custkey % 8 AS h FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(l.id, c.id) AS id, CASE WHEN l.id IS NULL THEN 'created' WHEN c.id IS NULL THEN 'kept' WHEN l.h = c.h THEN 'unchanged' ELSE 'refreshed' END AS change, CASE WHEN l.h = c.h THEN l.email ELSE coalesce(l.email, c.email) END AS email,
  array_to_string(CASE WHEN l.id IS NULL THEN c.topics WHEN c.id IS NULL OR l.h = c.h THEN l.topics ELSE c.topics END, ',') AS topics FROM l FULL JOIN c ON l.id = c.id""")
def lead_refresh(spark, sf_dir):
    """Known leads after a run: what is missing is filled, what is there stays, unchanged material is left alone, lists grow without repeats."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    leads = rows.where(k % 2 == 0).select(k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("old"), k)).alias("email"), F.array("c_mktsegment").alias("topics"), (k % 4).cast("string").alias("content_hash"), F.lit(True).alias("scored"))
    found = rows.where(k % 5 != 0).select(k.alias("id"), F.concat(F.lit("new"), k).alias("email"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("topics"), (k % 8).cast("string").alias("content_hash"))
    return runs.refreshed(leads, found, "id", ["email"], {"topics": 10}).select("id", "change", "email", F.array_join("topics", ",").alias("topics"))


_MEMBERS = """WITH i AS (SELECT o_custkey, array_agg(DISTINCT o_orderstatus) AS brands FROM orders GROUP BY 1),
m AS (SELECT c_custkey AS id, c_mktsegment AS domain, c_nationkey AS institution_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'e' END AS email, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS score, coalesce(brands, []) AS brands,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'current' ELSE 'moved' END AS affiliation, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 < 4 THEN true ELSE false END AS outside, ['t' || (c_custkey % 5)] AS tags FROM customer LEFT JOIN i ON o_custkey = c_custkey)"""
ASKED = [
    dict(domain="BUILDING,MACHINERY", brand="O", has_email="yes", min_score=0), dict(brand="none", outside_target="no"), dict(affiliation="unverified", tag="t1,t2", scored="no"), dict(affiliation="current", max_score=5000, vendor="vF"),
    dict(brand="any", missing="email", outside_target="yes", institution=["3", "4"]),
]
_WHERE = [
    "domain IN ('BUILDING', 'MACHINERY') AND list_contains(brands, 'O') AND email IS NOT NULL AND score >= 0", "len(brands) = 0 AND outside IS DISTINCT FROM true", "affiliation IS NULL AND tags[1] IN ('t1', 't2') AND score IS NULL",
    "affiliation = 'current' AND score <= 5000 AND list_contains(brands, 'F')", "len(brands) > 0 AND email IS NULL AND outside AND institution_id IN (3, 4)",
]


@query(_MEMBERS + " " + " UNION ALL ".join(f"SELECT {n} AS list, count(*) AS n, min(id) AS first, max(id) AS last FROM m WHERE {w}" for n, w in enumerate(_WHERE)))
def roster_lists(spark, sf_dir):
    """Five lists of members by named filters, each counted."""
    k = F.col("c_custkey")
    brands = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_set("o_orderstatus")), lambda b: F.struct(b.alias("brand"), F.concat(F.lit("v"), b).alias("vendor"))).alias("instruments"))
    none = F.array().cast("array<struct<brand:string,vendor:string>>")
    m = table(spark, sf_dir, "customer").join(brands, "c_custkey", "left").select(
        k.alias("id"), F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").cast("string").alias("institution_id"), F.when(k % 4 != 0, "e").alias("email"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("score"), F.coalesce("instruments", none).alias("instruments"),
        F.when(k % 3 == 1, "current").when(k % 3 == 2, "moved").alias("affiliation"), F.when(k % 7 != 0, k % 7 < 4).alias("outside_target"), F.array(F.concat(F.lit("t"), k % 5)).alias("tags"),
    )
    out = m.agg(*(F.struct(F.lit(n).alias("list"), F.count_if(on).alias("n"), F.min(F.when(on, k_)).alias("first"), F.max(F.when(on, k_)).alias("last")).alias(f"l{n}") for n, on, k_ in ((n, lists.roster_filter(**a), F.col("id")) for n, a in enumerate(ASKED))))
    return out.select(F.explode(F.array(*(f"l{n}" for n in range(len(ASKED)))))).select("col.*")


@query(_MEMBERS + """, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS k FROM m WHERE domain = 'BUILDING') SELECT id, score FROM r WHERE k BETWEEN 21 AND 30""")
def roster_page(spark, sf_dir):
    """The third page of ten of a filtered list, the best scores first."""
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(k.alias("id"), F.lpad(k.cast("string"), 12, "0").alias("name"), F.col("c_mktsegment").alias("domain"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("score"))
    return lists.roster_page(m, 3, 10, domain="BUILDING", tiebreak="id").select("id", "score")


@query("""WITH w AS (SELECT o_orderkey, unnest(['ring', 'bolt', 'red', o_orderstatus || 'ring', CASE WHEN o_orderkey % 3 = 0 THEN 'widget' ELSE 'blue' END]) AS t FROM orders),
p AS (SELECT DISTINCT p_brand AS product, unnest(string_split(p_name, ' ')) AS t FROM part), h AS (SELECT o_orderkey, product, count(DISTINCT t) AS hits FROM w JOIN p USING (t) WHERE length(t) >= 4 GROUP BY ALL)
SELECT o_orderkey, product, hits FROM h QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY hits DESC, product) <= 3""")
def candidate_products(spark, sf_dir):
    """For each candidate the three products that share most terms with its words."""
    k = F.col("o_orderkey")
    texts = table(spark, sf_dir, "orders").select(k, F.array(F.lit("ring"), F.lit("bolt"), F.lit("red"), F.concat("o_orderstatus", F.lit("ring")), F.when(k % 3 == 0, "widget").otherwise("blue")).alias("words"))
    return lists.best_products(texts, "o_orderkey", F.col("words"), table(spark, sf_dir, "part"), "p_brand", F.split("p_name", " ")).select("o_orderkey", F.col("p_brand").alias("product"), "hits")


@query("""WITH a AS (SELECT s_nationkey AS n, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS author_id FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT c_custkey, author_id FROM customer LEFT JOIN a ON n = c_nationkey""")
def best_author(spark, sf_dir):
    """The author with the most works of a place; one without works is none."""
    authors = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("place"), F.col("s_suppkey").alias("author_id"), F.col("s_acctbal").alias("works"), F.array("s_name").alias("topics"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("place"))
    return lists.best_author(asked, authors, ["place"]).select("c_custkey", "author_id")


@query("""SELECT c_custkey, s_suppkey AS author_id, k AS place FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) ON s_nationkey = c_nationkey WHERE k <= 5""")
def author_candidates(spark, sf_dir):
    """Up to five authors of a name for each question, the most productive first."""
    authors = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("author_id"), F.col("s_acctbal").alias("works"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return lists.author_candidates(asked, authors, ["key"]).select("c_custkey", "author_id", F.col("rank").cast("long").alias("place"))


@query("""WITH s AS (SELECT *, CASE WHEN c_nationkey % 4 = 0 THEN 'current' WHEN c_nationkey % 4 = 1 THEN 'moved' WHEN c_nationkey % 4 = 2 THEN 'unknown' END AS status FROM customer)
SELECT count(*) AS checked, count(*) FILTER (status = 'current') AS current, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status IS NULL) AS unverified, count(*) FILTER (status = 'moved' AND c_custkey % 3 <> 0) AS outside FROM s""")
def roster_verify(spark, sf_dir):
    """How a verification of members ends, with those who moved outside the targets."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    assessed = F.struct(F.when(n % 4 == 0, "current").when(n % 4 == 1, "moved").when(n % 4 == 2, "unknown").alias("status"), F.lit("x").alias("name"), (k % 3).cast("string").alias("id"))
    return runs.verify_counts(runs.verified(table(spark, sf_dir, "customer"), assessed, spark.createDataFrame([("0",)], "target_id string")))


@query("""SELECT kind, count(c_custkey) AS n FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'SPACE']) AS kind) LEFT JOIN customer ON c_mktsegment = kind GROUP BY kind""")
def counts_by_kind(spark, sf_dir):
    """Counts of the asked kinds, none left out."""
    return lists.counts_by_kind(table(spark, sf_dir, "customer"), ["BUILDING", "MACHINERY", "SPACE"], "c_mktsegment")


@query("""WITH x AS (SELECT l_suppkey, l_returnflag AS brand, CASE WHEN l_linestatus = 'F' THEN 'm' || l_linenumber END AS model FROM lineitem)
SELECT l_suppkey, string_agg(b, ';' ORDER BY b) AS models FROM (SELECT l_suppkey, brand || ':' || coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS b FROM x GROUP BY l_suppkey, brand) GROUP BY l_suppkey""")
def models_by_brand(spark, sf_dir):
    """Instruments of a record by brand, each with its distinct models."""
    item = F.struct(F.col("l_returnflag").alias("brand"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("m"), "l_linenumber")).alias("model"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(item)).alias("x"))
    shown = F.transform(lists.models_by_brand(F.col("x")), lambda b: F.concat(b["brand"], F.lit(":"), F.array_join(b["models"], ",")))
    return rows.select("l_suppkey", F.array_join(shown, ";").alias("models"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'email' END, CASE WHEN c_custkey % 3 = 0 THEN 'title' END, CASE WHEN c_custkey % 5 < 2 THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer""")
def missing_fields(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 2 != 0, "e").alias("e"), F.when(k % 3 != 0, "t").otherwise(" ").alias("t"), F.when(k % 5 >= 2, "p").when(k % 5 == 1, "").alias("p"))
    return rows.select("c_custkey", F.array_join(lists.missing_fields({"email": "e", "title": "t", "phone": "p"}), ",").alias("missing"))


_I = "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS b FROM orders GROUP BY 1"


@query(f"""WITH i AS ({_I}), l AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, coalesce(b, []) AS b FROM customer LEFT JOIN i ON o_custkey = c_custkey)
SELECT name || ',"Head, ""of"" ' || seg || '",' || CASE WHEN k % 2 = 0 THEN '''=x@y' ELSE '' END || ',,,Inst ' || k % 7 || ',' || CASE k % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'current (not in directory)' WHEN 2 THEN 'current' ELSE 'moved' END || ','
  || CASE WHEN k % 4 = 3 THEN 'Old' ELSE '' END || ',' || CASE WHEN k % 4 = 0 THEN '' ELSE 'registry' END || ',' || CASE WHEN k % 4 = 0 THEN '' ELSE '2024-01-02T03:04:05.000Z' END || ',,IN,new,' || array_to_string(b, '; ') || ','
  || trim(array_to_string(list_transform(b, lambda x: CASE WHEN x = 'F' THEN 'm1 / m2' ELSE '' END), '; ')) || ',' || CASE WHEN list_contains(b, 'O') THEN 'yes' ELSE 'no' END || ',' || CASE WHEN list_contains(b, 'F') THEN 'yes' ELSE 'no' END || ',p1; p2,' || seg || ',a b,t1; t2,,'
  || CASE WHEN k % 3 = 0 THEN '0000' ELSE '' END || ',papers,,,2024-01-02T03:04:05.000Z,,,t' || k % 5 AS line FROM l""")
def lead_export(spark, sf_dir):
    """The export of leads, all thirty columns: aligned brands and models, affiliation in words, dates, quotes, no formulas."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    item = lambda b, model, vendor: F.struct(b.alias("brand"), model.cast("string").alias("model"), vendor.cast("string").alias("vendor"))
    both = lambda b: F.when(b == "F", F.array(*(item(b, F.lit(m), F.lit("competitor")) for m in ("m1", "m2", "m1")))).otherwise(F.array(item(b, none, F.when(b == "O", "own"))))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.flatten(F.transform(F.array_sort(F.collect_set("o_orderstatus")), both)).alias("instruments"))
    status = F.struct(F.when(k % 4 == 3, "moved").otherwise("current").alias("status"), (k % 4 == 2).alias("directory_listed"), F.when(k % 4 == 3, "Old").alias("previous"), F.lit("registry").alias("source"), at.alias("verified_at"))
    rows = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left")
    rows = rows.select(
        F.col("c_name").alias("name"), F.concat(F.lit('Head, "of" '), "c_mktsegment").alias("title"), F.when(k % 2 == 0, "=x@y").alias("email"), *(none.alias(c) for c in ("phone", "website", "department", "profile_url", "source_url", "reviewed_by")),
        F.concat(F.lit("Inst "), k % 7).alias("institution"), F.when(k % 4 != 0, status).alias("affiliation"), F.lit("IN").alias("country"), F.lit("new").alias("status"), F.coalesce("instruments", F.array().cast("array<struct<brand:string,model:string,vendor:string>>")).alias("instruments"),
        F.array(F.lit("p1"), F.lit("p2")).alias("products"), F.array("c_mktsegment").alias("topics"), F.lit("a\r\n b").alias("summary"), F.array(F.lit("t1"), F.lit("t2"), F.lit("t1")).alias("publications"), F.when(k % 3 == 0, "0000").alias("orcid"), F.lit("papers").alias("source"),
        F.lit(None).cast("timestamp").alias("discovered_at"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.array(F.concat(F.lit("t"), k % 5)).alias("tags"),
    )
    return reports.flat_export(rows, reports.lead_columns())
