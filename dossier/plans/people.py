"""Captured records, decisions about people and whole runs over the given tables: orders stand for papers and jobs, their lines for authorships and sightings,
suppliers for authors, customers for members, parts for departments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import rules, text
from dossier.operators import affiliation, identity, roster, store
from dossier.plans.queries import query, table
from dossier.sources import html, records

TARGETS = [1, 5, 9]
AS_OF = 2002


def _by(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


# Captured records


def _works(spark, sf_dir) -> DataFrame:
    """Papers: an order with its lines as authorships in the order of their numbers."""
    place = F.struct(F.concat(F.lit("https://x.org/"), F.col("s_nationkey").cast("string")).alias("id"), F.col("n_name").alias("display_name"), F.lit("XX").alias("country_code"))
    person = F.struct(F.col("l_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name"), F.lit(None).cast("string").alias("orcid"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", person.alias("author"), (F.col("l_returnflag") == "R").alias("is_corresponding"), F.array(place).alias("institutions"), F.array().cast("array<string>").alias("raw_affiliation_strings"))
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("authorships"))
    none = F.lit(None).cast("map<string,array<int>>")
    orders = table(spark, sf_dir, "orders").join(own, "o_orderkey")
    topic = F.array(F.struct(F.col("o_orderpriority").alias("display_name")))
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("doi"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").alias("publication_year"), topic.alias("topics"), none.alias("abstract_inverted_index"), "authorships")


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, s_name, n_name, s_nationkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  CASE WHEN l_returnflag = 'R' AND s_nationkey IN (1, 5, 9) THEN 0 WHEN s_nationkey IN (1, 5, 9) THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT CAST(o_orderkey AS VARCHAR) AS work, CAST(l_suppkey AS VARCHAR) AS source_record_id, s_name AS name, n_name AS institution_name, CAST(s_nationkey AS VARCHAR) AS institution_id, o_orderstatus AS evidence_text, CAST(year(o_orderdate) AS INTEGER) AS year
FROM a JOIN orders ON o_orderkey = l_orderkey WHERE k = 1""")
def work_candidates(spark, sf_dir):
    """The author that stands for each paper, with the place and the paper."""
    rows = records.work_candidates(_works(spark, sf_dir), [str(t) for t in TARGETS])
    return rows.select(F.col("publications")[0]["source_id"].alias("work"), "source_record_id", "name", "institution_name", "institution_id", "evidence_text", F.col("publications")[0]["year"].alias("year"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS work, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (1, 5, 9) GROUP BY l_orderkey""")
def work_target_authors(spark, sf_dir):
    """All authors at a target, counted for each paper."""
    rows = records.work_candidates(_works(spark, sf_dir), [str(t) for t in TARGETS], every=True)
    return rows.groupBy(F.col("publications")[0]["source_id"].alias("work")).agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT year(l_shipdate)) FILTER (l_returnflag = 'R'), 'DESC'), ',') AS years_here, CAST(min(year(l_shipdate)) AS INTEGER) AS first_year, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year FROM lineitem GROUP BY l_suppkey""")
def author_history(spark, sf_dir):
    """An author's years at a place, first and last year anywhere."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("id")).agg(F.collect_set(F.year("l_shipdate")).alias("years"))
    rows = per.groupBy("l_suppkey").agg(F.collect_list(F.struct("id", "years")).alias("affiliations"))
    return rows.select("l_suppkey", records.author_record(F.col("affiliations"), F.lit("R")).alias("x")).select("l_suppkey", F.array_join(F.transform("x.years_here", lambda y: y.cast("string")), ",").alias("years_here"), "x.first_year", "x.last_year")


@query("""WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS seen FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, seen, p_brand) AS k FROM c)
SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY k) AS topics FROM r WHERE k <= 10 GROUP BY l_suppkey""")
def topic_profile(spark, sf_dir):
    """The ten most frequent topics of an author, the first seen among equals."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.array("p_brand").alias("topics"))
    return records.topic_profile(rows, "l_suppkey", "topics", "seq").select("l_suppkey", F.array_join("topics", ",").alias("topics"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS k FROM orders WHERE year(o_orderdate) >= 1996)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS titles FROM r WHERE k <= 25 GROUP BY o_custkey""")
def recent_papers(spark, sf_dir):
    """The newest 25 papers of an author since a year."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("title"))
    return records.recent_papers(rows, "o_custkey", "o_orderkey", F.lit(1996), "year", "title").select("o_custkey", F.array_join("titles", ",").alias("titles"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '5-LOW')::INT, year(o_orderdate) DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, o_orderkey AS job FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1""")
def employment_here(spark, sf_dir):
    """The open job at a place: with a role first, then the newest; places are the same under abbreviations."""
    name = F.when(F.col("o_orderkey") % 2 == 0, "IIT North").otherwise("Indian Institute of Technology, North")
    job = F.struct(F.col("o_orderkey").alias("key"), F.lit(None).cast("string").alias("org_id"), name.alias("organization"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("role"), F.year("o_orderdate").alias("start_year"), (F.col("o_orderstatus") == "O").alias("current"))
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    found = records.employment_here(F.col("jobs"), F.lit("r1"), F.lit("Indian Institute of Technology North"))
    return table(spark, sf_dir, "customer").join(jobs, "c_custkey", "left").select("c_custkey", found["key"].alias("job"))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, s_name, n_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus <> 'F')::INT, l_linenumber, l_suppkey, l_linestatus = 'F') AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT CAST(l_suppkey AS VARCHAR) AS source_record_id, upper(left(s_name, 1)) || lower(substring(s_name, 2)) AS name, CAST(o_orderkey AS VARCHAR) AS source_id, o_totalprice AS amount, CAST(year(o_orderdate) AS INTEGER) AS year FROM r JOIN orders ON o_orderkey = l_orderkey WHERE k = 1""")
def project_grants(spark, sf_dir):
    """Funded projects: the contact investigator, else the first."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    one = F.struct("l_linenumber", "l_suppkey", F.col("l_suppkey").alias("profile_id"), F.upper("s_name").alias("full_name"), (F.col("l_linestatus") == "F").alias("is_contact"))
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("investigators"))
    rows = table(spark, sf_dir, "orders").join(own, "o_orderkey")
    rows = rows.select("investigators", F.lit(None).cast("string").alias("organization"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("amount"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderkey").alias("number"), F.lit(None).cast("string").alias("abstract"))
    return records.project_grants(rows).select("source_record_id", "name", "grant.source_id", "grant.amount", "grant.year")


@query("""SELECT lower(regexp_replace(c_name, '\\s+', '-', 'g')) AS source_record_id, CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(trunc(o_totalprice) AS DOUBLE) END AS amount, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON c_custkey = o_custkey""")
def award_grants(spark, sf_dir):
    """Awards whose amounts and dates are text."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" USD")))
    rows = rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("first_name"), F.lit("").alias("last_name"), F.lit(None).cast("string").alias("email"), F.col("c_mktsegment").alias("awardee"), F.lit("t").alias("title"), amount.alias("amount"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("start"), F.lit(None).cast("string").alias("abstract"))
    return records.award_grants(rows).select("source_record_id", "grant.source_id", "grant.amount", "grant.year")


# Domains, names, decisions

FIELDS = {"ECONOMY": "Chemistry", "SMALL": "Department of Physics", "MEDIUM": "Civil Engineering", "PROMO": "Mechanical Engineering", "STANDARD": "Interdisciplinary Studies", "LARGE": ""}
WORK = {"bolt": "Pitting and corrosion", "widget": "Battery electrodes", "ring": "bridge dynamics", "gear": "Voltammetry", "plate": "poetry"}


def _decided(part: DataFrame) -> DataFrame:
    topics = F.array(
        F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("count"), F.lit("Electrochemistry").alias("subfield"), F.lit(None).cast("string").alias("field")),
        F.struct(F.lit("x").alias("name"), F.lit(20).cast("long").alias("count"), F.lit(None).cast("string").alias("subfield"), F.lit("Nuclear and High Energy Physics").alias("field")),
    )
    own = F.when(F.col("p_size") % 2 == 0, topics).otherwise(F.slice(topics, 2, 1))
    return rules.with_domain(part, _by(FIELDS, F.col("p_type")), own, _by(WORK, F.split("p_name", " ")[1]), "x")


_WORDS = "string_split(p_name, ' ')[2]"
_DOMAIN = f"""CASE WHEN p_type = 'ECONOMY' THEN 'chemistry' WHEN p_type = 'SMALL' THEN 'other' WHEN p_type = 'MEDIUM' THEN 'civil' WHEN p_type = 'PROMO' THEN 'mechanical' WHEN p_size % 2 = 0 AND p_size >= 0.4 * (p_size + 20) THEN 'chemistry' ELSE 'other' END"""
_GATE = f"""CASE WHEN domain IN ('civil', 'mechanical') AND {_WORDS} = 'bolt' THEN 'corrosion' WHEN domain = 'other' AND ({_WORDS} IN ('widget', 'gear') OR p_size % 2 = 0 AND p_size >= 3) THEN 'electrochemistry' END"""
_DECIDED = f"SELECT *, domain = 'chemistry' OR gate IS NOT NULL AS kept FROM (SELECT *, {_GATE} AS gate FROM (SELECT *, {_DOMAIN} AS domain FROM part))"


@query(f"SELECT p_partkey, domain, coalesce(gate, '') AS gate, kept FROM ({_DECIDED})")
def domain_decision(spark, sf_dir):
    """Departments, topics and gates: who belongs to the kept fields."""
    return _decided(table(spark, sf_dir, "part")).select("p_partkey", "x.domain", F.coalesce("x.gate", F.lit("")).alias("gate"), "x.kept")


ROLES = {"Brand#1": "professor", "Brand#2": "excluded", "Brand#3": "unknown", "Brand#4": "fellow", "Brand#5": "officer"}


@query(f"""WITH d AS (SELECT *, coalesce({_case(ROLES, 'p_brand')}, 'unknown') AS own, p_size >= 25 AS senior, p_size % 10 = 0 AS pinned FROM ({_DECIDED})),
r AS (SELECT *, CASE WHEN senior AND NOT pinned AND own = 'unknown' THEN 'inferred' WHEN pinned AND own = 'unknown' THEN 'professor' ELSE own END AS role FROM d)
SELECT p_partkey, role, CASE WHEN role = 'excluded' THEN 'excludedRole' WHEN role = 'unknown' THEN 'droppedUnconfirmed' WHEN pinned OR kept THEN 'kept' ELSE 'excludedDomain' END AS outcome FROM r""")
def roster_decision(spark, sf_dir):
    """What becomes of a draft: by its role, the publication record, the list of pinned ones and its domain."""
    part = table(spark, sf_dir, "part").select("*", F.coalesce(_by(ROLES, F.col("p_brand")), F.lit("unknown")).alias("own"))
    found = _decided(part).select("p_partkey", roster.decision(F.col("own"), F.col("p_size") >= 25, F.col("x"), F.col("p_size") % 10 == 0).alias("x"))
    return found.select("p_partkey", "x.role", "x.outcome")


@query("""WITH d AS (SELECT p_partkey + 5 AS p_partkey, p_name, p_brand, p_size FROM part)
SELECT coalesce(m.p_partkey, d.p_partkey) AS p_partkey, coalesce(CASE WHEN m.p_size % 2 = 0 THEN m.p_name END, d.p_name) AS title, greatest(m.p_size, d.p_size) AS works,
  array_to_string(CASE WHEN m.p_brand = d.p_brand THEN [m.p_brand] ELSE list_filter([m.p_brand, d.p_brand], lambda x: x IS NOT NULL) END, ',') AS topics,
  CASE WHEN m.p_partkey IS NULL THEN 'eligible' WHEN m.p_type = 'SMALL' AND d.p_partkey IS NOT NULL THEN 'eligible' WHEN m.p_type = 'SMALL' THEN 'excluded' WHEN m.p_type = 'LARGE' THEN 'promoted' ELSE 'eligible' END AS status,
  CASE WHEN m.p_partkey IS NULL THEN 'created' WHEN d.p_partkey IS NULL THEN 'kept' ELSE 'updated' END AS change FROM part m FULL JOIN d ON d.p_partkey = m.p_partkey""")
def member_upsert(spark, sf_dir):
    """Drafts fill members' blanks, raise counts, add topics, and never touch a promoted one's status."""
    part = table(spark, sf_dir, "part")
    status = F.when(F.col("p_type") == "SMALL", "excluded").when(F.col("p_type") == "LARGE", "promoted").otherwise("eligible")
    members = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.col("p_size").alias("works"), F.array("p_brand").alias("topics"), status.alias("status"))
    drafts = part.select((F.col("p_partkey") + 5).alias("p_partkey"), F.col("p_name").alias("title"), F.col("p_size").alias("works"), F.array("p_brand").alias("topics"))
    out = roster.merge_members(members, drafts, "p_partkey", ["title"], ["works"], {"topics": 20})
    return out.withColumn("topics", F.array_join("topics", ","))


@query("""WITH l AS (SELECT s_nationkey, CAST(floor(s_acctbal / 100) AS BIGINT) AS b, min(s_suppkey) AS lead FROM supplier GROUP BY ALL),
m AS (SELECT *, CAST(floor(c_acctbal / 100) AS BIGINT) AS b, c_acctbal < 4000 AS below, c_mktsegment = 'BUILDING' AS owner FROM customer WHERE c_nationkey <> 3)
SELECT c_custkey, CASE WHEN below AND NOT owner THEN 'belowThreshold' WHEN lead IS NOT NULL THEN 'alreadyInCrm' ELSE 'promoted' END AS outcome, below AND owner AS by_instrument, CASE WHEN NOT below OR owner THEN lead END AS lead_id FROM m LEFT JOIN l ON l.s_nationkey = m.c_nationkey AND l.b = m.b""")
def roster_promotion(spark, sf_dir):
    """Members that become leads: by score or by an instrument seen, if they aren't leads yet."""
    keys = [("place", [F.col("c_nationkey"), F.floor(F.col("c_acctbal") / 100)], [F.col("s_nationkey"), F.floor(F.col("s_acctbal") / 100)])]
    out = roster.promotion(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), keys, "s_suppkey", F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") != 3, 4000)
    return out.select("c_custkey", "outcome", "by_instrument", "lead_id")


@query("""WITH s AS (SELECT o_custkey, o_orderkey * 100 + l_linenumber AS seq, l_returnflag AS brand, CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS VARCHAR) END AS model FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
d AS (SELECT o_custkey, brand, model, min(seq) AS seq FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seq, brand, model) AS k FROM d WHERE model IS NOT NULL OR NOT EXISTS (SELECT 1 FROM d e WHERE e.o_custkey = d.o_custkey AND e.brand = d.brand AND e.model IS NOT NULL))
SELECT o_custkey AS c_custkey, string_agg(brand || coalesce(' ' || model, ''), ',' ORDER BY k) AS instruments FROM k WHERE k <= 12 GROUP BY o_custkey""")
def instrument_sweep(spark, sf_dir):
    """Sightings of instruments gathered for each member: distinct, a brand alone only without a model, 12 at most."""
    sighted = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # a sequence number alone doesn't tell repeated lines apart, so brand and model follow it
    rows = sighted.select("o_custkey", F.struct((F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("b"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string")).alias("m")).alias("seq"), F.col("l_returnflag").alias("brand"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string")).alias("model"))
    tagged, _ = roster.swept(table(spark, sf_dir, "customer"), rows, [("id", [F.col("o_custkey")], [F.col("c_custkey")])], "c_custkey", "seq", "brand", "model")
    return tagged.select("c_custkey", F.array_join(F.transform("instruments", lambda x: F.concat_ws(" ", x["brand"], x["model"])), ",").alias("instruments"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice >= 100000 THEN 'approved' ELSE o_orderstatus END AS status, o_orderstatus = 'O' AND o_totalprice >= 100000 AS reviewed FROM orders""")
def bulk_review(spark, sf_dir):
    """All that wait and score enough are approved at once; others stay as they are."""
    rows = table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    return roster.review(rows, "approved", F.col("o_totalprice") >= 100_000, pending="O").select("o_orderkey", "status", "reviewed")


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT p_partkey, a || '.' || b || '@x.org' AS email, a IN ('red', 'blue') AS same FROM w""")
def email_and_name_match(spark, sf_dir):
    """The address that is a person's own among general ones, and whether two spellings may be one person."""
    words = F.split("p_name", " ")
    own = F.concat(words[0], F.lit("."), words[1], F.lit("@X.org"))
    tokens = text.name_tokens(F.concat(F.lit("Dr. "), F.col("p_name")))
    other = text.name_tokens(F.concat(F.when(words[0] == "red", "R. ").when(words[0] == "blue", "Blue Q ").otherwise("zed "), words[1]))
    best = html.personal_email(F.array(F.lit("info@x.org"), F.concat(words[1], F.lit("department@x.org")), own), tokens)
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("email"), text.same_person(tokens, other).alias("same"))


# Whole runs


@query(r"""WITH c AS (SELECT lower(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS k, min(doc_id) AS doc_id, count(*) AS sightings FROM documents GROUP BY 1)
SELECT doc_id, sightings, CASE WHEN quality IS NOT NULL THEN 'refreshed' ELSE 'created' END AS outcome, len(regexp_extract_all(lower(text), 'licensed under')) AS hits FROM c JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def discovery_run(spark, sf_dir):
    """A run: candidates of one text are one, what is known is refreshed, the rest is new and is scored."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "))), 256).alias("k"))
    # texts stay where they are: the merge and the lookup move keys, and a text's own facts are worked out beside it
    facts = rows.select("doc_id", "k", text.occurrences(F.lower("text"), "licensed under").cast("long").alias("hits"))
    one = identity.first_values(facts, "k", "doc_id", ["hits"])
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("known_id"))
    seen = identity.cascade(one, known, [("id", [F.col("doc_id")], [F.col("known_id")])], "known_id", "known", "via")
    return seen.select("doc_id", "sightings", F.when(F.col("known").isNotNull(), "refreshed").otherwise("created").alias("outcome"), "hits")


@query("""SELECT outcome, count(*) AS n, coalesce(max(c_acctbal) > 0, false) AS any_money FROM (SELECT *, CASE WHEN c_nationkey % 5 = 0 THEN 'current' WHEN c_nationkey % 3 = 0 THEN 'moved' WHEN c_acctbal > 0 THEN 'current' ELSE 'unknown' END AS outcome FROM customer) GROUP BY outcome""")
def verify_tally(spark, sf_dir):
    """How a verification ends, counted by outcome."""
    n, no = F.col("c_nationkey"), F.lit(False)
    found = affiliation.combined(n % 5 == 0, n % 3 == 0, no, F.col("c_acctbal") > 0, F.lit(True), no, F.lit("unknown"))
    rows = table(spark, sf_dir, "customer").select(found["status"].alias("outcome"), "c_acctbal")
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.max("c_acctbal") > 0, no).alias("any_money"))


@query("""SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42""")
def point_lookup(spark, sf_dir):
    """One record by its id; the filter reaches the scan."""
    return store.find(table(spark, sf_dir, "customer"), F.col("c_custkey") == 42, limit=1).select("c_custkey", "c_name", "c_nationkey")
