"""Searches of tables in tables: fuzzy lists, keys in keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import containment, institutions, paging, search
from dossier.plans.queries import query, table

#: The score of a query's word q against a term t; a and b are their trigrams.
_LADDER = """CASE WHEN t = q THEN 1.0 WHEN starts_with(t, q) THEN CASE WHEN length(q) >= 3 THEN 0.95 ELSE 0.7 END
  WHEN length(q) >= 4 AND length(t) >= 3 AND starts_with(q, t) THEN 0.6 WHEN length(q) >= 4 AND levenshtein(q, t) <= CASE WHEN length(q) >= 8 THEN 2 ELSE 1 END THEN 0.85
  WHEN length(q) >= 4 AND length(t) >= 4 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.45 THEN 0.5 + len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 0.4 ELSE 0 END"""
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda k: ('  ' || {0} || ' ')[k:k + 2]))"
_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9@.]+'), lambda t: t <> '')"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ') AS w, p_type FROM part WHERE p_partkey % 7 = 0),
asked AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN w[1][1:1] || ' ' || w[2][1:1] || w[2][3:] WHEN 1 THEN w[2] || 's ' || p_type[1:3] WHEN 2 THEN p_type[1:2] || p_type[4:] || 'ly' ELSE '00' || query_id || '@' END AS q FROM q),
each AS (SELECT DISTINCT q, {_WORDS.format("q")} AS qs FROM asked), qw AS (SELECT DISTINCT unnest(qs) AS q FROM each),
m AS (SELECT p_partkey, p_size, list_concat(list_transform({_WORDS.format("p_name")}, lambda x: {{'t': x, 'w': 1.0}}), list_transform({_WORDS.format("p_type || ' ' || p_brand")}, lambda x: {{'t': x, 'w': 0.9}})) AS ts FROM part),
mt AS (SELECT p_partkey, x.t AS t, max(x.w) AS w FROM (SELECT p_partkey, unnest(ts) AS x FROM m) GROUP BY ALL), v AS (SELECT DISTINCT t FROM mt),
f AS (SELECT q, t, {_LADDER} AS s FROM (SELECT q, {_GRAMS.format("q")} AS a FROM qw), (SELECT t, {_GRAMS.format("t")} AS b FROM v)),
b AS (SELECT e.q, p_partkey, f.q AS word, max(s * w) AS best FROM (SELECT q, unnest(qs) AS word FROM each) e JOIN f ON f.q = e.word AND s > 0 JOIN mt ON mt.t = f.t GROUP BY ALL HAVING max(s * w) >= 0.5),
s AS (SELECT q, p_partkey, avg(best) AS score FROM b JOIN each USING (q) GROUP BY q, p_partkey, qs HAVING count(*) = len(qs) AND avg(best) >= 0.6
  UNION ALL SELECT q, p_partkey, 1.0 FROM each JOIN part ON contains('0000' || p_partkey || '@x', q) AND length(q) >= 3),
u AS (SELECT q, p_partkey, max(score) AS score FROM s GROUP BY ALL),
r AS (SELECT q, p_partkey, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, p_size DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY q) AS total FROM u JOIN part USING (p_partkey))
SELECT query_id, p_partkey, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, total FROM r JOIN asked USING (q) WHERE rank BETWEEN 11 AND 20""")
def fuzzy_lists(spark, sf_dir):
    """The second page of ten for each of a table of queries: beginnings, lost and added letters, words of other fields, parts of an id; with score, rank and total."""
    part = table(spark, sf_dir, "part")
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    asked = F.when(k % 4 == 0, F.concat(F.substring(w[0], 1, 1), F.lit(" "), F.substring(w[1], 1, 1), F.substring(w[1], 3, 99))).when(k % 4 == 1, F.concat(w[1], F.lit("s "), F.substring("p_type", 1, 3)))
    asked = asked.when(k % 4 == 2, F.concat(F.substring("p_type", 1, 2), F.substring("p_type", 4, 99), F.lit("ly"))).otherwise(F.concat(F.lit("00"), k, F.lit("@")))
    people = part.withColumn("mail", F.concat(F.lit("0000"), k, F.lit("@x")))
    out = search.fuzzy_search(part.where(k % 7 == 0).select(k.alias("query_id"), asked.alias("q")), "query_id", "q", people, "p_partkey", "p_name", ["p_type", "p_brand"], ["mail"], ties=[F.desc("p_size")], page=2, limit=10)
    return out.withColumn("score", F.round("score", 6))


@query("""WITH k AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer), t AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS text FROM orders)
SELECT key, count(*) AS n, min(text) AS first, max(text) AS last FROM k JOIN t ON contains(text, key) GROUP BY key""")
def key_holders(spark, sf_dir):
    """Which order numbers hold the number of a customer, as text: counted, with the first and the last."""
    return containment.holder_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")), "k", table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("t")), "t")


@query("""WITH a AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS key FROM part), k AS (SELECT s_suppkey AS place, CASE s_suppkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_name || ' ' || p_type) ELSE lower(p_type || ' of ' || p_name || ' ' || p_type || ' ' || p_brand) END AS k FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT key, min(place) AS place FROM a JOIN k ON k = key OR contains(k, key) OR (contains(key, k) AND len(string_split(k, ' ')) >= 3) GROUP BY key""")
def first_place(spark, sf_dir):
    """The first place whose name holds the asked one, or lies in it with three words or more."""
    n, t = F.col("p_name"), F.col("p_type")
    part = table(spark, sf_dir, "part")
    s = F.col("s_suppkey")
    name = F.when(s % 3 == 0, n).when(s % 3 == 1, F.concat_ws(" ", n, t)).otherwise(F.concat_ws(" ", t, F.lit("of"), n, t, "p_brand"))
    known = table(spark, sf_dir, "supplier").join(part, s == F.col("p_partkey")).select(s.alias("place"), F.lower(name).alias("k"))
    return containment.first_place(part.select(F.lower(F.concat_ws(" ", n, t)).alias("key")), "key", known, "k", "place", 3)


_ITEMS = """i AS (SELECT user_id % 7 AS source, event_id // 40 AS page, CASE WHEN user_id % 7 < 3 THEN event_type || CAST(floor(value) AS BIGINT) % 40 ELSE CAST(event_id AS VARCHAR) END AS item FROM events)"""


@query(f"""WITH {_ITEMS}, t AS (SELECT source, page, count(*) AS n FROM i GROUP BY ALL), f AS (SELECT source, page, count(*) AS new FROM (SELECT source, item, min(page) AS page FROM i GROUP BY ALL) GROUP BY ALL),
p AS (SELECT t.*, coalesce(new, 0) AS new FROM t LEFT JOIN f USING (source, page)),
r AS (SELECT *, coalesce(sum(n) OVER b, 0) AS spent, coalesce(max((new = 0)::INT) OVER b, 0) AS dry, row_number() OVER (PARTITION BY source ORDER BY page) AS place FROM p WINDOW b AS (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, dry = 0 AND spent < 300 AND place <= 60 AS ok FROM r), m AS (SELECT source, max(place) AS last FROM k GROUP BY 1)
SELECT source, count(*) AS pages, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(new) AS BIGINT) AS found, CASE WHEN bool_or(new = 0) THEN 'dry' WHEN max(place) = any_value(last) THEN 'end' WHEN sum(n) >= 300 THEN 'budget' ELSE 'ceiling' END AS stopped,
  CASE WHEN bool_or(new = 0) OR max(place) = any_value(last) THEN false ELSE true END AS truncated FROM k JOIN m USING (source) WHERE ok GROUP BY source""")
def paged_until(spark, sf_dir):
    """Where each of seven paged sources is left: a page without anything new, a budget of 300 rows, or a ceiling of 60 pages."""
    s = F.col("user_id") % 7
    item = F.when(s < 3, F.concat("event_type", (F.floor("value") % 40).cast("string"))).otherwise(F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(s.alias("source"), F.floor(F.col("event_id") / 40).alias("page"), item.alias("item"))
    return paging.paged_until(rows, "source", "page", "item", 300, 60)[1]


@query("""WITH p AS (SELECT n_nationkey AS place, CASE n_nationkey % 4 WHEN 0 THEN 'Indian Institute of Technology Z' || n_nationkey WHEN 1 THEN 'National Institute of Technology Z' || n_nationkey WHEN 2 THEN 'International Institute of Information Technology Z' || n_nationkey ELSE 'College Z' || n_nationkey END AS name FROM nation),
n AS (SELECT place, name FROM p UNION SELECT place, (['IIT', 'NIT', 'IIIT'])[place % 4 + 1] || ' Z' || place FROM p WHERE place % 4 < 3 UNION SELECT place, 'AZ' || place FROM p WHERE length('AZ' || place) >= 3 UNION SELECT place, 'Zed Technology ' || place FROM p WHERE place % 2 = 0),
t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'IIT' WHEN 1 THEN 'NIT' ELSE 'IIIT' END || ' Z' || s_nationkey AS target, s_nationkey AS place, s_nationkey % 4 = 3 OR (s_suppkey % 3 = s_nationkey % 4 AND s_nationkey % 4 < 2) AS fits FROM supplier)
SELECT n.place, name, (SELECT count(*) FROM t WHERE t.place = n.place AND fits) AS targets FROM n""")
def institution_keys(spark, sf_dir):
    """Every name that an institution may go by, and how many targets are its own by their keys, short forms read in full."""
    k = F.col("n_nationkey")
    family = F.when(k % 4 == 0, "Indian Institute of Technology").when(k % 4 == 1, "National Institute of Technology").when(k % 4 == 2, "International Institute of Information Technology").otherwise("College")
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://o/"), k).alias("id"), F.concat(family, F.lit(" Z"), k).alias("display_name"), F.lit("r").alias("ror"), F.lit("https://h").alias("homepage_url"), F.array(F.concat(F.lit("AZ"), k), F.lit("Z")).alias("display_name_acronyms"), F.array(F.concat(F.when(k % 2 == 0, "Zed Technology ").otherwise("Zed "), k)).alias("display_name_alternatives"))
    profiles = institutions.profile(own)
    places = profiles.select(F.col("id").alias("place"), "name")
    s = F.col("s_suppkey")
    short = F.when(s % 3 == 0, "IIT").when(s % 3 == 1, "NIT").otherwise("IIIT")
    targets = table(spark, sf_dir, "supplier").select(s.alias("line"), F.concat(short, F.lit(" Z"), "s_nationkey").alias("name"), F.col("s_nationkey").cast("string").alias("own"))
    # keys of Z1 lie in those of Z10 to Z19: only targets of the very number are counted
    found = institutions.matched_targets(targets, places).where("own = place").groupBy("place").agg(F.count("*").alias("targets"))
    names = institutions.spellings(places, profiles).select("place", "name")
    return names.join(found, "place", "left").select(F.col("place").cast("int").alias("place"), "name", F.coalesce("targets", F.lit(0)).alias("targets"))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://www.u' || s_suppkey || '.ac.in/' WHEN s_suppkey % 3 = 1 THEN 'http://u' || s_suppkey || '.edu/home' END AS home FROM supplier), c AS (SELECT unnest(['civil', 'ce']) AS code)
SELECT s_suppkey, code || ' department' AS label, unnest([split_part(home, '://', 1) || '://www.' || code || '.' || h, split_part(home, '://', 1) || '://' || code || '.' || h, rtrim(home, '/') || '/' || code]) AS url
FROM (SELECT *, regexp_replace(split_part(split_part(home, '://', 2), '/', 1), '^www[.]', '') AS h FROM s WHERE home IS NOT NULL), c""")
def url_seeds(spark, sf_dir):
    """Addresses where the civil engineers of a place may be: with www. and without it, and below the home page."""
    s = F.col("s_suppkey")
    home = F.when(s % 3 == 0, F.concat(F.lit("https://www.u"), s, F.lit(".ac.in/"))).when(s % 3 == 1, F.concat(F.lit("http://u"), s, F.lit(".edu/home")))
    return institutions.url_seeds(table(spark, sf_dir, "supplier").select("s_suppkey", home.alias("home")), "home", ["civil"]).select("s_suppkey", "label", "url")
