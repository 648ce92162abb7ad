"""Queries over pages and texts that are built from the given tables, so that SQL knows what they hold: listings of people, links, papers, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.operators import mining
from dossier.plans.queries import query, table
from dossier.sources import html

#: Digits as letters: numbers that can stand in names.
DIGITS, LETTERS = "0123456789", "abcdefghij"
_NAME = "'Z' || translate(lpad(CAST({} AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij')"


def _name(key: str | Column) -> Column:
    return F.concat(F.lit("Z"), F.translate(F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 7, "0"), DIGITS, LETTERS))


@query(f"""WITH c AS (SELECT c_custkey // 60 AS page_id, c_custkey, 'Dr. Ann ' || CASE WHEN c_custkey % 4 = 0 THEN 'B. ' ELSE '' END || {_NAME.format("c_custkey")} AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Assistant Professor' WHEN 'MACHINERY' THEN 'Head of the group' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'z' || c_custkey || '@x.ac.in' END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://x.ac.in/dept/people/' || c_custkey END AS profile_url FROM customer)
SELECT page_id, name, title, email, profile_url FROM c WHERE (title IS NOT NULL OR email IS NOT NULL OR profile_url IS NOT NULL) AND page_id IN (SELECT page_id FROM c GROUP BY page_id HAVING count(*) >= 3)""")
def listed_people(spark, sf_dir):
    """People on listing pages of sixty cards each: names in headings, links and bold text, titles, addresses as links and as text, links to own and to other sites."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Dr. Ann "), F.when(k % 4 == 0, "B. ").otherwise(""), _name("c_custkey"))
    shown = F.when(k % 5 == 0, F.concat(F.lit("<h3>"), name, F.lit("</h3>"))).when(k % 5 == 1, F.concat(F.lit("<strong>"), name, F.lit("</strong>"))).otherwise(F.concat(F.lit("<span>"), name, F.lit("</span>")))
    title = F.when(F.col("c_mktsegment") == "BUILDING", "<p>Assistant  Professor</p>").when(F.col("c_mktsegment") == "MACHINERY", "<p>Head of the group</p>").otherwise("<p>Office 7</p>")
    mail = F.when(k % 4 == 0, F.concat(F.lit('<a href="mailto:Z'), k, F.lit('@x.ac.in?subject=hi">write</a> or desk@x.ac.in'))).when(k % 2 == 0, F.concat(F.lit("<p>Z"), k, F.lit("@x.ac.in</p>"))).otherwise("")
    link = F.when(k % 3 == 0, F.concat(F.lit('<a href="people/'), k, F.lit('">page</a>'))).otherwise('<a href="https://other.org/people/1">paper</a>')
    card = F.concat(F.lit('<div class="card person">'), shown, title, mail, link, F.lit("</div>"))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(k / 60).alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda x: x["card"]), "").alias("cards"))
    nav = '<nav><ul><li class="m"><a href="/people">Guest Lecture</a></li><li class="m"><a href="/faculty">Project Work</a></li><li class="m"><a href="/x">Explore More</a></li></ul></nav>'
    pages = pages.select("page_id", F.lit("https://x.ac.in/dept/list.html").alias("url"), F.concat(F.lit(f"<html><body>{nav}<div class='grid'>"), "cards", F.lit("</div></body></html>")).alias("html"))
    return html.page_people(pages).select("page_id", "name", F.regexp_replace("title", " +", " ").alias("title"), "email", "profile_url")


_ENDS = ["faculty", "chem/people/", "a/b/c/d/e/staff", "nano", "about/our-team", "news/faculty", "plain"]


@query(f"""WITH s AS (SELECT s_nationkey AS page_id, s_suppkey, s_suppkey % 7 AS k FROM supplier),
l AS (SELECT page_id, s_suppkey, CASE WHEN k = 3 THEN 'https://bio' || s_suppkey || '.x.ac.in/' ELSE 'https://www.x.ac.in/u' || s_suppkey || '/' END || (['{"', '".join(_ENDS)}'])[k + 1] AS link, k FROM s WHERE k NOT IN (5, 6)),
p AS (SELECT *, rtrim(link, '/') AS whole, 'member ' || s_suppkey AS label FROM l)
SELECT page_id, whole AS link, 10 * regexp_matches(whole, 'faculty|people|staff|our-team')::INT + 5 * contains(whole, 'faculty')::INT + 8 * regexp_matches(whole, 'chem|nano|bio')::INT + 6 * regexp_matches(whole, '/(faculty|people|staff)$')::INT
  - greatest(0, length(whole) - length(replace(whole, '/', '')) - 2 - 4) AS score FROM p""")
def directory_links(spark, sf_dir):
    """Links of a nation's page that may lead to people, with their scores: suppliers stand for departments. Links to news and plain ones go, subdomains stay, deep paths lose."""
    k = F.col("s_suppkey")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % 7 + 1).cast("int"))
    href = F.when(k % 7 == 3, F.concat(F.lit("https://bio"), k, F.lit(".x.ac.in/"), end)).otherwise(F.concat(F.lit("/u"), k, F.lit("/"), end))
    anchor = F.concat(F.lit('<a href="'), href, F.lit('">member <b>'), k, F.lit('</b></a><a href="https://other.org/faculty">o</a><a href="'), href, F.lit('#top">again</a>'))
    pages = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(anchor)), " ").alias("html"))
    return html.directory_links(pages.withColumn("url", F.lit("https://www.x.ac.in/")))


@query(f"""SELECT o_orderkey, 'Ann {'{0}'}|Émile O''{'{1}'}' AS names FROM orders""".replace("'Ann {0}|Émile O''{1}'", f"'Ann ' || {_NAME.format('o_custkey')} || '|Émile A. O''' || substring({_NAME.format('o_orderkey')}, 2)"))
def titled_names(spark, sf_dir):
    """Names after titles in sentences: a connective ends a name, accents, apostrophes and initials are parts of it, names without a title and repeats don't count."""
    one, two = _name("o_custkey"), F.substring(_name("o_orderkey"), 2, 20)
    text = F.concat(F.lit("Dr. Ann "), one, F.lit(" And Colleagues met Prof Émile A. O'"), two, F.lit(". Bob Brown and Dr.  Ann "), one, F.lit(" The Third wrote to Dr. Who."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(mining.mentions(text), "|").alias("names"))


_HEADS = {"ECONOMY": "Experimental Details", "SMALL": "Instrumentation:", "MEDIUM": "2.1 Apparatus", "PROMO": "METHODS AND MATERIALS"}
_BODY = "repeat(p_name || ' was used. ', p_size % 9)"
_HEAD = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HEADS.items()) + " END"


@query(f"""WITH p AS (SELECT p_partkey, {_HEAD} AS head, {_BODY} AS body FROM part),
t AS (SELECT *, head || chr(10) || body || chr(10) AS own, 'Title' || chr(10) || coalesce(head, 'A remark') || chr(10) || body || chr(10) || 'Bibliography' || chr(10) || 'zorb' AS text FROM p)
SELECT p_partkey, CASE WHEN head IS NOT NULL AND length(regexp_replace(own, '^\\s+|\\s+$', '', 'g')) >= 80 THEN own ELSE text END AS section FROM t""")
def paper_sections(spark, sf_dir):
    """The methods section of a paper, or all of it where there is none of eighty characters."""
    head = F.element_at(F.create_map(*(F.lit(x) for kv in _HEADS.items() for x in kv)), F.col("p_type"))
    body = F.expr("repeat(concat(p_name, ' was used. '), p_size % 9)")
    text = F.concat(F.lit("Title\n"), F.coalesce(head, F.lit("A remark")), F.lit("\n"), body, F.lit("\nBibliography\nzorb"))
    return table(spark, sf_dir, "part").select("p_partkey", mining.methods_section(text).alias("section"))


_TERM = "(?:^|[^A-Za-z0-9])(licensed under|the of)(?:$|[^A-Za-z0-9])"


@query(rf"""WITH s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?;])[\s\x0B]+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))) AS x FROM documents)),
f AS (SELECT *, strpos(lower(s), lower(regexp_extract(s, '(?i){_TERM}', 0))) - 1 + CASE WHEN regexp_matches(regexp_extract(s, '(?i){_TERM}', 0), '(?i)^[lt]') THEN 0 ELSE 1 END AS m FROM s WHERE regexp_matches(s, '(?i){_TERM}')),
w AS (SELECT *, greatest(0, m - 130) AS b FROM f),
c AS (SELECT doc_id, i, CASE WHEN length(s) <= 260 THEN s ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || trim(substring(s, b + 1, 260)) || CASE WHEN b + 260 < length(s) THEN '…' ELSE '' END END AS t FROM w),
o AS (SELECT doc_id, arg_min(t, i) AS t, min(i) AS i FROM c GROUP BY doc_id, lower(t)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o)
SELECT doc_id, k AS place, t AS snippet FROM r WHERE k <= 30""")
def term_snippets(spark, sf_dir):
    """Sentences with a term, cut to a window around it, distinct but for case, thirty of a text."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(mining.snippets(F.col("text"), ["licensed under", "the of"])).alias("place", "snippet"))
    return found.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "snippet")
