"""Profile, listing, laboratory and news pages. A small parser cuts each page into blocks inside Arrow batches; whatever is looked for in them is a Spark column or
a join, so a page costs one pass of the parser. Nulls: a null page has no blocks; a field that isn't there is null."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import mining
from dossier.operators.order import top_per_group
from dossier.sources import html as H

# Labels of fields, words of navigation, hosts of social pages, words of links to own sites and to equipment, endings of files.
INSTITUTION_LABELS = r"(?:current\s+)?(?:affiliation|institute|institution|organi[sz]ation|university|employer|works?\s+at)"
DEPARTMENT_LABELS = r"department|dept\.?|school|centre|center"
DESIGNATION_LABELS = r"designation|position|title|role"
NAVIGATION = ["login", "sign in", "register", "home", "about", "contact", "search", "help", "faq", "privacy"]
SOCIAL_HOSTS = [
    "scholar.google", "linkedin.com", "researchgate.net", "orcid.org", "twitter.com", "x.com", "facebook.com", "youtube.com", "scopus.com", "publons.com", "webofscience.com", "github.com", "dblp.org",
    "semanticscholar.org", "academia.edu", "instagram.com",
]
SITE_WORDS = ["lab", "group", "website", "homepage", "home page", "personal page", "research group", "laboratory", "web page", "webpage", "google sites", "sites.google"]
SITE_HREFS = ["lab", "group", "sites.google"]
EQUIPMENT_WORDS = ["facilit", "instrument", "equipment", "infrastructure", "resources", "lab", "laborator", "research", "setup", "characterization", "characterisation"]
EQUIPMENT_STRONG = ["facilit", "instrument", "equipment"]
DOCUMENTS, FILES = r"(?i)\.(pdf|docx?)$", r"(?i)\.(pdf|jpg|png|docx?|pptx?)$"
RANKS = (
    r"(?i)\b((?:Distinguished|Emeritus|Visiting|Adjunct|Chair|Institute|Senior|Principal|Chief|Junior)?\s*(?:Professor|Associate Professor|Assistant Professor|Scientist|Research Scientist|"
    r"Principal Scientist|Senior Scientist|Reader|Lecturer|Research Fellow|Postdoctoral Fellow|Research Associate|Head of (?:the )?Department|Dean|Director))\b"
)
DEPARTMENT = r"\b((?:Department|Dept\.?|School|Centre|Center|Division) (?:of|for) [A-Z][A-Za-z&,\- ]{3,60}?)(?=[\n,.;|()]|\s{2,}|$)"
PHONE = r"(?i)(?:phone|tel|telephone|mobile|contact)\s*[:.]?\s*([+\d][\d\s()+-]{7,20})"
ORCID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"
HONORIFICS = r"(?i)^(?:(?:dr|prof|professor|mr|mrs|ms|shri|smt)\.?\s+)+"
#: Classes of a registry's pages: what a card's parts and a profile's parts are called.
CARD = {"designation": "exp-role-text", "subject": "adv-pill-text", "institute": "exp-meta-row-university", "location": "exp-meta-row-location"}
PROFILE_NAME, PROFILE_BADGE = "custom_hero_name", "custom_hero_exp_badge"

_HEADINGS = {f"h{k}" for k in range(1, 7)}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_ENDED_BY_ITS_LIKE = {"p", "li", "tr", "td", "th", "dt", "dd", *_HEADINGS}
#: Open elements that are told of a block, the innermost ones; open elements that are kept at all (pages may never close theirs).
_DEEPEST, _DEPTH = 24, 512
BLOCK = pa.struct([(n, pa.string()) for n in ("path", "css", "link", "link_text", "text", "next_path", "next_text")])
_SCHEMA = "array<struct<path:string,css:string,link:string,link_text:string,text:string,next_path:string,next_text:string>>"


class _Blocks(H._Page):
    """Blocks begin and end with block elements, elements that have a class, and bold labels; a heading stays whole."""

    def __init__(self, url: str) -> None:
        super().__init__()
        self.url, self.open, self.found, self.parts, self.link, self.begun, self.link_words = url, [], [], [], None, None, None

    def _cuts(self, tag: str, css: str) -> bool:
        inside = any(t in _HEADINGS for t, *_ in self.open)
        return tag in H.BLOCKS or not inside and bool(css or tag in ("b", "strong", "label"))

    def _flush(self) -> None:
        self._end_link()
        words = " ".join(" ".join(self.parts).split())
        if words:
            near = self.open[-_DEEPEST:]
            self.found.append(("/".join(t for t, *_ in near), " ".join(c for _, c, *_ in near if c), self.link or self._around(), self.link_words, words))
        self.parts, self.link, self.begun, self.link_words = [], None, None, None

    def _end_link(self) -> None:
        if self.begun is not None:
            self.link_words, self.begun = " ".join(" ".join(self.parts[self.begun :]).split()) or None, None

    def _around(self) -> str | None:
        return next((x for _, _, x, _ in reversed(self.open) if x), None)

    def _close(self, tag: str) -> None:
        at = max((i for i, (t, *_) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            if any(cuts for *_, cuts in self.open[at:]):
                self._flush()
            del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in H.SKIPPED:
            self.skip += 1
        own = dict(attrs)
        css, link = own.get("class") or "", None
        if tag in _ENDED_BY_ITS_LIKE and any(t == tag for t, *_ in self.open[-3:]):
            self._close(tag)
        if tag == "a" and own.get("href"):
            try:
                link = urljoin(self.url, own["href"].strip())
            except ValueError:  # no URL
                link = None
        cuts = self._cuts(tag, css)
        if cuts:
            self._flush()
        if link and not self.link:
            self.link, self.begun = link, len(self.parts)
        if tag not in _VOID and len(self.open) < _DEPTH:
            self.open.append((tag, css, link, cuts))

    def handle_endtag(self, tag):
        if tag in H.SKIPPED and self.skip:
            self.skip -= 1
        if tag == "a":
            self._end_link()
        self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def _cut(url: str | None, html: str | None) -> list[dict]:
    page = _Blocks(url or "")
    page.feed(html or "")
    page.close()
    page._flush()
    after = [*page.found, (None,) * 5][1:]
    return [{"path": p, "css": c, "link": x, "link_text": w, "text": t, "next_path": n[0], "next_text": n[4]} for (p, c, x, w, t), n in zip(page.found, after, strict=True)]


def page_blocks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", references: Iterable[str] | None = None) -> DataFrame:
    """key, blocks: the page's texts in their order, each with the elements and classes around it, its first link with that link's text, and the text after it. references: see html.only_read."""

    def run(batches):
        for b in H.few(batches):
            cut = [_cut(u, H.only_read(h, references)) for u, h in zip(b["u"].to_pylist(), b["h"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(cut, pa.list_(BLOCK))], names=[key, "blocks"])

    return pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, f"{key} long, blocks {_SCHEMA}")


def within(block: Column, *tags: str) -> Column:
    return block["path"].rlike(rf"(^|/)({'|'.join(tags)})(/|$)")


def whole_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def labelled(blocks: Column, labels: str) -> Column:
    """The first value of under 200 characters beside one of the labels: the text after a block that is a label only, or what follows label and colon."""
    alone, inline = rf"(?i)^(?:{labels})\s*:?\s*$", rf"(?i)^(?:{labels})\s*:\s*(\S.*)$"

    def value(b: Column) -> Column:
        return F.when((F.length(b["text"]) <= 40) & b["text"].rlike(alone), b["next_text"]).when(b["text"].rlike(inline), F.regexp_extract(b["text"], inline, 1))

    return F.get(F.filter(F.transform(blocks, value), lambda v: F.length(v).between(1, 199)), F.lit(0))


def first_classed(blocks: Column, css: str) -> Column:
    return F.get(F.filter(blocks, lambda b: F.contains(b["css"], F.lit(css))), F.lit(0))["text"]


def without_honorific(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(name), HONORIFICS, ""))
    return F.when(bare != "", bare).otherwise(F.trim(name))


def _found(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, pattern, 1)
    return F.when(got != "", T.squeeze(got))


def designation(text: Column) -> Column:
    """The first academic rank in the first 3000 characters, in title case."""
    title = F.initcap(_found(F.substring(text, 1, 3000), RANKS))
    return F.regexp_replace(F.regexp_replace(title, r"\bOf The\b", "of the"), r"\bOf\b", "of")


def department(text: Column) -> Column:
    return F.regexp_replace(_found(F.substring(text, 1, 3000), DEPARTMENT), "[,.;]+$", "")


def phone(text: Column) -> Column:
    """A number of eight digits or more that stands beside a label."""
    got = _found(text, PHONE)
    return F.when(F.length(F.regexp_replace(got, r"\D", "")) >= 8, got)


def affiliation(blocks: Column, known: Iterable[str] = ()) -> Column:
    """institution, department, designation by their labels; without a labelled institution, the first known one in the page's first 4000 characters."""
    head = F.lower(F.substring(whole_text(F.filter(blocks, lambda b: ~within(b, "nav", "footer"))), 1, 4000))
    named = [F.when(F.contains(head, F.lit(k.lower())), F.lit(k)) for k in known]
    return F.struct(F.coalesce(labelled(blocks, INSTITUTION_LABELS), *named).alias("institution"), labelled(blocks, DEPARTMENT_LABELS).alias("department"), labelled(blocks, DESIGNATION_LABELS).alias("designation"))


def profile(blocks: Column, known: Iterable[str] = ()) -> Column:
    """name, orcid, expertise and text of a profile page, with its affiliation and contact fields."""
    text = whole_text(blocks)
    heading = F.get(F.filter(blocks, lambda b: within(b, "h1", "h2")), F.lit(0))["text"]
    badges = F.array_join(F.transform(F.filter(blocks, lambda b: F.contains(b["css"], F.lit(PROFILE_BADGE))), lambda b: b["text"]), "; ")
    links = F.array_join(F.transform(blocks, lambda b: b["link"]), " ")
    orcid = lambda c: F.nullif(F.regexp_extract(c, f"({ORCID})", 1), F.lit(""))
    by_label = affiliation(blocks, known)
    return F.struct(
        without_honorific(F.coalesce(first_classed(blocks, PROFILE_NAME), heading)).alias("name"), by_label["institution"].alias("institution"), F.coalesce(by_label["department"], department(text)).alias("department"),
        F.coalesce(by_label["designation"], designation(text)).alias("designation"), phone(text).alias("phone"), F.coalesce(orcid(links), orcid(text)).alias("orcid"),
        F.coalesce(F.nullif(badges, F.lit("")), labelled(blocks, "expertise")).alias("expertise"), F.substring(text, 1, 6000).alias("text"),
    )


def headlines(blocks: DataFrame, key: str = "page_id", headings: tuple[str, ...] = ("h2", "h3"), limit: int = 30) -> DataFrame:
    """key, position, title, link, summary, names of news pages without a feed: headings of 15 to 200 characters outside of navigation, equal ones once, the first ones."""
    one = blocks.select(key, F.posexplode("blocks").alias("position", "b")).where(within(F.col("b"), *headings) & ~within(F.col("b"), "nav", "header", "footer") & F.length("b.text").between(15, 200))
    summary = F.when(F.col("b.next_path").rlike("(^|/)p(/|$)"), F.substring("b.next_text", 1, 800))
    rows = one.select(key, "position", F.col("b.text").alias("title"), F.col("b.link").alias("link"), summary.alias("summary"))
    rows = rows.groupBy(key, F.lower("title").alias("__t")).agg(F.min(F.struct("position", "title", "link", "summary")).alias("x")).select(key, "x.*")
    rows = top_per_group(rows, [key], [F.col("position")], limit).drop("rank")
    return rows.withColumn("names", mining.mentions(F.concat_ws(". ", "title", F.coalesce("summary", F.lit("")))))


def _web(links: DataFrame) -> DataFrame:
    """Links to pages, each with its address without fragment, its path and its name for comparisons."""
    own = links.where(F.col("link").rlike("(?i)^https?://") & ~F.startswith(F.trim("href"), F.lit("#"))).withColumn("address", F.substring_index("link", "#", 1))
    return own.withColumn("path", F.lower(F.coalesce(F.regexp_extract("address", r"^[a-zA-Z]+://[^/?]*([^?]*)", 1), F.lit("")))).withColumn("same", F.regexp_replace(F.lower("address"), "/+$", ""))


def _first_each(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    once = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, "same").orderBy("position"))).where("__n = 1").drop("__n")
    return top_per_group(once, [key], order, limit)


def _any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _elsewhere() -> Column:
    return F.lower("host") != F.lower(F.coalesce(F.regexp_extract("page_url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))


def websites(links: DataFrame, key: str = "page_id", limit: int = 5, words: list[str] = SITE_WORDS, hrefs: list[str] = SITE_HREFS) -> DataFrame:
    """key, position, link of own sites: links that are called so, or that lead off the page's host under a short text; no social pages, no documents."""
    label = F.lower("link_text")
    called = _any_of(label, words) | _any_of(F.lower("href"), hrefs)
    off = _elsewhere() & F.length(label).between(1, 59) & ~F.col("path").rlike(DOCUMENTS)
    rows = _web(links).where(~_any_of(F.lower("host"), SOCIAL_HOSTS) & (called | off))
    return _first_each(rows, key, [F.col("position")], limit).select(key, "position", "link")


def equipment_pages(links: DataFrame, key: str = "page_id", limit: int = 4, words: list[str] = EQUIPMENT_WORDS, strong: list[str] = EQUIPMENT_STRONG) -> DataFrame:
    """key, link, score: pages of the same host that most likely list what a laboratory owns."""
    label = F.lower("link_text")
    both = F.concat_ws(" ", label, "path")
    points = sum((F.when(F.contains(label, F.lit(w)), 3).when(F.contains(both, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    points = points + F.when(_any_of(both, strong), 5).otherwise(0)
    own = F.regexp_replace(F.lower("page_url"), "/+$", "")
    rows = _web(links).where(~_elsewhere() & ~F.col("path").rlike(FILES) & (F.col("same") != own)).withColumn("score", points).where("score > 0")
    return _first_each(rows, key, [F.desc("score"), F.col("position")], limit).select(key, F.col("address").alias("link"), "score")


def profile_links(links: DataFrame, wanted: Column, key: str = "page_id", limit: int = 3) -> DataFrame:
    """key, link, link_text of links on a search page whose text may name the person; wanted: the tokens of the name."""
    label = F.col("link_text")
    rows = _web(links).where(~_elsewhere() & F.length(label).between(1, 80) & ~F.lower(label).isin(NAVIGATION) & T.same_person(T.name_tokens(without_honorific(label)), wanted)).withColumn("same", F.col("address"))
    return _first_each(rows, key, [F.col("position")], limit).select(key, F.col("address").alias("link"), "link_text")


def registry_cards(blocks: DataFrame, key: str = "page_id", profile_path: str = r"^/profile/(\d+)/?$", parts: dict[str, str] = CARD) -> DataFrame:
    """key, registry_id, profile_url, name, the parts and card_text of each person on a listing page. A card begins with the first link to its profile and ends before the next one's."""
    path = F.coalesce(F.regexp_extract("b.link", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit(""))
    one = blocks.select(key, F.posexplode("blocks").alias("position", "b")).withColumn("id", F.nullif(F.regexp_extract(path, profile_path, 1), F.lit("")))
    one = one.withColumn("new", (F.row_number().over(W.partitionBy(key, "id").orderBy("position")) == 1) & F.col("id").isNotNull())
    one = one.withColumn("card", F.sum(F.col("new").cast("int")).over(W.partitionBy(key).orderBy("position"))).where("card > 0")
    first = lambda c, name: F.min_by(c, F.when(c.isNotNull(), F.col("position"))).alias(name)
    named = [first(F.when(F.contains("b.css", F.lit(css)), F.col("b.text")), name) for name, css in parts.items()]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("b.text").alias("t")))), lambda x: x["t"]), " ")
    cards = one.groupBy(key, "card").agg(F.min_by("id", "position").alias("registry_id"), F.min_by("b.link", "position").alias("profile_url"), F.min_by(F.coalesce("b.link_text", "b.text"), "position").alias("name"), *named, F.substring(text, 1, 600).alias("card_text"))
    return cards.withColumn("name", without_honorific(F.col("name"))).drop("card")


def listed_total(text: Column) -> Column:
    """The number before "Total Experts"."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"(?i)([\d,]*\d)\s*Total Experts", 1), F.lit("")), ",", "").cast("long")
