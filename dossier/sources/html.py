"""What pages hold: text, links, e-mails, people. One page is one row; a small parser works on it inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "nav", "header", "footer", "title", "dt", "dd"}
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Beginnings of addresses that are nobody's own.
GENERAL_BOXES = [
    "registrar", "hod", "head", "office", "admin", "administrator", "info", "enquiry", "enquiries", "contact", "webmaster", "web", "dean", "director", "principal", "secretary", "support", "help", "helpdesk",
    "noreply", "no-reply", "postmaster", "library", "accounts", "finance", "admission", "admissions", "placement", "training", "chairman", "convenor", "coordinator", "department", "dept", "chemistry", "physics", "office365",
]
# Words of academic titles, words of labels that are no names, particles inside names.
TITLE_WORDS = ["professor", "lecturer", "reader", "fellow", "researcher", "scientist", "chair", "director", "head of", "postdoc", "principal investigator", "emeritus"]
LABEL_WORDS = [
    "about", "admission", "admissions", "alumni", "all", "apply", "announcement", "board", "campus", "cell", "centre", "center", "chair", "college", "committee", "contact", "convocation", "council", "course",
    "curriculum", "department", "directory", "download", "email", "events", "explore", "facility", "faculty", "gallery", "grievance", "guest", "home", "hostel", "info", "institute", "lab", "laboratory", "learn more",
    "lecture", "library", "link", "login", "menu", "message", "more", "news", "notice", "overview", "peoples", "people", "personal", "placement", "policy", "portal", "profile", "programme", "program", "project",
    "read more", "redressal", "research", "resource", "school", "search", "seminar", "skip", "staff", "student", "students", "teaching", "tender", "university", "view profile", "webmail", "webpage", "website", "welcome",
    "workshop",
]
PARTICLES = "van|von|de|del|della|di|da|el|al|bin|ibn"
_LETTER = "[A-Za-zÀ-ɏ'’-]"
PERSON = rf"^(?:(?:Dr|Prof|Professor|Mr|Mrs|Ms|Miss)\.?\s+)?[A-ZÀ-ɏ]{_LETTER}+(?:\s+[A-Z]\.?)?(?:\s+(?:{PARTICLES})\.?)?\s+[A-ZÀ-ɏ]{_LETTER}+$"
CARD_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
#: Parts of paths that lead to a person's page.
PERSON_PATHS = r"(?i)/(people|faculty|profile|staff|directory|member|person|user|~)"
#: Elements whose text may be a name, the most telling ones first; elements that may be one person each; elements that hold no content.
NAMED = ["h1", "h2", "h3", "h4", "h5", "a", "strong", "span"]
CARDS, CHROME = {"li", "article", "div", "tr"}, {"nav", "header", "footer", "script", "style", "aside"}
#: Cards of one kind on a page of people, and how many of them must have a name.
LEAST_CARDS, MOST_CARDS, LEAST_NAMES, LOOKED_AT = 3, 400, 2, 40
# What speaks for a page of people in addresses and texts of links, with the points of each; links that are never followed.
DIRECTORY_HINTS = ["faculty", "people", "staff", "directory", "our-team", "academics", "professors"]
DEPARTMENT_HINTS = ["chem", "material", "metallurg", "physic", "energy", "nano", "bio", "environment", "civil", "mechanical", "electrical"]
SKIPPED_LINKS = r"(?i)(login|signin|apply|admission|alumni|tender|notice|news|event|gallery|download|contact|privacy|sitemap|search|\.pdf$|\.doc|\.zip|mailto:|tel:)"
DIRECTORY_POINTS, FACULTY_POINTS, DEPARTMENT_POINTS, INDEX_POINTS, FREE_DEPTH = 10, 5, 8, 6, 4


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.text, self.links, self.blocks = 0, [], [], []
        self.href, self.link_text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "a":
            self.close_link()
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "a":
            self.close_link()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.href is not None:
                self.link_text.append(data)

    def close_link(self):
        if self.href is not None:
            self.links.append((self.href, " ".join("".join(self.link_text).split())))
        self.href, self.link_text = None, []

    def lines(self) -> list[str]:
        return [x for x in (" ".join(line.split()) for line in "".join(self.text).split("\n")) if x]


#: Pages that are parsed between two results, so that a worker holds the parts of few pages whatever the size of Spark's batches.
PAGES = 64


def few(batches):
    """Arrow batches in pieces of PAGES rows."""
    for b in batches:
        for at in range(0, b.num_rows, PAGES):
            yield b.slice(at, PAGES)


def only_read(html: str | None, references: Iterable[str] | None) -> str | None:
    """html in which no other character references than these (names or numbers such as #x27, each with its semicolon) are read; the rest is text. None: all, as browsers do."""
    if references is None or not html:
        return html
    return re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.close_link()
    return page


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", references: Iterable[str] | None = None) -> DataFrame:
    """key, text: visible text, one line a block. references: see only_read."""

    def run(batches):
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(["\n".join(_parsed(only_read(x, references)).lines()) for x in b["h"].to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(run, f"{key} long, text string")


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, page_url, position, href, link, host, link_text of each link in its order."""

    def run(batches):
        for b in few(batches):
            out = []
            for k, u, h in zip(b["k"].to_pylist(), b["u"].to_pylist(), b["h"].to_pylist(), strict=True):
                for n, (href, text) in enumerate(_parsed(h).links):
                    try:
                        link = urljoin(u or "", href or "")
                        host = urlparse(link).netloc
                    except ValueError:  # no URL
                        link, host = None, None
                    out.append((k, u, n, href, link, host, text))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4), strict=True)], names=[key, "page_url", "position", "href", "link", "host", "link_text"])

    return pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, f"{key} long, page_url string, position int, href string, link string, host string, link_text string")


_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_ENDED_BY_ITS_LIKE = {"li", "tr", "p", "td", "th", *NAMED[:5]}


class _Cards(HTMLParser):
    """Elements that may be one person each, with their strings, the texts that may be names, and their links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, card or None, strings of an element that may be a name
        self.hidden, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in CHROME:
            self.hidden += 1
        if tag in _ENDED_BY_ITS_LIKE:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.close(k)
                if self.open[k:] and self.open[k][0] in CARDS | {"ul", "ol", "table"} or not self.open[k:]:
                    break
        own = dict(attrs)
        if tag == "a" and own.get("href") and not self.hidden:
            for e in self.open:
                if e[1]:
                    e[1]["hrefs"].append(own["href"])
        card = None
        if tag in CARDS and not self.hidden and (own.get("class") or "").split():
            card = {"kind": tag + " " + " ".join(sorted(own["class"].split())), "strings": [], "labels": [], "hrefs": []}
            self.found.append(card)
        self.open.append([tag, card, [] if tag in NAMED else None])

    def close(self, k: int) -> None:
        while len(self.open) > k:
            tag, _, strings = self.open.pop()
            if tag in CHROME:
                self.hidden -= 1
            if strings:
                for e in self.open:
                    if e[1]:
                        e[1]["labels"].append((NAMED.index(tag), " ".join(" ".join(strings).split())))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close(k)
                break

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            for e in self.open:
                if e[1]:
                    e[1]["strings"].append(text)
                if e[2] is not None:
                    e[2].append(text)


_CARD = "struct<strings:array<string>,labels:array<string>,hrefs:array<string>>"
_CARD_TYPE = pa.struct([(n, pa.list_(pa.string())) for n in ("strings", "labels", "hrefs")])


def page_cards(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, groups: elements of one tag and class that come LEAST_CARDS to MOST_CARDS times, as groups in the order of their first ones. labels: the texts that may be names, the most telling elements first."""

    def run(batches):
        for b in few(batches):
            out = []
            for h in b["h"].to_pylist():
                parser = _Cards()
                parser.feed(h or "")
                parser.close(0)
                groups: dict[str, list] = {}
                for c in parser.found:
                    own = {"strings": c["strings"], "labels": [t for _, t in sorted(c["labels"], key=lambda x: x[0])], "hrefs": c["hrefs"]}
                    groups.setdefault(c["kind"], []).append(own)
                out.append([g for g in groups.values() if LEAST_CARDS <= len(g) <= MOST_CARDS])
            yield pa.RecordBatch.from_arrays([b["k"], b["u"], pa.array(out, pa.list_(pa.list_(_CARD_TYPE)))], names=[key, "url", "groups"])

    return pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, f"{key} long, url string, groups array<array<{_CARD}>>")


def is_name(text: Column) -> Column:
    """Whether a text may be a person's name: of fitting length and form, without digits and words of labels."""
    low = F.lower(text)
    return F.length(text).between(4, 60) & ~text.rlike(r"\d") & ~low.rlike("|".join(LABEL_WORDS)) & text.rlike("(?U)" + PERSON)


def page_people(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, name, title, email, profile_url, bio of people on directory pages.

    People are cards of one kind, that with the most names among its first ones (at least LEAST_NAMES); a card counts if it has a name and a title, an address or a
    link to a person's page on the same host. Only the first card of a name on a page counts."""
    name = lambda c: F.get(F.filter(c["labels"], is_name), F.lit(0))
    named = lambda g: F.size(F.filter(F.slice(g, 1, LOOKED_AT), lambda c: name(c).isNotNull()))
    ranked = F.array_max(F.transform("groups", lambda g, i: F.struct(named(g).alias("names"), (-i).alias("place"))))
    best = page_cards(pages, key, url, html).withColumn("best", ranked).where(F.col("best.names") >= LEAST_NAMES)
    cards = best.select(key, "url", F.posexplode(F.get("groups", -F.col("best.place"))).alias("place", "c"))
    text = F.array_join("c.strings", " ")
    letters = F.filter(F.transform(F.filter("c.hrefs", lambda h: F.startswith(F.lower(h), F.lit("mailto:"))), lambda h: F.trim(F.substring_index(F.substring(h, 8, 1 << 20), "?", 1))), lambda a: a.rlike(f"^(?:{CARD_EMAIL})$"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    links = F.transform(F.filter("c.hrefs", lambda h: ~h.rlike("(?i)^(mailto:|tel:|#)")), lambda h: absolute(h, F.col("url")))
    found = cards.select(
        key, "place", name(F.col("c")).alias("name"),
        F.get(F.filter("c.strings", lambda s: F.lower(s).rlike("|".join(TITLE_WORDS)) & (F.length(s) < 120)), F.lit(0)).alias("title"),
        F.lower(F.coalesce(F.get(letters, F.lit(0)), F.nullif(F.regexp_extract(text, f"(?U){CARD_EMAIL}", 0), F.lit("")))).alias("email"),
        F.get(F.filter(links, lambda u: (host(u) == host(F.col("url"))) & u.rlike(PERSON_PATHS)), F.lit(0)).alias("profile_url"),
        F.when(F.length(text) > 40, F.substring(text, 1, 600)).alias("bio"),
    )
    found = found.where("name is not null and (title is not null or email is not null or profile_url is not null)")
    own = F.struct("place", "name", "title", "email", "profile_url", "bio")
    return found.groupBy(key, F.lower("name").alias("low")).agg(F.min(own).alias("x")).select(key, "x.name", F.regexp_replace("x.title", r"\s+", " ").alias("title"), "x.email", "x.profile_url", "x.bio")


def absolute(href: Column, base: Column) -> Column:
    """An address as seen from a page: whole ones stay, those of the host or of the folder are put after it, dots in paths are left."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    h = F.trim(href)
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("?")), F.concat(path, h)).otherwise(F.concat(folder, h))


def emails(text: Column) -> Column:
    """Addresses in their order, distinct, in lower case. A match begins where a run of mailbox characters does, or where the last match ends, so a run is looked at once; texts without an @ aren't searched."""
    begin, rest = r"(?:(?<![A-Za-z0-9._%+\-])|\G)", EMAIL.replace("+@", "++@", 1)
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({begin}{rest})"), F.lit(1)), F.lower))
    return F.when(F.contains(text, F.lit("@")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def personal_email(addresses: Column, name_tokens: Column) -> Column:
    """The address that fits a name best: the surname counts 10, each word 3, an initial before the surname 6, no general mailbox; the shorter one among equals, then the first by letters."""
    box = lambda a: F.regexp_replace(F.substring_index(a, "@", 1), "[^a-z0-9]", "")
    last = F.try_element_at(name_tokens, F.lit(-1))
    start = F.concat(F.substring(F.try_element_at(name_tokens, F.lit(1)), 1, 1), last)

    def score(a: Column) -> Column:
        words = 3 * F.size(F.filter(name_tokens, lambda t: F.contains(box(a), t)))
        points = words + F.when(F.contains(box(a), last), 10).otherwise(0) + F.when(F.startswith(box(a), start), 6).otherwise(0)
        return F.when(F.lower(a).rlike(rf"^({'|'.join(GENERAL_BOXES)})"), 0).otherwise(points)

    own = F.array_distinct(F.transform(addresses, lambda a: F.lower(F.trim(a))))
    ranked = F.array_sort(F.transform(F.filter(own, lambda a: score(a) > 0), lambda a: F.struct((-score(a)).alias("s"), F.length(a).alias("n"), a.alias("a"))))
    return F.get(ranked, F.lit(0))["a"]


def link_score(link: Column, text: Column) -> Column:
    """How much a link speaks for a page of people: hints in its address and text, an index at its end, less its depth."""
    own = F.lower(F.concat_ws(" ", F.coalesce(link, F.lit("")), F.coalesce(text, F.lit(""))))
    points = lambda pattern, n, c=own: F.when(c.rlike(pattern), n).otherwise(0)
    path = F.regexp_extract(F.coalesce(link, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    deep = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) - FREE_DEPTH
    index = points(r"(?i)/(faculty|people|staff)/?$", INDEX_POINTS, F.coalesce(link, F.lit("")))
    return points("|".join(DIRECTORY_HINTS), DIRECTORY_POINTS) + points("faculty", FACULTY_POINTS) + points("|".join(DEPARTMENT_HINTS), DEPARTMENT_POINTS) + index - F.greatest(F.lit(0), deep)


def directory_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", same_site: bool = True) -> DataFrame:
    """key, link, score: addresses on a page that may lead to its site's people, the best score of each. Subdomains are of the site."""
    links = page_links(pages, key, url, html).where(F.col("href").isNotNull() & ~F.col("href").rlike(SKIPPED_LINKS))
    whole = F.regexp_replace(F.substring_index("link", "#", 1), "/+$", "")
    links = links.withColumn("link", F.when(whole == "", F.col("page_url")).otherwise(whole)).where(F.col("link").rlike("(?i)^https?://"))
    if same_site:
        site = F.array_join(F.slice(F.split(F.regexp_extract("page_url", r"://([^/?#]*)", 1), r"\."), -3, 3), ".")
        short = F.regexp_extract("page_url", r"://([^/?#]*)", 1)
        root = F.when(F.size(F.split(short, r"\.")) >= 3, site).otherwise(short)
        links = links.where(F.endswith(F.regexp_extract("link", r"://([^/?#]*)", 1), root))
    return links.groupBy(key, "link").agg(F.max(link_score(F.col("link"), F.substring("link_text", 1, 80))).alias("score")).where("score > 0")
