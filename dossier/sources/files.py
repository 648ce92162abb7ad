"""Files: CSV imports with header aliases, feeds, JSON records."""

from __future__ import annotations

import re

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.mining import mentions

#: Characters of a summary.
SUMMARY = 800

# The names under which imported columns may come.
ALIASES = {
    "name": ["name", "full name", "faculty name"],
    "institution": ["institution", "institute", "university", "organisation", "organization"],
    "department": ["department", "dept"],
    "title": ["title", "designation", "role", "position"],
    "email": ["email", "e mail", "email address"],
    "orcid": ["orcid", "orcid id"],
    "profile_url": ["profile url", "profile", "url", "link"],
    "keywords": ["keywords", "expertise", "research interests"],
    "phone": ["phone", "telephone", "mobile"],
    "website": ["website", "homepage", "web"],
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted cells may hold commas, quotes and line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False)


def by_alias(df: DataFrame, needed: tuple[str, ...] = ("name", "institution"), aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """The known columns under their own names, the first alias that is there; rows without what is needed go, empty cells are null."""
    plain = {c.replace("﻿", "").replace("_", " ").replace("-", " ").strip().lower(): c for c in reversed(df.columns)}
    out = []
    for name, others in aliases.items():
        hit = next((plain[a] for a in others if a in plain), None)
        out.append((F.nullif(F.trim(F.col(f"`{hit}`")), F.lit("")) if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out).dropna(subset=list(needed))


#: An ampersand that begins no character reference that XML knows.
_AMPERSAND = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)")


def _parts(xml: str) -> tuple[list[ElementTree.Element], str | None]:
    """The items of a feed and what is wrong with it. Bare ampersands and names of characters that XML doesn't know are read as text; of a feed that breaks off, the items before that are kept."""
    for text in (xml, _AMPERSAND.sub("&amp;", xml)):
        parser, found = ElementTree.XMLPullParser(["end"]), []
        try:
            parser.feed(text.lstrip())
            parser.close()
            problem = None
        except ElementTree.ParseError as e:
            problem = str(e)
        try:
            found = [e for _, e in parser.read_events() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1].lower() in ("item", "entry")]
        except ElementTree.ParseError as e:
            problem = str(e)
        if problem is None:
            return found, None
    return found, problem


def _entries(xml: str | None, limit: int) -> list[tuple]:
    """title, link, summary, date of the items of a feed. Only elements of the item's own namespace count, so what other vocabularies add (such as media:title) takes no part's place."""
    text = lambda e: " ".join(" ".join(e.itertext()).split()) if e is not None else None
    out = []
    for item in _parts(xml or "")[0][:limit]:
        space = item.tag[: item.tag.rindex("}") + 1] if "}" in item.tag else ""
        parts: dict[str, ElementTree.Element] = {}
        for e in item.iter():
            if isinstance(e.tag, str) and e.tag.startswith(space) and "}" not in e.tag[len(space) :]:
                parts.setdefault(e.tag[len(space) :].lower(), e)
        first = lambda *names, parts=parts: next((parts[n] for n in names if n in parts), None)
        if title := text(first("title")):
            link = first("link")
            href = (link.get("href") or text(link)) if link is not None else None
            out.append((title, href or None, (text(first("description", "summary", "content")) or "")[:SUMMARY] or None, text(first("pubdate", "published", "updated"))))
    return out


def unread_feeds(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key and problem of feeds that couldn't be read to their end, mended or not."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["k"], pa.array([_parts(x or "")[1] for x in b["x"].to_pylist()], pa.string())], names=["k", "problem"])

    rows = feeds.select(F.col(key).alias("k"), F.col(xml).alias("x")).where(F.coalesce(F.trim("x"), F.lit("")) != "")
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, problem string").where("problem is not null").withColumnRenamed("k", key)


def feed_items(feeds: DataFrame, key: str, xml: str, limit: int = 30) -> DataFrame:
    """key, position, title, link, summary, published, names (after titles) of the items of RSS and Atom feeds; items without a title go."""
    kind = "array<struct<title:string,link:string,summary:string,date:string>>"

    def run(batches):
        for b in batches:
            items = [[dict(zip(("title", "link", "summary", "date"), e, strict=True)) for e in _entries(x, limit)] for x in b["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(items, pa.list_(pa.struct([(n, pa.string()) for n in ("title", "link", "summary", "date")])))], names=["k", "items"])

    rows = feeds.select(F.col(key).alias("k"), F.col(xml).alias("x"))
    items = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, items {kind}").select(F.col("k").alias(key), F.posexplode("items").alias("position", "x"))
    mailed = F.try_to_timestamp(F.regexp_replace("x.date", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    named = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("x.date", r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    names = mentions(F.concat_ws(". ", "x.title", F.coalesce("x.summary", F.lit(""))))
    return items.select(key, "position", "x.title", "x.link", "x.summary", F.coalesce(mailed, named, F.try_to_timestamp("x.date")).alias("published"), names.alias("names"))
