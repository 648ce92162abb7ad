"""Keys, spellings and cells of text as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before names (two lists), words that say nothing about an institution, short words in department names.
TITLES = "dr|prof|professor|mr|mrs|ms|miss|sir|dame|assoc|asst"
SHORT_TITLES = "dr|prof|professor|mr|mrs|ms|shri|smt"
INSTITUTION_NOISE = "the|of|at|university|univ|college|institute|inst|school|dept|department|laboratory|lab|center|centre"
SMALL_WORDS = ["and", "of", "for", "in", "the"]
# Short names of campuses as they stand in names of units, each with its full form; as whole words, in this order, in capitals but for Goa.
CAMPUSES = [
    ("IITB", "Indian Institute of Technology Bombay"),
    ("IITD", "Indian Institute of Technology Delhi"),
    ("IITM", "Indian Institute of Technology Madras"),
    ("IITK", "Indian Institute of Technology Kanpur"),
    (r"IIT\s?KGP", "Indian Institute of Technology Kharagpur"),
    ("IITR", "Indian Institute of Technology Roorkee"),
    ("IITG", "Indian Institute of Technology Guwahati"),
    ("IITH", "Indian Institute of Technology Hyderabad"),
    (r"IIT\s?BHU", "Indian Institute of Technology BHU"),
    ("IITI", "Indian Institute of Technology Indore"),
    ("IITJ", "Indian Institute of Technology Jodhpur"),
    ("IITGN", "Indian Institute of Technology Gandhinagar"),
    ("IITRPR", "Indian Institute of Technology Ropar"),
    ("IITP", "Indian Institute of Technology Patna"),
    ("IITBBS", "Indian Institute of Technology Bhubaneswar"),
    ("IITPKD", "Indian Institute of Technology Palakkad"),
    ("IITTP", "Indian Institute of Technology Tirupati"),
    ("IITDH", "Indian Institute of Technology Dharwad"),
    (r"(?i:IIT\s?GOA)", "Indian Institute of Technology Goa"),
    ("NITK", "National Institute of Technology Karnataka"),
    ("NITT", "National Institute of Technology Tiruchirappalli"),
    ("NITW", "National Institute of Technology Warangal"),
    ("NITC", "National Institute of Technology Calicut"),
    ("NITR", "National Institute of Technology Rourkela"),
    ("MNIT", "Malaviya National Institute of Technology Jaipur"),
    ("VNIT", "Visvesvaraya National Institute of Technology"),
    ("SVNIT", "Sardar Vallabhbhai National Institute of Technology Surat"),
    ("MANIT", "Maulana Azad National Institute of Technology"),
    ("MNNIT", "Motilal Nehru National Institute of Technology"),
]
#: Abbreviations of institutions, each with its full form; applied in this order, as whole words.
ABBREVIATIONS = [
    ("IIIT", "Indian Institute of Information Technology"),
    ("IIT", "Indian Institute of Technology"),
    ("NIT", "National Institute of Technology"),
    ("IISc", "Indian Institute of Science"),
    ("IISER", "Indian Institute of Science Education and Research"),
]

_accented = {c: b for c in map(chr, range(0xC0, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Without accents, in lower case. Letters up to U+024F are unaccented by a table, combining marks go."""
    bare = F.translate(col(c), "".join(_accented), "".join(_accented.values()))
    return F.lower(F.regexp_replace(bare, "[̀-ͯ]", ""))


def once(c: Column, f) -> Column:
    """f(c), where f reads c in several places and c is costly: it is worked out once a row."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ﻿]+", " "))


def name_key(c: Column | str) -> Column:
    """Tokens of a name in alphabetical order, without one leading title and without punctuation."""
    text = F.regexp_replace(F.translate(fold(c), ",", " "), rf"^({TITLES})\.?\s+", "")
    tokens = F.split(squeeze(F.regexp_replace(text, r"[^a-z0-9\s]", "")), " ")
    return F.array_join(F.array_sort(F.filter(tokens, lambda t: t != "")), " ")


def ordered_name_key(c: Column | str) -> Column:
    """Tokens of a name in their order; punctuation parts words."""
    text = F.regexp_replace(fold(c), rf"^({SHORT_TITLES})\.?\s+", "")
    return squeeze(F.regexp_replace(text, r"[^a-z0-9\s]", " "))


def short_name_keys(c: Column | str) -> Column:
    """Initial of one end and the other end whole, if that has three letters at least: both ways, distinct."""

    def keys(t: Column) -> Column:
        first, last = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(-1))
        pair = lambda whole, other: F.when((F.size(t) >= 2) & (F.length(whole) >= 3), F.concat(F.substring(other, 1, 1), F.lit(" "), whole))
        return F.array_distinct(F.array_compact(F.array(pair(last, first), pair(first, last))))

    return once(F.filter(F.split(ordered_name_key(c), " "), lambda x: x != ""), keys)


def name_tokens(c: Column | str) -> Column:
    """Words of a name in their order, without titles."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "), " "), lambda t: (t != "") & ~t.isin("dr", "prof", "mr", "ms", "mrs"))


def same_person(a: Column, b: Column) -> Column:
    """Whether two lists of name tokens may name one person: the last ones equal, and the first ones equal, one the other's initial, or any other word shared. Null and empty lists fit nobody."""
    end = F.lit(-1)
    first = lambda t: F.try_element_at(t, F.lit(1))
    initial = lambda x, y: (F.length(x) == 1) & F.startswith(y, x)
    rest = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    close = (first(a) == first(b)) | initial(first(a), first(b)) | initial(first(b), first(a)) | F.arrays_overlap(rest(a), rest(b))
    return F.coalesce((F.try_element_at(a, end) == F.try_element_at(b, end)) & close, F.lit(False))


def institution_key(c: Column | str) -> Column:
    """What tells an institution from others; null if nothing does."""
    text = F.regexp_replace(fold(c), r"[^a-z0-9\s]", " ")
    return F.nullif(squeeze(F.regexp_replace(text, rf"\b({INSTITUTION_NOISE})\b", " ")), F.lit(""))


def expanded(c: Column | str, abbreviations: list[tuple[str, str]] = ABBREVIATIONS, campuses: list[tuple[str, str]] = CAMPUSES) -> Column:
    """Names with their short forms written out: campuses first. Each kind is looked for only where a name may hold one."""
    out = col(c)
    for short, full in campuses:
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", full)
    out = F.when(col(c).rlike(r"(?i)NIT|IIT"), out).otherwise(col(c))

    def written_out(name: Column) -> Column:
        full_name = name
        for short, full in abbreviations:
            full_name = F.regexp_replace(full_name, rf"(?i)(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", full)
        return F.when(name.rlike("(?i)" + "|".join(short for short, _ in abbreviations)), full_name).otherwise(name)

    return once(out, written_out)


def expanded_institution_key(c: Column | str) -> Column:
    return institution_key(expanded(c))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_department(c: Column | str) -> Column:
    """One spelling of a department: no brackets, no "Department of", "and" for &, capitals as in a title, short acronyms as they are."""
    text = F.regexp_replace(col(c), r"\(.*?\)", " ")
    text = F.regexp_replace(text, r"(?i)^\s*(department|dept\.?|school|centre|center|division)\s+(of|for)\s+", "")
    text = squeeze(F.regexp_replace(text, r"\s*&\s*", " and "))

    def word(w: Column, k: Column) -> Column:
        low = F.lower(w)
        return F.when((F.length(w) <= 4) & (w == F.upper(w)), w).when((k > 0) & low.isin(SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, 2, 1 << 20)))

    return F.when(F.coalesce(text, F.lit("")) == "", "(none)").otherwise(F.array_join(F.transform(F.split(text, " "), word), " "))


def csv_cell(c: Column | str, guard: bool = True) -> Column:
    """One line, no formula, quotes where they are needed; a missing value is an empty cell."""
    text = F.trim(F.regexp_replace(col(c).cast("string"), r"\s*\r?\n\s*", " "))
    safe = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text) if guard else text
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike('[",]'), quoted).otherwise(safe), F.lit(""))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def content_hash(*lists: Column) -> Column:
    """32 hex digits of what the lists hold, whatever their order."""
    return F.substring(F.sha2(F.concat_ws("::", *(F.array_join(F.array_sort(x), "|") for x in lists)), 256), 1, 32)


def around(text: Column, at: Column, size: Column, margin: int = 60) -> Column:
    """The text around a place (from 1), with dots where it goes on; null where the place is 0."""
    begin = F.greatest(F.lit(1), at - margin)
    end = F.least(F.length(text), at + size - 1 + margin)
    middle = squeeze(F.substring(text, begin, end - begin + 1))
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), middle, F.when(end < F.length(text), "…").otherwise("")))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])[ \t\r\n\f]+")


def summary(text: Column, least: int = 20, many: int = 2, limit: int = 900) -> Column:
    """The first sentences of some length."""
    return F.substring(F.array_join(F.slice(F.filter(sentences(text), lambda s: F.length(F.trim(s)) > least), 1, many), " "), 1, limit)


def short_id(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def year(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(19|20)\d\d", 0).try_cast("int")


def from_inverted_index(index: Column) -> Column:
    """Text from a map of words to their places."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")
