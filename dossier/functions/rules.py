"""Rules that classify titles, departments and topics: ordered patterns as data, compiled into CASE columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import squeeze

# Patterns of titles, the kinds in the order in which they are tried.
FELLOWSHIPS = [r"\binspire\s+faculty\b", r"\bramanujan\s+fellow", r"\bramalingaswami\b", r"\bdst[\s-]+fellow", r"\bswarnajayanti\b", r"\bj\.?\s?c\.?\s?bose\b"]
STUDENTS = [
    r"\bph\.?\s?d\b", r"\bdoctoral\b", r"\bstudent\b", r"\bscholar\b", r"\bpost[\s-]?doc(toral)?\b", r"\bresearch associate\b", r"\bresearch assistant\b", r"\bteaching assistant\b",
    r"\bproject\s+(\w+\s+){0,2}(fellow|associate|assistant|staff|scientist|engineer|intern|manager|officer)\b", r"\b(junior|senior)\s+research\s+fellow\b", r"\b[js]rf\b", r"\bintern(ship)?\b",
    r"\btrainee\b", r"\b(m\.?\s?tech|m\.?\s?sc|m\.?\s?s|b\.?\s?tech|b\.?\s?sc|m\.?\s?phil)\b", r"\bcandidate\b", r"\bgraduate\b", r"\bundergraduate\b",
]
ADJUNCTS = [r"\b(former|retired|superannuated|ex)[\s-]+(professor|faculty|scientist|director|head)\b", r"\badjunct\b", r"\bvisiting\b", r"\bguest\b", r"\bhonorary\b", r"\baffiliate(d)?\s+(faculty|professor)\b"]
PROFESSORS = [r"\bprofessor\b", r"\bprof\.?\b", r"\bemerit(us|a)\b", r"\breader\b", r"\blecturer\b", r"\bfaculty\b", r"\bdean\b", r"\bhead\b", r"\bhod\b", r"\bchair(person|man|woman)?\b", r"\bdirector\b", r"\bprincipal investigator\b"]
SCIENTISTS = [r"\bscientist\b", r"\bresearcher\b", r"\bresearch\s+(engineer|lead|leader|manager)\b", r"\binvestigator\b"]
OFFICERS = [r"\bscientific\s+officer\b", r"\bresearch\s+officer\b", r"\btechnical\s+officer\b", r"\blab(oratory)?\s*(in[\s-]?charge|manager|head|superintendent)\b", r"\bin[\s-]?charge\b", r"\bengineer\b"]
FACULTY_ROLES = ["professor", "scientist", "officer", "fellow", "inferred"]
ROLE_RANK = {"excluded": 6, "professor": 5, "scientist": 4, "officer": 3, "fellow": 3, "inferred": 1, "unknown": 0}
#: Patterns of department names and their domains, in the order in which they are tried.
DEPARTMENTS = [
    (r"\bdbeb\b", "biochemical_engineering"),
    (r"\b(bsbe|bsse|dbs)\b", "biology"),
    (r"\b(mems|mme|memse)\b", "materials"),
    (r"\b(ese|dese)\b", "energy"),
    (r"\bche\b", "chemical_engineering"),
    (r"\bbio-?chemical\s+eng", "biochemical_engineering"),
    (r"\bchemical\s+(and\s+bio\w*\s+)?eng", "chemical_engineering"),
    (r"\bchemical\s+(sciences?|technology)\b", "chemistry"),
    (r"\bchemistry\b", "chemistry"),
    (r"\bbio-?technolog", "biotechnology"),
    (r"\bbio-?(medical|engineering|sciences?\s+and\s+bio-?engineering)\b", "biotechnology"),
    (r"\bbio-?engineering\b", "biotechnology"),
    (r"\bbio-?chemistry\b", "biology"),
    (r"\b(biolog|bio-?sciences?|life\s+sciences?|biological\s+sciences?|microbiolog|zoolog|botan|neuroscience|genetics|molecular)", "biology"),
    (r"\b(metallurg|materials?\b|nano-?(science|technology|materials?)|ceramic|polymer\s+(science|engineering|technology))", "materials"),
    (r"\b(energy|solar|photovoltaic|battery|hydrogen|fuel\s+cell|electrochem)", "energy"),
    (r"\b(electrical|electronics?|ee|ece|eee)\b", "electrical"),
    (r"\b(civil|structural|construction|infrastructure|ocean\s+eng|coastal)\b", "civil"),
    (r"\b(mechanical|manufactur|production\s+eng|industrial\s+eng|automobile)\b", "mechanical"),
]
TOPIC_SHARE = 0.4
#: Domains that are kept, those that need a term on corrosion, departments that are known and not kept.
KEPT = ["chemistry", "biology", "biotechnology", "chemical_engineering", "biochemical_engineering", "materials", "energy", "electrical"]
GATED = ["civil", "mechanical"]
#: How the domains are called in reasons.
DOMAIN_LABELS = {
    "chemistry": "Chemistry", "biology": "Biology", "biotechnology": "Biotechnology", "chemical_engineering": "Chemical Engineering", "biochemical_engineering": "Biochemical Engineering", "materials": "Materials / Metallurgy",
    "energy": "Energy", "electrical": "Electrical Engineering", "civil": "Civil Engineering (corrosion)", "mechanical": "Mechanical Engineering (corrosion)", "other": "Other",
}
NOT_KEPT = [
    r"\bphysics\b", r"\b(computer|computing|informatics|information technology|data science|artificial intelligence)\b", r"\b(communication|instrumentation|control)\b", r"\b(mathematic|statistic)",
    r"\b(humanities|social|economics|management|business|liberal arts|linguistics|philosophy|design school|industrial design|education)\b",
    r"\b(aerospace|aeronautic|ocean|naval|earth science|geolog|geophysic|atmospher|climate|mining|petroleum|textile|agricultur|food)\b",
]
#: Patterns of topic names and their domains, in the order in which they are tried.
TOPICS = [
    (r"\b(nuclear|particle|high[-\s]energy|astro\w*|cosmolog|gravitation|quantum\s+(field|chromo)|plasma\s+physics|string\s+theory)\b", "other"),
    (r"\bbiochemical\s+engineering\b", "biochemical_engineering"),
    (r"\bchemical\s+engineering\b", "chemical_engineering"),
    (r"\belectrochemistry\b", "chemistry"),
    (r"\bchemistry\b", "chemistry"),
    (r"\bbiotechnology\b", "biotechnology"),
    (r"\bbiomedical\s+engineering\b", "biotechnology"),
    (r"\bbioengineering\b", "biotechnology"),
    (r"\b(biochemistry|genetics|molecular\s+biology|immunology|microbiology|biological\s+sciences|agricultural\s+and\s+biological|neuroscience|cell\s+biology|pharmacolog)", "biology"),
    (r"\b(materials?\s+(science|chemistry)|metals?\s+and\s+alloys|ceramics|polymers|nanotechnology|surfaces|electronic,?\s+optical)", "materials"),
    (r"\b(energy|fuel\s+technology|renewable|electrochemical\s+energy)\b", "energy"),
    (r"\b(electrical\s+and\s+electronic|electronic,?\s+optical\s+and\s+magnetic|signal\s+processing|hardware\s+and\s+architecture)\b", "electrical"),
    (r"\b(civil\s+and\s+structural|building\s+and\s+construction|geotechnical|ocean\s+engineering)\b", "civil"),
    (r"\b(mechanical\s+engineering|mechanics\s+of\s+materials|industrial\s+and\s+manufacturing|automotive)\b", "mechanical"),
]
#: Terms that open the gate for electrochemical work, those that do so alone, and terms on corrosion.
ELECTRO_TERMS = ["electrochem", "potentiostat", "galvanostat", "voltammetr", "impedance spectroscopy", "electroanalytical", "biosensor", "electrocatal", "photoelectrochem", "battery", "batteries", "supercapacitor", "fuel cell", "electrolys", "electrolyzer", "electrodeposition", "corrosion", "electrode"]
STRONG_TERMS = ["potentiostat", "galvanostat", "voltammetr", "electroanalytical", "impedance spectroscopy"]
CORROSION_TERMS = [
    "corrosion", "corrosive", "anti-corrosion", "anticorrosion", "cathodic protection", "anodic protection", "rebar", "reinforcement corrosion", "chloride ingress", "chloride penetration", "carbonation",
    "concrete durability", "durability of concrete", "passivation", "passive film", "pitting", "galvanic", "coating degradation", "protective coating", "inhibitor", "electrochemical", "impedance spectroscopy",
    "polarization", "polarisation", "biofouling", "microbiologically influenced", "stress corrosion", "hydrogen embrittlement", "erosion-corrosion", "tribocorrosion",
]
GATE_TERMS, GATE_WORKS = 2, 3

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def pattern(p: str) -> str:
    r"""Without case, with \b at the edges of ASCII words only."""
    return "(?i)" + p.replace(r"\b", _EDGE)


def any_pattern(patterns: list[str]) -> str:
    return pattern("|".join(f"(?:{p})" for p in patterns))


def first_of(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first pattern that is found."""
    out = F
    for p, value in rules:
        out = out.when(text.rlike(pattern(p)), value)
    return out.otherwise(otherwise)


def role(title: Column) -> Column:
    """struct(category, matched) of a title. Fellowships of faculty rank come first, then students and guests, who are excluded."""
    t = squeeze(F.coalesce(title, F.lit("")))
    kinds = [("fellow", FELLOWSHIPS), ("excluded", STUDENTS), ("excluded", ADJUNCTS), ("professor", PROFESSORS), ("scientist", SCIENTISTS), ("officer", OFFICERS)]
    category, matched = F, F
    for name, patterns in kinds:
        on = t.rlike(any_pattern(patterns))
        if name == "fellow":
            on = on & ~t.rlike(r"(?i)post[\s-]?doctoral")
        category = category.when(on, name)
        for p in patterns:
            matched = matched.when(on & t.rlike(pattern(p)), F.regexp_extract(t, pattern(p), 0))
    return F.struct(category.otherwise("unknown").alias("category"), matched.otherwise(None).alias("matched"))


def excluded_match(title: Column) -> Column:
    """The words of a title that exclude somebody: those of students first."""
    t = squeeze(F.coalesce(title, F.lit("")))
    return F.coalesce(*(F.nullif(F.regexp_extract(t, pattern(p), 0), F.lit("")) for p in [*STUDENTS, *ADJUNCTS]))


def department_domain(department: Column) -> Column:
    return first_of(F.trim(F.coalesce(department, F.lit(""))), DEPARTMENTS, "other")


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that a text holds, whatever the case, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def _works(topic: Column) -> Column:
    return F.when(topic["count"] > 0, topic["count"]).otherwise(1).cast("long")


VOTES = "array<struct<domain:string,n:bigint>>"


def topic_votes(topics: Column) -> Column:
    """Domain and works of each topic of array<struct(name, count, subfield, field)>: the subfield's domain, else the field's, else the name's."""

    def own(t: Column) -> Column:
        return F.coalesce(*(F.when(F.coalesce(t[part], F.lit("")) != "", first_of(t[part], TOPICS, None)) for part in ("subfield", "field", "name")), F.lit("other"))

    return F.coalesce(F.transform(topics, lambda t: F.struct(own(t).alias("domain"), _works(t).alias("n"))), F.array().cast(VOTES))


def voted_domain(votes: Column) -> Column:
    """The domain with the most works if it has its share of all; the one seen first among equals, never `other`."""
    count = lambda vs: F.aggregate(vs, F.lit(0).cast("long"), lambda s, v: s + v["n"])
    named = F.filter(F.array_distinct(F.transform(votes, lambda v: v["domain"])), lambda d: d != "other")
    sums = F.transform(named, lambda d: F.struct(count(F.filter(votes, lambda v: v["domain"] == d)).alias("n"), d.alias("domain")))
    best = F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("n"), F.lit("other").alias("domain")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return F.aggregate(F.array(best), F.lit("other"), lambda s, b: F.when(b["n"] >= TOPIC_SHARE * count(votes), b["domain"]).otherwise(s))


def with_domain(df: DataFrame, department: Column, topics: Column, text: Column, name: str = "decision") -> DataFrame:
    """df with struct(domain, kept, gate, terms). A known department decides, topics speak only for an unknown one; some domains need a term on corrosion, all others electrochemical work.

    What patterns find is in columns of its own, one after another, so each runs once a row."""
    on_topic = F.filter(topics, lambda t: F.concat_ws(" ", t["subfield"], t["name"]).rlike("(?i)electrochem"))
    works = F.coalesce(F.aggregate(on_topic, F.lit(0).cast("long"), lambda s, t: s + _works(t)), F.lit(0))
    found = {"__stated": department_domain(department), "__votes": topic_votes(topics), "__corrosion": terms_in(text, CORROSION_TERMS), "__electro": terms_in(text, ELECTRO_TERMS), "__works": works}
    found["__refused"] = F.trim(F.coalesce(department, F.lit(""))).rlike(any_pattern(NOT_KEPT))
    corrosion, electro, many = F.col("__corrosion"), F.col("__electro"), F.col("__works") >= GATE_WORKS
    voted = F.when((F.col("__stated") != "other") | F.col("__refused"), F.col("__stated")).otherwise(voted_domain(F.col("__votes")))
    domain, gate = F.col("__domain"), F.col("__gate")
    opened = (F.size(electro) >= GATE_TERMS) | F.arrays_overlap(electro, F.array(*map(F.lit, STRONG_TERMS))) | many
    opens = F.when(domain.isin(GATED) & (F.size(corrosion) > 0), "corrosion").when(~domain.isin(KEPT + GATED) & opened, "electrochemistry")
    by_works = F.when(many & ~F.array_contains(electro, "electrochem"), F.array_prepend(electro, "electrochemistry topics")).otherwise(electro)
    terms = F.when(gate == "corrosion", corrosion).when(gate == "electrochemistry", by_works)
    out = F.struct(domain.alias("domain"), (domain.isin(KEPT) | gate.isNotNull()).alias("kept"), gate.alias("gate"), terms.alias("terms"))
    return df.withColumns(found).withColumn("__domain", voted).withColumn("__gate", opens).withColumn(name, out).drop(*found, "__domain", "__gate")


def domain_reason(domain: Column, department: Column) -> Column:
    """Why a domain isn't kept."""
    label = F.element_at(F.create_map(*(F.lit(x) for kv in DOMAIN_LABELS.items() for x in kv)), domain)
    gated = F.concat(F.lit("domain: "), label, F.lit(" without corrosion-related work"))
    return F.when(domain.isin(GATED), gated).when(F.coalesce(department, F.lit("")) != "", F.concat(F.lit("domain: "), department)).otherwise("domain: outside the kept departments")


def strongest_role(roles: Column) -> Column:
    """The element that an array of struct(seq, source, category, more) comes to, in order of seq. A page's faculty title stands against an exclusion from elsewhere; else the higher rank, the earlier one among equals."""
    page = lambda r: r["source"].isin("faculty_page", "registry")
    faculty = lambda r: r["category"].isin("professor", "scientist", "officer", "fellow")
    rank = lambda r: F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_RANK.items() for x in kv)), r["category"])

    def step(a: Column, b: Column) -> Column:
        keep = page(a) & faculty(a) & (b["category"] == "excluded") & ~page(b)
        take = page(b) & faculty(b) & (a["category"] == "excluded") & ~page(a)
        return F.when(keep, a).when(take | (rank(b) > rank(a)), b).otherwise(a)

    ordered = F.array_sort(roles)
    return F.aggregate(F.slice(ordered, 2, 1 << 20), F.try_element_at(ordered, F.lit(1)), step)


def stronger_role(roles: Column) -> Column:
    return strongest_role(roles)["category"]


def seniority(works: Column, h: Column, first: Column, last: Column, years_here: Column, name: Column, as_of_year: int) -> Column:
    """Whether a publication record alone speaks for an established researcher at this place."""
    here = F.array_distinct(F.coalesce(years_here, F.array().cast("array<int>")))
    spelled = F.length(F.replace(F.get(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), F.lit(0)), F.lit("."), F.lit(""))) >= 3
    record = (F.coalesce(works, F.lit(0)) >= 15) & (F.coalesce(h, F.lit(0)) >= 8) & (F.coalesce(as_of_year - first, F.lit(0)) >= 8)
    return record & (F.coalesce(last, F.lit(0)) >= as_of_year - 2) & (F.size(here) >= 4) & F.exists(here, lambda y: y >= as_of_year - 2) & spelled
