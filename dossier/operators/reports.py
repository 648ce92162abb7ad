"""Counts, votes and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.functions.text import csv_cell
from dossier.operators.lists import models_by_brand


def facet_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """facet, value, n for each field, in one pass; missing values count as (none)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("(none)")).alias("value")) for f in fields))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def tallies(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Of each group how many rows meet each condition."""
    return df.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def vote(df: DataFrame, by: str, choice: Column, weight: Column, otherwise: str, share: float) -> DataFrame:
    """The choice with the most weight in each group if that is a share of all weights; `otherwise` never wins over a choice, and ties go to the smaller one."""
    sums = df.groupBy(by, choice.alias("choice")).agg(F.sum(weight).alias("w"))
    real = F.col("choice") != otherwise
    best = F.min(F.when(real, F.struct((-F.col("w")).alias("w"), "choice")))
    out = sums.groupBy(by).agg(best.alias("best"), F.sum("w").alias("total")).select(by, F.col("best.choice").alias("winner"), (-F.col("best.w")).alias("votes"), "total")
    return out.select(by, F.when(F.col("votes") >= share * F.col("total"), F.col("winner")).otherwise(otherwise).alias("winner"), "total")


def flat_export(df: DataFrame, columns: dict[str, Column], guard: bool = True) -> DataFrame:
    """One CSV line a row, in `line`, under the names of the columns."""
    return df.select(F.concat_ws(",", *(csv_cell(c, guard) for c in columns.values())).alias("line"))


def sheets(df: DataFrame, keys: Column) -> DataFrame:
    """df with `sheet`: a row for each key it has."""
    return df.withColumn("sheet", F.explode(F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("(none)")))))


def sheet_names(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """sheet, n, name: names of 31 characters without signs that a workbook can't have, the largest sheet first; equal ones get a number."""
    from pyspark.sql import Window as W

    counts = df.groupBy(sheet).agg(F.count("*").alias("n"))
    named = counts.withColumn("name", F.substring(F.regexp_replace(F.col(sheet), r"[\\/*?:\[\]]", "-"), 1, 31))
    again = F.row_number().over(W.partitionBy(F.lower("name")).orderBy(F.desc("n"), sheet))
    return named.withColumn("name", F.when(again == 1, F.col("name")).otherwise(F.concat(F.substring("name", 1, 27), F.lit(" ("), again, F.lit(")")))).orderBy(F.desc("n"), sheet)


def roster_columns(own_vendor: str = "own", own_label: str = "Own") -> dict[str, Column]:
    """The columns of a roster export under their headers, in their order, from columns name, title, role, department, domain, institution, discovered_name, affiliation (struct of status, source, verified_at,
    previous), outside_target, email, phone, website, profile_url, orcid, author_id, score, instruments (array of struct brand, model, vendor), topics, works, h_index, sources, status, tags, reasoning."""
    c = F.col
    joined = lambda items: F.array_join(F.array_distinct(items), "; ")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in rules.DOMAIN_LABELS.items() for x in kv)), c("domain"))
    named = F.transform(F.filter("instruments", lambda i: F.coalesce(i["model"], F.lit("")) != ""), lambda i: F.concat_ws(" ", i["brand"], i["model"]))
    own = F.when(F.exists("instruments", lambda i: F.coalesce(i["vendor"] == own_vendor, F.lit(False))), "yes").otherwise("")
    return {
        "Name": c("name"), "Title": c("title"), "Role": c("role"), "Department": c("department"), "Domain": label, "Institute": c("institution"), "Discovered at": c("discovered_name"), "Affiliation status": F.coalesce("affiliation.status", F.lit("unverified")),
        "Affiliation source": c("affiliation.source"), "Affiliation checked": F.date_format("affiliation.verified_at", "yyyy-MM-dd"), "Previous institution": c("affiliation.previous"), "Outside target list": F.when(c("outside_target"), "yes").otherwise(""),
        "Email": c("email"), "Phone": c("phone"), "Website": c("website"), "Profile": c("profile_url"), "ORCID": c("orcid"), "OpenAlex": c("author_id"), "Relevance": c("score"),
        "Instrument brands": joined(F.transform("instruments", lambda i: i["brand"])), "Instrument models": joined(named), f"{own_label} customer": own, "Topics": F.array_join(F.slice("topics", 1, 8), "; "), "Works": c("works"), "h-index": c("h_index"),
        "Sources": joined(c("sources")), "Status": c("status"), "Tags": F.array_join("tags", "; "), "Score reasoning": c("reasoning"),
    }


def roster_cell(c: Column) -> Column:
    """A cell of the roster: as it is, in quotes where it has a comma, a quote or a line end; formulas are left as they are."""
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def roster_export(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One line of the roster a row, in `line`. The format csv_files of sources.targets writes the same columns as files with their header."""
    return df.select(F.concat_ws(",", *map(roster_cell, columns.values())).alias("line"))


def write_csv(df: DataFrame, columns: dict[str, Column], folder: str, guard: bool = True) -> None:
    """Part files of CRLF lines; the header is the caller's, as a file of its own."""
    flat_export(df, columns, guard).write.option("lineSep", "\r\n").text(folder)


def write_sheets(df: DataFrame, keys: Column, folder: str) -> None:
    sheets(df, keys).write.partitionBy("sheet").parquet(folder)


def lead_columns(own_vendor: str = "own", own_label: str = "Own") -> dict[str, Column]:
    """The columns of a lead export under their headers, in their order, from columns name, title, email, phone, website, institution, affiliation (struct of status, directory_listed, previous, source,
    verified_at), department, country, status, instruments (array of struct brand, model, vendor), products, topics, summary, publications (titles), profile_url, orcid, source, source_url, discovered_at,
    created_at, reviewed_by, reviewed_at, tags. Entry N of the brands and of the models belong together; a brand without a model has an empty place."""
    c = F.col
    joined = lambda items: F.array_join(items, "; ")
    when = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    status = F.when(c("affiliation").isNull(), "unverified").when(~F.coalesce(c("affiliation.directory_listed"), F.lit(True)) & (c("affiliation.status") == "current"), "current (not in directory)").otherwise(c("affiliation.status"))
    brands = models_by_brand(c("instruments"))
    has = lambda vendor: F.when(F.exists("instruments", lambda i: F.coalesce(i["vendor"] == vendor, F.lit(False))), "yes").otherwise("no")
    return {
        "Name": c("name"), "Title": c("title"), "Email": c("email"), "Phone": c("phone"), "Lab website": c("website"), "Institution": c("institution"), "Affiliation status": status, "Previous institution": c("affiliation.previous"),
        "Affiliation source": c("affiliation.source"), "Affiliation checked": when("affiliation.verified_at"), "Department": c("department"), "Country": c("country"), "Status": c("status"),
        "Instrument brand": joined(F.transform(brands, lambda b: b["brand"])), "Instrument model": joined(F.transform(brands, lambda b: F.array_join(b["models"], " / "))), f"{own_label} brand user": has(own_vendor),
        "Competitor user": has("competitor"), "Recommended products": joined("products"), "Research topics": joined("topics"), "Research summary": c("summary"), "Recent publications": joined(F.array_distinct("publications")),
        "Profile URL": c("profile_url"), "ORCID": c("orcid"), "Source": c("source"), "Source URL": c("source_url"), "Discovered": when("discovered_at"), "Added": when("created_at"), "Reviewed by": c("reviewed_by"),
        "Reviewed at": when("reviewed_at"), "Tags": joined("tags"),
    }
