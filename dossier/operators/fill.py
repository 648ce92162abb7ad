"""Gaps of leads filled from what people say of themselves and from captured pages, mirrored onto roster members, and both tables written as one version or not at all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.functions.text import expanded_institution_key
from dossier.operators import lists

#: Fields that may be filled, in the order in which they are told.
FIELDS = ["email", "title", "department", "phone", "website"]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def missing(prefix: str = "") -> Column:
    """The names of the FIELDS that a record lacks."""
    return F.array_compact(F.array(*(F.when(blank(f"{prefix}{f}"), F.lit(f)) for f in FIELDS)))


def _own(leads: DataFrame, persons: DataFrame, employments: DataFrame) -> DataFrame:
    """leads with __o: what their ORCID records tell: first address, first site of their own, and role and department of the first open employment at their institution."""
    site = F.get(F.filter("urls", lambda u: lists.own_site(u["url"])), F.lit(0))["url"]
    p = persons.select("orcid", F.get("emails", F.lit(0)).alias("__email"), site.alias("__site"))
    asked = leads.select("lead_id", "orcid", expanded_institution_key("institution").alias("__a"))
    jobs = employments.where("current").select("orcid", "seq", "role", "department", expanded_institution_key("organization").alias("__b")).join(asked.where("orcid is not null and __a <> ''"), "orcid")
    here = jobs.where((F.col("__b") != "") & (F.contains("__a", F.col("__b")) | F.contains("__b", F.col("__a")))).groupBy("lead_id").agg(F.min(F.struct("seq", "role", "department")).alias("__j"))
    title = F.when(rules.role(F.col("__j.role"))["category"] != "excluded", F.nullif(F.col("__j.role"), F.lit("")))
    told = F.struct(F.col("__email").alias("email"), title.alias("title"), F.nullif(F.col("__j.department"), F.lit("")).alias("department"), F.lit(None).cast("string").alias("phone"), F.col("__site").alias("website"))
    return leads.join(p, "orcid", "left").join(here, "lead_id", "left").withColumn("__o", told).drop("__email", "__site", "__j")


def fill_missing(leads: DataFrame, members: DataFrame, persons: DataFrame, employments: DataFrame, web: DataFrame | None = None, promoted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """leads and members after a fill: one row each as before, leads with filled (array of names) and filled_from_web, members with a mirror of their lead where they have gaps.

    Only leads of promoted members are filled; each lead once, however many members point to it. leads: lead_id, orcid, institution, profile_url and FIELDS; members: member_id, status,
    lead_id, profile_url and FIELDS; persons: orcid, emails, urls; employments: orcid, seq, organization, role, department, current; web: lead_id and FIELDS of captured pages, which are
    asked for what is still missing. A value that is there is never changed; blanks count as missing. Several rows of a lead in web or of an ORCID in persons: the first of each field by value."""
    promoted = F.col("status") == "promoted" if promoted is None else promoted
    wanted = members.where(promoted & F.col("lead_id").isNotNull()).select("lead_id").distinct().withColumn("__w", F.lit(True))
    one = persons.groupBy("orcid").agg(F.min("emails").alias("emails"), F.min("urls").alias("urls"))
    rows = _own(leads, one, employments).join(wanted, "lead_id", "left")
    on = F.coalesce("__w", F.lit(False))
    first = {f: F.when(on & blank(f) & F.col(f"__o.{f}").isNotNull(), F.col(f"__o.{f}")) for f in FIELDS}
    rows = rows.withColumn("filled", F.array_compact(F.array(*(F.when(first[f].isNotNull(), F.lit(f)) for f in FIELDS)))).withColumns({f: F.coalesce(first[f], F.col(f)) for f in FIELDS})
    if web is not None:
        found = web.groupBy("lead_id").agg(F.struct(*(F.min(F.nullif(F.trim(f), F.lit(""))).alias(f) for f in FIELDS)).alias("__p"))
        rows = rows.join(found, "lead_id", "left")
    else:
        rows = rows.withColumn("__p", F.struct(*(F.lit(None).cast("string").alias(f) for f in FIELDS)))
    second = {f: F.when(on & blank(f) & F.col(f"__p.{f}").isNotNull(), F.col(f"__p.{f}")) for f in FIELDS}
    rows = rows.withColumn("filled_from_web", F.array_compact(F.array(*(F.when(second[f].isNotNull(), F.lit(f)) for f in FIELDS)))).withColumns({f: F.coalesce(second[f], F.col(f)) for f in FIELDS})
    after = rows.select(*leads.columns, "filled", "filled_from_web")
    mirror = after.select("lead_id", F.struct(*FIELDS, "profile_url").alias("__l"))
    own = members.join(mirror, "lead_id", "left")
    fill = {c: F.when(F.coalesce(promoted, F.lit(False)) & blank(c), F.coalesce(F.nullif(F.col(f"__l.{c}"), F.lit("")), F.col(c))).otherwise(F.col(c)) for c in [*FIELDS, "profile_url"]}
    return after, own.withColumns(fill).select(*members.columns)


def fill_summary(leads: DataFrame, members: DataFrame, promoted: Column | None = None) -> DataFrame:
    """considered, complete, filled_from_orcid, filled_from_web, still_missing_email after a fill: counted over members that were promoted and have a lead."""
    promoted = F.col("status") == "promoted" if promoted is None else promoted
    rows = members.where(promoted).select("member_id", "lead_id").join(leads, "lead_id")
    gaps = F.size(missing()) == 0
    return rows.agg(F.count("*").alias("considered"), F.count_if(gaps).alias("complete"), F.count_if(F.size("filled") > 0).alias("filled_from_orcid"), F.count_if(F.size("filled_from_web") > 0).alias("filled_from_web"), F.count_if(blank("email")).alias("still_missing_email"))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are whole, the newest last."""
    fs, at = _path(spark, f"{folder}/committed")
    return sorted(int(x.getPath().getName()) for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName().isdigit())


def commit(spark: SparkSession, folder: str, keep: int = 2, **tables: DataFrame) -> int:
    """Writes several tables as one version and gives its number. A version counts when its file in `committed` is there, which is put in place by a rename when all tables are written; a run
    that ends before leaves the version before as it was. Versions older than the last `keep` are removed then."""
    known = versions(spark, folder)
    number = (known[-1] if known else 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/version={number}/{name}")
    fs, at = _path(spark, f"{folder}/committed/{number}")
    temporary = _path(spark, f"{folder}/committed/.{number}")[1]
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(sorted(tables)).encode()))
    out.close()
    if not fs.rename(temporary, at):
        raise OSError(f"version {number} can't be put in place")
    for old in known[: -(keep - 1)] if keep > 1 else known:
        fs.delete(_path(spark, f"{folder}/committed/{old}")[1], False)
        fs.delete(_path(spark, f"{folder}/version={old}")[1], True)
    return number


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest whole version."""
    known = versions(spark, folder)
    if not known:
        raise ValueError(f"{folder} has no version")
    return spark.read.parquet(f"{folder}/version={known[-1]}/{name}")
