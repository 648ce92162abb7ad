"""Where a paged source is left: after the first page that brings nothing new, at a budget, or at a ceiling of pages. A running aggregate over the totals of pages, not a loop over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page_totals(items: DataFrame, source: str, page: str, item: str) -> DataFrame:
    """source, page, n (rows), new (items that no page before has): one row a page, however many rows it has."""
    first = items.groupBy(source, item).agg(F.min(page).alias(page)).groupBy(source, page).agg(F.count("*").alias("new"))
    every = items.groupBy(source, page).agg(F.count("*").alias("n"))
    return every.join(first, [source, page], "left").select(source, page, "n", F.coalesce("new", F.lit(0)).alias("new"))


def pages_read(totals: DataFrame, source: str, page: str, budget: int | None = None, most: int | None = None) -> DataFrame:
    """totals of the pages that are read, in their order: one that brings nothing new is the last, and none is begun when the rows before it reach the budget or `most` pages are done.

    stopped says at the last page why no more is read: dry, budget, ceiling, or end (there are no more). Only the totals of a source meet in a task."""
    before = W.partitionBy(source).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(source).orderBy(page)
    rows = totals.withColumns({"spent": F.coalesce(F.sum("n").over(before), F.lit(0)), "dry": F.coalesce(F.max((F.col("new") == 0).cast("int")).over(before), F.lit(0)), "place": F.row_number().over(order)})
    full = F.lit(False) if budget is None else F.col("spent") >= budget
    late = F.lit(False) if most is None else F.col("place") > most
    rows = rows.withColumn("read", (F.col("dry") == 0) & ~full & ~late)
    why = F.when(F.col("new") == 0, "dry").when(F.lead("read").over(order).isNull(), "end").when(F.lead("read").over(order), F.lit(None)).when(F.lead(full).over(order), "budget").otherwise("ceiling")
    return rows.withColumn("stopped", why).where("read").select(*totals.columns, "spent", "stopped")


def paged_until(items: DataFrame, source: str, page: str, item: str, budget: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The items that a stop leaves (each once, on the first page that has it), and for each source pages, rows, found, stopped and truncated: whether the budget or the ceiling ended it."""
    read = pages_read(page_totals(items, source, page, item), source, page, budget, most)
    kept = items.join(read.select(source, page), [source, page], "left_semi").groupBy(source, item).agg(F.min(page).alias(page))
    summary = read.groupBy(source).agg(F.count("*").alias("pages"), F.sum("n").alias("rows"), F.sum("new").alias("found"), F.max("stopped").alias("stopped"))
    return kept, summary.withColumn("truncated", F.col("stopped").isin("budget", "ceiling"))
