"""Orders over whole tables without one task that sees them all: running sums, ranks, interleaving, cut-offs."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 2, 20


def range_number(df: DataFrame, keys: list[str]) -> Column:
    """The number of the range of the keys' order (nulls first) that a row falls in: about RANGES for each shuffle partition, as many rows in one as in another.

    Bounds are every SAMPLED-th of a random sample of keys, which alone comes to the driver. They are literals of the plan, so whatever reads df, and however
    often, cuts it at the same keys. Rows of equal keys stay together."""
    ranges = RANGES * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = df.select(*keys).orderBy(F.rand(7)).limit(SAMPLED * ranges).orderBy(*keys).collect()
    cuts = list(dict.fromkeys(sample[SAMPLED - 1 :: SAMPLED]))
    if not cuts:
        return F.lit(0)
    kinds = [df.schema[k].dataType for k in keys]
    own, wide = F.struct(*keys), isqrt(len(cuts)) + 1
    bound = lambda row: F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, row, kinds, strict=True)))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= own))
    # two looks at about the root of all bounds each: which group of bounds, and which bound in it
    groups = [F.array(*map(bound, cuts[i : i + wide])) for i in range(0, len(cuts), wide)]
    group = below(F.array(*(bound(cuts[i]) for i in range(0, len(cuts), wide))))
    return F.when(group == 0, 0).otherwise((group - 1) * wide + below(F.element_at(F.array(*groups), F.greatest(group, F.lit(1)))))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of value over the rows before each one in the order (of those with equal `by`).

    Rows are numbered by ranges of `by` and order, so a hot group is many ranges. The sum of all ranges before one, a row for each range and group, is put at
    the head of its rows as one more row, and one window runs over both: a single shuffle of the rows, and no join. df is read three times (keys, totals,
    rows) and has to give the same rows each time. Rows that the order doesn't tell apart come in any order among themselves; a null value counts as nothing."""
    by = by or []
    rows = df.withColumns({"__v": value, "__part": range_number(df, [*by, *order])})
    sums = rows.groupBy("__part", *by).agg(F.sum("__v").alias("__v"))
    kind = sums.schema["__v"].dataType
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.withColumns({"__v": F.sum("__v").over(earlier).cast(kind), "__own": F.lit(False)}).where("__v is not null")
    both = rows.withColumns({"__v": F.col("__v").cast(kind), "__own": F.lit(True)}).unionByName(heads, allowMissingColumns=True)
    before = W.partitionBy("__part", *by).orderBy("__own", *order).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn(name, F.coalesce(F.sum("__v").over(before), F.lit(0)).cast(kind)).where("__own").drop("__v", "__part", "__own")


def within_budget(df: DataFrame, order: list[str], cost: Column, limit: float, by: list[str] | None = None) -> DataFrame:
    """Rows before which less than the limit is spent (by those of equal `by`): a ceiling that is looked at before each step."""
    return running_sum(df, order, cost, "spent_before", by).where(F.col("spent_before") < limit)


def interleaved(df: DataFrame, lists: str, order: list[str]) -> DataFrame:
    """df with `turn` (from 1): the first of each list, then the second of each, and so on."""
    return running_sum(df, order, F.lit(1), "turn", [lists]).withColumn("turn", F.col("turn") + 1)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; each task first keeps its own k, which Spark does for a row_number filter."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
