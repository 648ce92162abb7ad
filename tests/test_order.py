"""Running sums against a plain window over the whole table, on more rows than a sample of bounds holds, with columns that only one branch needs."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators import order


def differing(df, keys, value, by=(), partitions="8"):
    spark = df.sparkSession
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = order.running_sum(df, keys, value, "got", list(by))
        whole = W.partitionBy(*(by or [F.lit(0)])).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
        want = df.select(*by, *keys, F.coalesce(F.sum(value).over(whole), F.lit(0)).alias("want"))
        assert got.count() == df.count()
        return got.join(want, list({*by, *keys}), "left").where("want is null or got <> want").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


@pytest.mark.parametrize("partitions", ["8", "32"])
def test_orders_with_all_their_columns(spark, partitions):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    assert differing(orders, ["o_orderdate", "o_orderkey"], cents, partitions=partitions) == 0
    half = orders.agg(F.sum(cents)).first()[0] // 2
    kept = order.within_budget(orders, ["o_orderdate", "o_orderkey"], cents, half)
    spent = W.partitionBy(F.lit(0)).orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    want = orders.withColumn("s", F.coalesce(F.sum(cents).over(spent), F.lit(0))).where(F.col("s") < half)
    assert kept.count() == want.count() > 70_000
    assert kept.select("o_orderkey").exceptAll(want.select("o_orderkey")).isEmpty()


def test_two_million_rows_with_a_hot_group(spark):
    df = spark.range(2_000_000).select(F.col("id"), F.xxhash64("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 1000).cast("string"))).alias("g"), F.repeat(F.lit("x"), 20).alias("payload"), (F.col("id") % 97).alias("v"))
    assert differing(df, ["k", "id"], F.col("v")) == 0
    assert differing(df, ["k", "id"], F.col("v"), ["g"]) == 0


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, 1, 5), (None, 2, None), ("a", 3, 7), ("a", 4, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.s for r in order.running_sum(df, ["k"], F.col("v"), "s", ["g"]).collect()}
    assert got == {(None, None): 0, (None, 1): 2, (None, 2): 7, ("a", 3): 0, ("a", 4): 7}
    assert order.running_sum(df.limit(0), ["k"], F.col("v"), "s").collect() == []
    same = order.running_sum(spark.createDataFrame([(1, 2)] * 50, "k int, v int"), ["k"], F.col("v"), "s")
    assert sorted(r.s for r in same.collect()) == list(range(0, 100, 2))
    exact = order.running_sum(df.withColumn("d", F.col("k").cast("decimal(12,2)")), ["d"], F.col("d"), "s")
    assert sorted(str(r.s) for r in exact.collect()) == ["0.00", "0.00", "1.00", "3.00", "6.00"]
