"""Interval joins of crowded places against the plain bin join and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave import catalog
from strandweave.operators import intervals
from strandweave.session import settled


def _sides(spark, rng, n, m, spread, longest):
    left = [(i, rng.choice("ab"), b := rng.randrange(spread), b + rng.randrange(longest)) for i in range(n)]
    right = [(i, rng.choice("ab"), b := rng.randrange(spread), b + rng.randrange(longest)) for i in range(m)]
    left += [(n, "a", 5, 250_000), (n + 1, "b", 9, 4), (n + 2, "a", 1000, 1000), (n + 3, "a", 1000, 1000)]
    right += [(m, "a", 900, 300_000), (m + 1, "a", 999, 1000)]
    l_df = settled(spark.createDataFrame(left, "l long, k string, lb long, le long").repartition(3))
    return left, right, l_df, settled(spark.createDataFrame(right, "r long, k string, rb long, re long").repartition(3))


@pytest.mark.parametrize(("spread", "longest", "crowd"), [(3000, 20, 400), (40, 900, 500), (1, 1, 300), (50_000, 3000, 2000)])
def test_equals_brute_force(spark, spread, longest, crowd):
    left, right, a, b = _sides(spark, random.Random(spread), 220, 160, spread, longest)
    want = sorted((i, j) for i, k, b1, e1 in left for j, k2, b2, e2 in right if k == k2 and b1 <= e1 and b1 <= e2 and b2 <= e1 and (i + j) % 3)
    residual = (F.col("l") + F.col("r")) % 3 != 0
    got = intervals.dense_join(a, b, ["k"], ("lb", "le"), ("rb", "re"), residual, crowd=crowd)
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want


def test_a_pile_up_spreads_over_tasks(spark):
    n = 100_000
    a = settled(spark.range(n).select(F.col("id").alias("l"), F.lit(0).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("lb")).withColumn("le", F.col("lb")))
    b = settled(spark.range(n).select(F.col("id").alias("r"), F.lit(0).alias("k"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)).alias("rb")).withColumn("re", F.col("rb")))
    got = intervals.dense_join(a, b, ["k"], ("lb", "le"), ("rb", "re"), (F.col("l") + F.col("r")) % 1000 == 0)
    # all cells and parts beside each other: no task looks at more pairs than it may
    spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1
    x, y = a.groupBy("lb").count(), b.groupBy("rb").agg(F.count("*").alias("n"))
    pairs = x.join(y, x["lb"] == y["rb"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert 0.9 < sum(r["count"] for r in spread) / (pairs / 1000) < 1.1


def test_rows_of_a_pile_up_are_copied_by_the_root_of_its_parts(spark):
    n = 1000
    a = settled(spark.range(n).select(F.col("id").alias("l"), F.lit(0).alias("k"), F.lit(5).cast("long").alias("lb"), F.lit(5).cast("long").alias("le")))
    b = settled(spark.range(n).select(F.col("id").alias("r"), F.lit(0).alias("k"), F.lit(5).cast("long").alias("rb"), F.lit(5).cast("long").alias("re")))
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    # 10,000 parts: each row goes to 100 of them; copied to all, one side alone would be 10 million rows
    assert intervals.dense_join(a, b, ["k"], ("lb", "le"), ("rb", "re"), crowd=100).count() == n * n
    assert written() - before < 20e6


def test_pairs_of_many_bins_are_made_by_many_tasks(spark, tmp_path):
    # some KB of orders, all kinds at some 1,000 places
    rows = spark.range(6000).selectExpr("id as o_orderkey", "(id div 2) * 7 as o_custkey", "case when id % 2 = 0 then 'F' else 'O' end as o_orderstatus")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.two_sided_match(spark, str(tmp_path))
    tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == got.distinct().count() > 1000
