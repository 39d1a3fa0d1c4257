from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardweave.operators.skew import heavy_keys, heavy_sketches, spread_join


def uneven(spark, n=60_000):
    """A third of the rows under key 7, the rest spread; some keys are null."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 5000 + 100)
    return spark.range(n).select("id", key.alias("k"), (F.col("id") % 4).alias("shard"))


def test_merged_sketches_name_the_heavy_keys(spark):
    rows = uneven(spark)
    found = heavy_keys(heavy_sketches(rows, "k", ["shard"]), 0.05)
    assert set(found) == {7} and found[7] >= 20_000
    assert heavy_keys(heavy_sketches(rows.filter("k > 7"), "k"), 0.05) == {}
    assert heavy_keys(heavy_sketches(rows.limit(0), "k"), 0.05) == {}
    with pytest.raises(ValueError):
        heavy_keys(heavy_sketches(rows, "k"), 0.001)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    left = uneven(spark, 6000).unionByName(uneven(spark, 300))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (101, "c"), (102, "d"), (None, "e")], "r long, v string")
    want = Counter(map(tuple, left.join(right, left.k == right.r, how).collect()))
    for heavy in ({}, {7: 2100}, {7: 2100, 101: 3, 9999: 1}):
        assert Counter(map(tuple, spread_join(left, right, "k", "r", heavy, rows=100, how=how).collect())) == want


def test_a_heavy_key_meets_many_tasks(spark):
    left, right = uneven(spark).repartition(8, "k"), spark.createDataFrame([(7, "a")], "r long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = spread_join(left, right, "k", "r", {7: 20_000}, rows=1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def test_buckets_stay_where_they_lie(spark, tmp_path):
    from shardweave.sources.layout import write_bucketed

    names = [f"skew_{n}_{tmp_path.name[-4:]}".lower().replace("-", "_") for n in "ab"]
    write_bucketed(uneven(spark, 6000), names[0], "k", 4, str(tmp_path / "a"))
    write_bucketed(spark.range(6000).select(F.col("id").alias("r"), F.lit("v").alias("v")), names[1], "r", 4, str(tmp_path / "b"))
    left, right = (spark.table(n) for n in names)
    for n in names:
        spark.sql(f"DROP TABLE {n}")
    joined = spread_join(left, right.hint("merge"), "k", "r", {7: 2000}, rows=500)
    assert joined.count() == left.filter("k < 6000").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("__part") > 0  # those of the heavy part alone
    assert spread_join(left, right.hint("merge"), "k", "r", {})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0
