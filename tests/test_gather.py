import pytest
from pyspark.sql import functions as F

from shardweave.operators import gather as G
from shardweave.operators.scan import bucket_of

COUNT_SUM = {"n": G.Aggregate("count"), "total": G.Aggregate("sum", "v")}


def test_scalar_partials_merge(spark):
    partials = spark.createDataFrame([("a", 3, 30), ("b", 2, 20)], "__shard string, n long, total long")
    assert tuple(G.merge_partials(partials, [], COUNT_SUM).first()) == (5, 50)
    nothing = spark.createDataFrame([("a", 0, None), ("b", 0, None)], "__shard string, n long, total long")
    assert tuple(G.merge_partials(nothing, [], COUNT_SUM).first()) == (0, None)
    mixed = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 2.5)], "__shard string, n long, total double")
    assert G.merge_partials(mixed, [], COUNT_SUM).first().total == 12.5
    assert tuple(G.merge_partials(nothing.limit(0), [], COUNT_SUM).first()) == (0, None)


def test_grouped_partials_merge_and_keep_null_apart(spark):
    rows = [("a", "us", 3), ("a", "eu", 1), ("b", "us", 2), ("b", "asia", 4), ("b", None, 7), ("a", "<nil>", 1)]
    partials = spark.createDataFrame(rows, "__shard string, region string, n long")
    merged = G.merge_partials(partials, ["region"], {"n": G.Aggregate("count")})
    assert {r.region: r.n for r in merged.collect()} == {"us": 5, "eu": 1, "asia": 4, None: 7, "<nil>": 1}


def test_round_trip_equals_direct_aggregation(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("__shard"), (F.col("id") % 7).alias("g"), F.expr("IF(id % 5 = 0, NULL, id)").alias("v")
    )
    aggs = {
        "n": G.Aggregate("count"), "nv": G.Aggregate("count", "v"), "s": G.Aggregate("sum", "v"),
        "lo": G.Aggregate("min", "v"), "hi": G.Aggregate("max", "v"), "mean": G.Aggregate("avg", "v"),
    }
    got = G.merge_partials(G.shard_partials(df, ["g"], aggs), ["g"], aggs).orderBy("g").collect()
    want = df.groupBy("g").agg(F.count("*"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with pytest.raises(G.NotMergeable):
        G.shard_partials(df, [], {"x": G.Aggregate("median", "v")})


def test_distinct_sketches_merge(spark):
    df = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 4).alias("__shard"), (F.col("id") % 5000).alias("v"))
    aggs = {"d": G.Aggregate("approx_distinct", "v")}
    estimate = G.merge_partials(G.shard_partials(df, [], aggs), [], aggs).first().d
    assert abs(estimate - 5000) < 250


def test_order_puts_null_last_and_numbers_by_value(spark):
    df = spark.createDataFrame([("b", 100), ("a", 9), ("b", None), ("a", 10), ("a", 100)], "__shard string, v long")
    assert [r.v for r in G.merge_ordered(df, ["V"]).collect()] == [9, 10, 100, 100, None]
    down = G.merge_ordered(df, [2], descending=True).collect()
    assert [tuple(r) for r in down] == [("b", None), ("a", 100), ("b", 100), ("a", 10), ("a", 9)]
    with pytest.raises(IndexError):
        G.order_column(df, "3")


def test_item_kinds(spark):
    items = {"COUNT (*)": "count", "sum(a.b)": "sum", "count(distinct x)": "not mergeable", "avg(x)": "not mergeable", "region": "group key"}
    df = spark.createDataFrame([(i,) for i in items], "i string")
    assert {r.i: r.k for r in df.select("i", G.item_merge_kind(F.col("i")).alias("k")).collect()} == items


def test_replicas_take_turns(spark):
    members = spark.createDataFrame(
        [("s0", "r0a", "replica", True, "a:1", 500), ("s0", "r0b", "replica", True, "b:1", 10), ("s0", "p0", "primary", True, "p:1", 0),
         ("s1", "r1", "replica", True, "c:1", 5000), ("s1", "p1", "primary", True, "q:1", 0), ("s2", "r2", "replica", False, "d:1", 0)],
        "shard string, pod string, role string, ready boolean, endpoint string, lag long",
    )
    requests = spark.createDataFrame([(i, s) for i in range(4) for s in ("s0", "s1", "s2")], "id long, shard string")
    chosen = G.choose_read_endpoint(requests, ["id"], bucket_of("id", 2), members, 1000)
    found = {}
    for r in chosen.orderBy("id").collect():
        found.setdefault(r.shard, []).append(r.endpoint)
    assert found == {"s0": ["a:1", "b:1", "a:1", "b:1"], "s1": ["q:1"] * 4, "s2": [None] * 4}


def test_distinct_partials_merge_exactly(spark):
    values = [-(2**63) + 1, -40000, -1, 0, 1, 2, 32767, 32768, 32769, 2**62, None]
    rows = [(f"s{i % 3}", "x" if i % 2 else None, v, None if v is None else str(v)) for i in range(5) for v in values[: 3 + 2 * i]]
    df = spark.createDataFrame(rows, "__shard string, g string, v long, t string")
    for column in ("v", "t"):
        want = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct(column).alias("n")).collect()}
        partials = G.distinct_partials(df, ["g"], column)
        halves = partials.filter("__shard = 's0'").unionByName(partials.filter("__shard <> 's0'"))
        assert {r.g: r.n for r in G.merge_distinct(halves, ["g"], "n").collect()} == want
        assert G.merge_distinct(G.distinct_partials(df.limit(0), ["g"], column), ["g"], "n").collect() == []
