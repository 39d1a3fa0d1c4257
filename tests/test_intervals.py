"""Dyadic interval joins and hash trees against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shardweave.functions.hashing import hash_values
from shardweave.operators import hashtree
from shardweave.operators import reshard as R
from shardweave.operators.intervals import dyadic_cells, dyadic_join
from shardweave.plans import placement


@pytest.mark.parametrize("step", [1, 2, 4])
def test_dyadic_join_equals_brute_force(spark, step):
    draw = random.Random(step)
    intervals = [(i, draw.choice("ab"), lo, lo + draw.choice([-1, 0, 1, 5, 64, 1000, 40_000])) for i in range(120) for lo in [draw.randrange(-30_000, 30_000)]]
    intervals += [(500, "a", -(1 << 40), 1 << 40), (501, "a", 7, 7), (502, "a", None, 9), (503, "b", 0, (1 << 61) - 2)]
    values = [(v, draw.choice("ab"), draw.randrange(-31_000, 70_000)) for v in range(400)] + [(900, "a", None), (901, None, 5), (902, "b", 1 << 60), (3, "a", 7)]
    df, table = spark.createDataFrame(values, "v long, g string, x long"), spark.createDataFrame(intervals, "i long, g string, lo long, hi long")
    want = sorted((v, i) for v, g, x in values for i, k, lo, hi in intervals if g == k and None not in (x, lo, hi) and lo <= x <= hi)
    for small in (False, True):
        got = dyadic_join(df, "x", table, "lo", "hi", on=("g",), step=step, small=small)
        assert sorted((r.v, r.i) for r in got.collect()) == want
    left = dyadic_join(df, "x", table, "lo", "hi", on=("g",), how="left", step=step).collect()
    hit = {(v, g, x) for v, g, x in values if any((v, i) in set(want) for i, *_ in intervals)}
    assert len(left) == len(want) + sum(r not in hit for r in values)
    assert sorted((r.v, r.i) for r in left if r.i is not None) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_sums_equal_those_of_the_pairs(spark, how):
    draw = random.Random(4)
    intervals = [(draw.choice([None, i]), draw.choice("ab"), lo, lo + draw.choice([-1, 0, 9, 700, 50_000])) for i in range(90) for lo in [draw.randrange(-30_000, 30_000)]]
    values = [(v, draw.choice("ab"), draw.randrange(-31_000, 70_000)) for v in range(200)] + [(900, "a", None), (901, None, 5), (3, "a", 7), (3, "a", 7)]
    df, table = spark.createDataFrame(values, "v long, g string, x long"), spark.createDataFrame(intervals, "i long, g string, lo long, hi long")
    want = []
    for v, g, x in values:
        held = [i for i, k, lo, hi in intervals if g == k and None not in (x, lo, hi) and lo <= x <= hi]
        if held or how == "left":
            known = [i for i in held if i is not None]
            want.append((v, g, x, len(known) if held else None, sum(known) if known else None))
    sums = {"n": F.col("i").isNotNull().cast("long"), "total": F.col("i")}
    for small in (False, True):
        got = dyadic_join(df, "x", table, "lo", "hi", on=("g",), how=how, small=small, sums=sums).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_covered_parts_are_not_multiplied_by_their_intervals(spark, tmp_path, monkeypatch):
    spark.range(1, 401).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    keys = [*range(500), 7, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    made = []

    def joined(*args, **kwargs):
        made.append(dyadic_join(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(placement, "dyadic_join", joined)
    got = {r.p_partkey: (r.n_intervals, r["keys"]) for r in placement.v09_dyadic(spark, str(tmp_path)).collect()}
    bounds = [(s, h, h + s % 97 * 5_000_000) for s, h in zip(range(1, 401), hash_values("murmur3", [str(s) for s in range(1, 401)]))]
    want = {k: [0, 0] for k in keys}
    for k, h in zip(keys, hash_values("murmur3", ["" if k is None else str(k) for k in keys])):
        held = [s for s, lo, hi in bounds if lo <= h <= hi]
        want[k] = [want[k][0] + len(held), want[k][1] + sum(held)]
    assert got == {k: tuple(v) for k, v in want.items()}
    # some 22 of 400 intervals hold a hash
    assert sum(n for n, _ in got.values()) > 10 * len(keys)
    assert made[0].count() == len(keys)


def test_cells_do_not_grow_with_the_width(spark):
    table = spark.createDataFrame([(k, 3, 3 + (1 << k)) for k in range(2, 60)], "k long, lo long, hi long")
    for step, most in ((1, 2), (2, 6)):
        counts = {r.k: r.n for r in dyadic_cells(table, "lo", "hi", step=step).groupBy("k").agg(F.count("*").alias("n")).collect()}
        assert all(n <= most * (k // step + 1) for k, n in counts.items())


def test_no_intervals(spark):
    none = spark.createDataFrame([], "i long, lo long, hi long")
    assert dyadic_join(spark.range(3), "id", none, "lo", "hi").count() == 0
    assert dyadic_join(spark.range(3), "id", none, "lo", "hi", how="left").count() == 3


@pytest.mark.parametrize("bits", [4, 16])
def test_tree_diff_equals_table_diff(spark, bits):
    left = spark.range(3000).select("id", (F.col("id") * 3).alias("val"), F.lit(None).cast("string").alias("note"))
    right = left.where("id % 700 <> 1").withColumn("val", F.when(F.col("id") % 900 == 5, -1).otherwise(F.col("val")))
    right = right.unionByName(spark.range(5000, 5002).select("id", F.lit(0).cast("long").alias("val"), F.lit("x").alias("note")))
    want = sorted(map(tuple, R.table_diff(left, right, "id", share=1).collect()))
    assert want and sorted(map(tuple, R.tree_diff(left, right, "id", bits).collect())) == want
    assert R.tree_diff(left, left.select("note", "val", "id"), "id", bits).count() == 0
    assert R.tree_diff(left.limit(0), left.limit(0), "id", bits).count() == 0


def test_descent_finds_only_the_differing_buckets(spark):
    left = spark.range(5000).withColumn("val", F.lit(1))
    right = left.withColumn("val", F.when(F.col("id") == 77, 2).otherwise(F.col("val")))
    trees = [hashtree.hash_tree(t, "id") for t in (left, right)]
    found = hashtree.differing_buckets(*trees).collect()
    assert [r.bucket for r in found] == [spark.range(77, 78).select(hashtree.bucket_of_key("id")).first()[0]]
    top = [hashtree.level_above(t, 1).agg(F.sum("n")).first()[0] for t in trees]
    assert top == [5000, 5000]
