import bisect
import random

import pytest
from pyspark.sql import functions as F

from shardweave.operators import scan as S


def rows(seed, n=400, span=500):
    """Random rows in which one key holds a large part and one key is NULL."""
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rnd.choice(keys), rnd.randint(-span, span), i, rnd.choice([None, *range(-5, 9)])) for i in range(n)]


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("width", [1, 37, 10_000])
@pytest.mark.parametrize("exclusive", [False, True])
def test_ordered_scan_equals_plain_loop(spark, width, exclusive):
    data = rows(width)
    df = spark.createDataFrame(data, "k string, at long, seq long, v long")
    got = S.ordered_scan(
        df, ["k"], ["at", "seq"], S.bucket_of("at", width),
        sums={"total": F.col("v")}, maxes={"peak": F.col("v")}, previous={"before": F.col("v")}, exclusive=exclusive,
    ).collect()
    want = set()
    for key, group in by_key(data).items():
        total = peak = before = None
        for _, at, seq, v in group:
            past = (total, peak)
            if v is not None:
                total = (total or 0) + v
                peak = v if peak is None else max(peak, v)
            now = past if exclusive else (total, peak)
            want.add((key, at, seq, v, *now, before))
            before = v
    assert {tuple(r) for r in got} == want
    assert len(got) == len(data)


def test_only_hot_keys_are_cut(spark):
    data = rows(11)
    df = spark.createDataFrame(data, "k string, at long, seq long, v long")
    cut = S.split_hot(df, ["k"], S.bucket_of("at", 20), hot_rows=100)
    buckets = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct(cut).alias("n")).collect()}
    assert buckets["hot"] > 40 and buckets["a"] == buckets["b"] == buckets[None] == 1
    plain = S.ordered_scan(df, ["k"], ["at", "seq"], S.bucket_of("at", 7), sums={"t": F.col("v")})
    mixed = S.ordered_scan(df, ["k"], ["at", "seq"], cut, sums={"t": F.col("v")})
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in plain.collect()}
    assert df.select(S.split_hot(df, ["k"], S.bucket_of("at", 20)).alias("b")).distinct().count() == 1


def test_scan_without_keys(spark):
    df = spark.createDataFrame(rows(3), "k string, at long, seq long, v long")
    got = S.ordered_scan(df, [], ["at", "seq"], S.bucket_of("at", 50), sums={"n": F.lit(1).cast("long")}).collect()
    assert sorted(r.n for r in got) == list(range(1, 401))


def test_bucket_of_rounds_down(spark):
    df = spark.createDataFrame([(-11,), (-10,), (-1,), (0,), (9,), (10,), ((1 << 62) + 7,)], "x long")
    assert [r.b for r in df.select(S.bucket_of("x", 10).alias("b")).collect()] == [-2, -1, -1, 0, 0, 1, ((1 << 62) + 7) // 10]


@pytest.mark.parametrize("window", [5, 60, 700])
def test_trailing_sum_equals_plain_loop(spark, window):
    data = rows(window)
    df = spark.createDataFrame(data, "k string, at long, seq long, v long")
    got = S.trailing_sum(df, ["k"], "at", window, F.coalesce("v", F.lit(0)), "total", 40).collect()
    for r in got:
        want = sum(v or 0 for k, at, _, v in data if k == r.k and r.at - window <= at <= r.at)
        assert r.total == want
    assert len(got) == len(data)


@pytest.mark.parametrize(("rows_of_key", "rows_in_window"), [(0, 0), (60, 1000), (10**6, 3)])
def test_trailing_sum_of_dense_and_sparse_keys(spark, monkeypatch, rows_of_key, rows_in_window):
    monkeypatch.setattr(S, "HOT_ROWS", rows_of_key)
    monkeypatch.setattr(S, "FRAME_ROWS", rows_in_window)
    data = [*rows(30), *[("few", at, at, 1) for at in (0, 30, 31, 62)], *[("ties", 5, k, k) for k in range(9)], ("few", None, 0, 7), (None, 3, 0, 2)]
    df = spark.createDataFrame([(k, at, seq, None if v is None else v / 4) for k, at, seq, v in data], "k string, at long, seq long, v double")
    got = S.trailing_sum(df, ["k"], "at", 30, F.col("v"), "total", 40).collect()
    for r in got:
        near = [v or 0 for k, at, _, v in data if k == r.k and (at is None if r.at is None else at is not None and r.at - 30 <= at <= r.at)]
        assert r.total == sum(near) / 4
    assert len(got) == len(data)


def test_as_of_join_equals_bisection(spark):
    left = [(k, at, seq) for k, at, seq, _ in rows(1)]
    right = [(k, at, seq, f"{k}/{at}/{seq}") for k, at, seq, _ in rows(2, 150)]
    got = S.as_of_join(
        spark.createDataFrame(left, "k string, at long, id long"),
        spark.createDataFrame(right, "k string, t long, seq long, name string"),
        ["k"], "at", "t", "seq", ["name"], 64,
    ).collect()
    lists = {}
    for k, t, seq, name in sorted(right, key=lambda r: (str(r[0]), r[1], r[2])):
        lists.setdefault(k, []).append((t, seq, name))
    for r in got:
        known = lists.get(r.k, [])
        at = bisect.bisect_right([(t) for t, _, _ in known], r.at)
        assert r.name == (known[at - 1][2] if at else None)
    assert len(got) == len(left)


def test_even_width_follows_the_fullest_stretch(spark):
    even = spark.range(0, 100_000).select((F.col("id") * 1000).alias("at"))
    assert 900_000 <= S.even_width(even, "at", rows_per_bucket=1000) <= 1_100_000
    burst = even.unionByName(spark.range(50_000).select((F.col("id") + 5_000_000).alias("at")))
    width = S.even_width(burst, "at", rows_per_bucket=1000)
    assert burst.groupBy(S.bucket_of("at", width).alias("b")).count().agg(F.max("count")).first()[0] <= 2100
    assert S.even_width(spark.range(0), "id") == S.DAY
