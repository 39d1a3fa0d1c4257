import math
import random

import pytest
from pyspark.sql import functions as F

from shardweave.operators import alerts as R
from shardweave.operators import autosplit as A
from shardweave.operators import recovery as B
from shardweave.operators import scan
from shardweave.operators.scan import MICROS, MINUTE


@pytest.mark.parametrize("in_window", [0, 1000])
def test_rate_counts_resets(spark, monkeypatch, in_window):
    monkeypatch.setattr(scan, "FRAME_ROWS", in_window)
    rows = [("a", 0, 10), ("a", 60, 40), ("a", 120, 5), ("a", 400, 25), ("b", 0, 7)]
    df = spark.createDataFrame([(k, s * MICROS, i, v) for i, (k, s, v) in enumerate(rows)], "k string, at long, seq long, v long")
    for width in (MINUTE, 60 * MINUTE):
        got = {(r.k, r.at // MICROS): round(r.rate * 300, 6) for r in R.counter_rate(df, ["k"], "at", "seq", "v", width).collect()}
        assert got == {("a", 0): 0, ("a", 60): 30, ("a", 120): 35, ("a", 400): 25, ("b", 0): 0}
    grown = R.counter_increase(df, ["k"], "at", "seq", "v", ["k"], MINUTE, 5 * MINUTE)
    assert {(r.k, r.step): r.increase for r in grown.collect()} == {("a", 0): 35, ("a", 1): 20, ("b", 0): 0}


def test_histogram_quantile(spark):
    inf = math.inf
    rows = [("x", 1.0, 10), ("x", 2.0, 20), ("x", 4.0, 100), ("x", inf, 100), ("y", 1.0, 0), ("y", 2.0, 5), ("y", inf, 100), ("z", 1.0, 0), ("z", inf, 0)]
    df = spark.createDataFrame(rows, "g string, le double, n long")
    got = {r.g: r.quantile for r in R.histogram_quantile(df, ["g"], "le", "n", 0.95).collect()}
    assert got == {"x": pytest.approx(2 + 2 * 75 / 80), "y": 2.0, "z": None}


def test_evaluation_grid_equals_plain_search(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randint(0, 400), i, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, at long, seq long, v double")
    got = {(r.k, r.eval_at): r.v for r in R.evaluation_grid(df, ["k"], "at", "seq", "v", 10, 40).collect()}
    want = {}
    for k in "ab":
        for t in range(0, 460, 10):
            seen = [(at, seq, v) for q, at, seq, v in rows if q == k and t - 40 < at <= t]
            if seen:
                want[(k, t)] = max(seen)[2]
    assert got == want


def test_sliding_average(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 3.0), ("a", 12, 8.0)], "k string, at long, v double")
    got = {r.start: r["mean"] for r in R.sliding_average(df, ["k"], "at", "v", 20, 10).collect()}
    assert got == {-10: 2.0, 0: 4.0, 10: 8.0}


def test_small_gauges(spark):
    df = spark.createDataFrame([("a", "Failed"), ("b", None)], "j string, phase string")
    assert {(r.j, r.gauge_phase): r.value for r in R.one_hot(df, "phase", ["Failed", "Done"]).collect()} == {
        ("a", "Failed"): 1, ("a", "Done"): 0, ("b", "Failed"): 0, ("b", "Done"): 0,
    }
    names = spark.createDataFrame([("postgres-backup-1",), ("x-postgres-backup-1",), (None,)], "n string")
    assert [r.m for r in names.select(R.label_matches(F.col("n"), "postgres-backup-.*").alias("m")).collect()] == [True, False, False]


def test_split_names(spark):
    df = spark.createDataFrame([("Orders_KS", "shard-0"), ("k" * 60, "shard-1")], "keyspace string, shard string")
    name = A.split_job_name(F.col("keyspace"), F.col("shard"), F.lit(0).cast("long"), F.lit(0x7FFFFFFF).cast("long"))
    first, second = [r.n for r in df.select(name.alias("n")).collect()]
    assert first == "autosplit-orders-ks-shard-0-897d1c"
    assert len(second) <= 63 and not second.endswith("-")


def test_retention(spark):
    rows = [("s", "j1", 10, "Succeeded", 2), ("s", "j2", 20, "Succeeded", 2), ("s", "j3", None, "Succeeded", 2), ("s", "j4", 30, "Succeeded", 2),
            ("s", "f", 1, "Failed", 2), ("all", "a", 1, "Succeeded", 0)]
    df = spark.createDataFrame(rows, "schedule string, name string, ended_at long, phase string, keep int")
    assert sorted(r.name for r in B.expired_backups(df, F.col("keep"), width=7).collect()) == ["j1", "j3"]


def test_next_runs(spark):
    schedules = spark.createDataFrame(
        [("a", 0, None, True), ("b", 0, None, False), ("c", 0, 20, True), ("d", 0, 90, False)],
        "schedule string, created_at long, last_run long, immediate boolean",
    )
    fires = spark.createDataFrame([(s, t) for s in "abcd" for t in (10, 20, 60)], "schedule string, fire_at long")
    found = {r.schedule: (r.next_at, r.due) for r in B.next_runs(schedules, fires, 50).collect()}
    assert found == {"a": (0, True), "b": (10, True), "c": (60, False), "d": (None, False)}


def test_job_names_fit(spark):
    df = spark.createDataFrame([("nightly", 1_700_000_000 * MICROS), ("x" * 80, 1_700_000_000 * MICROS)], "s string, t long")
    short, long = [r.n for r in df.select(B.job_name(F.col("s"), F.col("t")).alias("n")).collect()]
    assert short == "nightly-1700000000" and len(long) == 63 and long.endswith("x-1700000000")
