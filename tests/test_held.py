import random

import pytest
from pyspark.sql import functions as F

from shardweave.operators.autosplit import Triggers, breached
from shardweave.operators.held import alert_state, sustained, with_held_since
from shardweave.operators.scan import bucket_of


def held(spark, rows, hold, width=3, gated=False):
    df = spark.createDataFrame(rows, "k string, at long, seq long, on boolean, ok boolean")
    since = with_held_since(df, ["k"], "at", "seq", F.col("on"), bucket_of("at", width), F.col("ok") if gated else None)
    out = since.withColumn("held", sustained(F.col("at"), F.col("since"), hold)).orderBy("k", "at", "seq")
    return [(r.since, r.held) for r in out.collect()]


def test_breach_of_five_minutes(spark):
    rows = [("s", at, 0, on, True) for at, on in ((0, True), (4, True), (5, True), (6, False), (7, True))]
    assert [h for _, h in held(spark, rows, 5)] == [False, False, True, False, False]
    assert [h for _, h in held(spark, rows, 0)] == [True, True, True, False, True]


def test_debounce_starts_only_when_ready(spark):
    def run(*steps):
        return [h for _, h in held(spark, [("c", at, 0, on, ok) for at, on, ok in steps], 8, gated=True)]

    assert run((0, True, True), (7, True, True), (9, True, True)) == [False, False, True]
    # The gate only matters at the start.
    assert run((0, True, True), (5, True, False), (9, True, False)) == [False, False, True]
    assert run((0, True, False), (16, True, False), (17, True, True), (24, True, True), (25, True, False)) == [False] * 4 + [True]
    # A recovery starts the clock again.
    assert run((0, True, True), (5, False, True), (6, True, True), (10, True, True), (14, True, True)) == [False] * 4 + [True]


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_random_runs_equal_a_plain_loop(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice(["hot"] * 5 + ["x", None]), rnd.randint(0, 200), i, rnd.random() < 0.8, rnd.random() < 0.4) for i in range(400)]
    want, clock = [], {}
    for k, at, seq, on, ok in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if not on:
            clock.pop(k, None)
        elif k not in clock and ok:
            clock[k] = at
        since = clock.get(k)
        want.append((since, since is not None and at - since >= 12))
    assert held(spark, rows, 12, width, gated=True) == want


def test_alert_states(spark):
    df = spark.createDataFrame([(10, None), (10, 8), (10, 5)], "at long, since long")
    assert [r.s for r in df.select(alert_state(F.col("at"), F.col("since"), 5).alias("s")).collect()] == ["inactive", "pending", "firing"]


def test_triggers_are_all_required(spark):
    gb = 1_000_000_000
    df = spark.createDataFrame([(60 * gb, 90, 50 * gb), (60 * gb, 10, 100 * gb), (0, 0, 0)], "size long, cpu long, cap long")

    def run(triggers):
        test = breached(triggers, F.col("size"), F.col("cpu"), F.lit(0), F.col("cap"))
        return [r.b for r in df.select(test.alias("b")).collect()]

    assert run(Triggers(size_gb=50)) == [True, True, False]
    assert run(Triggers(size_gb=50, cpu_percent=80)) == [True, False, False]
    assert run(Triggers(volume_percent=80)) == [True, False, False]
    assert run(Triggers(size_gb=50, p99_ms=1)) == [False] * 3
    assert run(Triggers()) == [False] * 3
