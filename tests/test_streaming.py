"""Streaming twins give the batch results, whatever the cut into micro-batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shardweave.operators.changes import apply_changes
from shardweave.operators.coalesce import coalesce_signals
from shardweave.operators.fleet import latest_status
from shardweave.operators.held import sustained, with_held_since
from shardweave.operators.scan import bucket_of
from shardweave.sources.events import stream_table
from shardweave.streaming.catchup import caught_up, follow_changes, latest_status_stream
from shardweave.streaming.watch import watch_averages, watch_bursts, watch_held, watch_silence

COLUMNS = "k string, at long, seq long, holds boolean, may_start boolean"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows, at = [], 0
    for i in range(600):
        at += rnd.choice([0, 1, 1, 2, 3, 30])
        rows.append((rnd.choice(["hot", "hot", "hot", "a", "b"]), at, i, rnd.random() < 0.7, rnd.random() < 0.5))
    folder = str(tmp_path_factory.mktemp("events"))
    dealt = rows[:]
    rnd.shuffle(dealt)  # files of a stream are in no order of time
    for part in range(6):
        chunk = spark.createDataFrame(dealt[part * 100 : part * 100 + 100], COLUMNS)
        chunk.coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, COLUMNS)


def stream(spark, folder):
    return stream_table(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_trigger=1)


def test_held_condition(spark, events):
    folder, table = events
    batch = with_held_since(table, ["k"], "at", "seq", F.col("holds"), bucket_of("at", 50), F.col("may_start"))
    want = {(r.k, r.seq, -1 if r.since is None else r.since, r.held) for r in batch.withColumn("held", sustained(F.col("at"), F.col("since"), 9)).collect()}
    got = watch_held(stream(spark, folder), "k", 9, 100_000).rows
    assert {(r.k, r.seq, r.since, r.held) for r in got.collect()} == want and got.count() == 600


def bursts_of(rows, width):
    found, busy = set(), {}
    for k, at in sorted(rows):
        if k not in busy or at >= busy[k]:
            found.add((k, at, at + width))
            busy[k] = at + width
    return found


@pytest.mark.parametrize("width,group", [(5, 10), (40, 25), (40, 10_000), (1, 3)])
def test_bursts(spark, events, width, group):
    folder, table = events
    want = bursts_of([(r.k, r.at) for r in table.collect()], width)
    assert {tuple(r) for r in coalesce_signals(table, "k", "at", width, rows_per_group=group).collect()} == want
    if group == 25:
        got = watch_bursts(stream(spark, folder), "k", width, 100_000).rows
        assert {tuple(r) for r in got.collect()} == want


def test_dense_bursts(spark):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.8 else f"k{rnd.randint(0, 5)}", rnd.randint(-1500, 1500)) for _ in range(3000)]
    rows = [(None if k == "k0" else k, at) for k, at in rows]
    df = spark.createDataFrame(rows, "k string, at long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for width, group in ((7, 40), (50, 100), (300, 100)):
            got = {tuple(r) for r in coalesce_signals(df, "k", "at", width, rows_per_group=group).collect()}
            assert got == {(k or None, a, b) for k, a, b in bursts_of([(k or "", at) for k, at in rows], width)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_silence(spark, events):
    folder, table = events
    limit, beats = 25, {}
    for r in table.orderBy("at").collect():
        beats.setdefault(r.k, []).append(r.at)
    mark = max(max(b) for b in beats.values())
    want = set()
    for k, times in beats.items():
        want |= {(k, a, a + limit) for a, b in zip(times, times[1:]) if b - a > limit}
        if times[-1] + limit < mark:
            want.add((k, times[-1], times[-1] + limit))
    got = watch_silence(stream(spark, folder), "k", limit, 100_000).rows
    assert {tuple(r) for r in got.collect()} == want


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    """Files about 20 apart in time, the last with rows behind the others."""
    folder = str(tmp_path_factory.mktemp("ordered"))
    for part in range(5):
        at = [part * 20 + i for i in range(20)] if part < 4 else [85, 2, 3]
        rows = [("ab"[a % 3 == 0], a, a, a % 7 != 0, a % 2 == 0) for a in at]
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in order of their time
    return folder


def test_rows_settle_behind_the_watermark_and_late_ones_are_kept(spark, ordered):
    table = spark.read.parquet(ordered)
    on_time = table.where("at NOT IN (2, 3) OR seq <> at").unionByName(table.where("at IN (2, 3)").dropDuplicates(["at"]))
    batch = with_held_since(on_time, ["k"], "at", "seq", F.col("holds"), bucket_of("at", 50), F.col("may_start"))
    want = {(r.k, r.at, -1 if r.since is None else r.since) for r in batch.collect()}
    seen = watch_held(stream(spark, ordered), "k", 9, 25)
    assert sorted(r.at for r in seen.late.collect()) == [2, 3]
    assert {(r.k, r.at, r.since) for r in seen.rows.collect()} == want
    signals = watch_bursts(stream(spark, ordered), "k", 10, 25)
    assert {tuple(r) for r in signals.rows.collect()} == bursts_of([(r.k, r.at) for r in on_time.collect()], 10)
    assert signals.late.count() == 2


def test_averages_lose_nothing(spark, events):
    folder, table = events
    got = watch_averages(stream(spark, folder), ["k"], "at", "seq", 40, 10)
    want = {}
    for r in table.collect():
        for i in range(4):
            t, n = want.get((r.k, r.at // 10 * 10 - i * 10), (0, 0))
            want[r.k, r.at // 10 * 10 - i * 10] = (t + r.seq, n + 1)
    assert {(r.k, r.start): (r.total, r.n) for r in got.collect()} == want


def test_latest_status(spark, events):
    folder, table = events
    got = latest_status_stream(stream(spark, folder), "k", ("at", "seq"))
    want = latest_status(table, "k", ("at", "seq"))
    assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_catch_up(spark, events, tmp_path):
    folder, table = events

    def changes(df):
        op = F.when(F.col("seq") % 7 == 0, "D").when(F.col("holds"), "U").otherwise("I")
        return df.select(op.alias("op"), F.concat("k", F.col("seq") % 40).alias("id"), "seq", F.col("at").alias("val"))

    snapshot = spark.createDataFrame([("hot1", -1), ("hot2", -2), ("other", -3), ("other", -4)], "id string, val long")
    log = str(tmp_path / "log")
    follow_changes(changes(stream(spark, folder)), "id", ["seq"], ["val"], log)
    want = apply_changes(snapshot, changes(table), "id", ["seq"])
    got = caught_up(snapshot, log, "id", ["seq"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    state = {}
    for r in changes(table).orderBy("seq").collect():
        state[r.id] = None if r.op == "D" else r.val
    plain = [(k, v) for k, v in state.items() if v is not None] + [(k, v) for k, v in (("hot1", -1), ("hot2", -2), ("other", -3), ("other", -4)) if k not in state]
    assert sorted(map(tuple, got.collect())) == sorted(plain)
