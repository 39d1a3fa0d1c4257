"""Change logs as streams, and watches that keep their state in the stream: stopped and started again at any place."""

import random

import pytest
from pyspark.sql import functions as F

from shardweave.sources.changelog import ChangeLogReader, Span, read_change_log
from shardweave.streaming.run import drain_batches
from shardweave.streaming.stateful import Bursts, Held, Silent, Watch
from shardweave.streaming.watch import watch_held

SCHEMA = "k string, at long, seq long, holds boolean, may_start boolean"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    draw, rows, at = random.Random(6), [], 1_000_000
    for i in range(400):
        at += draw.choice([0, 1, 900, 1_000, 2_500, 40_000])
        rows.append((draw.choice(["hot", "hot", "a", None]), at, i, draw.choice([True, True, False, None]), draw.random() < 0.5))
    rows += [("a", None, 900, True, True)]
    folder = str(tmp_path_factory.mktemp("log") / "t")
    dealt = rows[:]
    draw.shuffle(dealt)
    for part in range(3):
        spark.createDataFrame(dealt[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def runs(spark, log, cuts):
    folder, _ = log
    schema = spark.read.parquet(folder).schema
    return [read_change_log(spark, folder, schema, "at", upto, ranges=3) for upto in (*cuts, None)]


def cuts_of(rows, n):
    times = sorted({r[1] // 1000 * 1000 for r in rows if r[1] is not None})
    return [times[len(times) * k // (n + 1)] for k in range(1, n + 1)]


def by_key(rows):
    found = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        found.setdefault(r[0], []).append(r)
    return found


def held(rows, hold):
    for k, own in by_key(rows).items():
        since = None
        for _, at, seq, holds, may_start in own:
            since = None if not holds else at if since is None and may_start else since
            yield k, seq, -1 if since is None else since, since is not None and at - since >= hold


@pytest.mark.parametrize("restarts", [0, 3])
def test_held(spark, log, tmp_path, restarts):
    watch = Watch(Held(30_000), "k", str(tmp_path))
    for stream in runs(spark, log, cuts_of(log[1], restarts)):
        watch.run(stream)
    got = watch.rows(spark, "string").select("k", "seq", "since", "held").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(held(log[1], 30_000), key=repr)


def test_rows_settle_as_they_come(spark, log, tmp_path):
    watch, found = Watch(Held(30_000), "k", str(tmp_path)), []
    cuts = cuts_of(log[1], 3)
    for stream in runs(spark, log, cuts):
        watch.run(stream)
        found.append(watch.rows(spark, "string").count())
    assert found == [sum(r[1] is not None and r[1] <= c for r in log[1]) for c in (*cuts, 1 << 60)]


def test_silence_and_bursts(spark, log, tmp_path):
    rows, limit = log[1], 39_000
    silent, bursts = Watch(Silent(limit), "k", str(tmp_path / "s")), Watch(Bursts(5_000), "k", str(tmp_path / "b"))
    for stream in runs(spark, log, cuts_of(rows, 2)):
        silent.run(stream.select("k", "at"))
    for stream in runs(spark, log, cuts_of(rows, 2)):
        bursts.run(stream.select("k", "at"))
    newest, want, windows = max(r[1] for r in rows if r[1] is not None), set(), set()
    for k, own in by_key(rows).items():
        times = sorted({r[1] for r in own})
        want |= {(k, a, a + limit) for a, b in zip(times, [*times[1:], newest]) if b - a > limit}
        until = 0
        for at in times:
            if at >= until:
                until = at + 5_000
                windows.add((k, at, until))
    got = silent.rows(spark, "string").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    got = bursts.rows(spark, "string").collect()
    assert {tuple(r) for r in got} == windows and len(got) == len(windows)


def test_lateness_waits_for_rows_out_of_order(spark, log, tmp_path):
    rows = log[1]
    watch = Watch(Held(30_000), "k", str(tmp_path), lateness="1 hours")
    for stream in runs(spark, log, cuts_of(rows, 1)):
        watch.run(stream)
    assert watch.rows(spark, "string").count() == 0  # nothing is an hour old


def test_watch_in_buckets_goes_on_from_its_folder(spark, log, tmp_path):
    rows, streams = log[1], runs(spark, log, cuts_of(log[1], 2))
    whole = watch_held(streams, "k", 30_000, 0, 10_000)
    assert sorted(map(tuple, whole.rows.select("k", "seq", "since", "held").collect()), key=repr) == sorted(held(rows, 30_000), key=repr)
    for stream in streams:  # every call is a driver of its own
        apart = watch_held(stream, "k", 30_000, 0, 10_000, str(tmp_path / "w"))
    assert sorted(map(tuple, apart.rows.collect()), key=repr) == sorted(map(tuple, whole.rows.collect()), key=repr)


def test_rows_without_a_time_are_late(spark, tmp_path):
    rows = [("a", 1, 1, True, True), ("a", None, 2, True, True), ("b", 5, 3, True, True)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "t"))
    seen = watch_held(stream, "k", 1, 0)
    assert seen.rows.count() == 2 and [r.seq for r in seen.late.collect()] == [2]


def test_a_run_reads_what_comes_after_the_last_offset(spark, log, tmp_path):
    folder, rows = log
    cuts = cuts_of(rows, 3)
    for stream in runs(spark, log, cuts):
        drain_batches(stream, "t", lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/o/batch={n}"), "append", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/o")
    assert got.count() == len(rows) - 1 == got.select("seq").distinct().count()
    spans = got.groupBy("batch").agg(F.min("at"), F.max("at")).orderBy("batch").collect()
    assert len(spans) == 4
    assert all(low > c >= high for (_, _, high), c, (_, low, _) in zip(spans, cuts, spans[1:]))


def test_ranges_cover_an_offset_exactly(spark, log):
    folder, rows = log
    reader = ChangeLogReader(spark.read.parquet(folder).schema, {"path": folder, "position": "at", "ranges": "5"})
    first, last = reader.initialOffset(), reader.latestOffset()
    spans = reader.partitions(first, last)
    assert len(spans) == 5 and reader.partitions(last, last) == []
    read = [x for s in spans for b in reader.read(s) for x in b.column("seq").to_pylist()]
    assert sorted(read) == sorted(r[2] for r in rows if r[1] is not None)
    again = [x for b in reader.read(Span(spans[2].low, spans[2].high)) for x in b.column("at").to_pylist()]
    assert again and all(spans[2].low < a <= spans[2].high for a in again)


def test_empty_log(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    watch = Watch(Held(1), "k", str(tmp_path / "w"))
    watch.run(read_change_log(spark, folder, spark.read.parquet(folder).schema, "at"))
    reader = ChangeLogReader(spark.read.parquet(folder).schema, {"path": folder, "position": "at"})
    assert reader.latestOffset() == reader.initialOffset()
