import datetime

import pytest
from pyspark.sql import functions as F

from shardweave.operators.changes import state_at
from shardweave.sources import chain as K

START = datetime.datetime(2024, 1, 1)


def log(spark, n=400):
    """Commit times that mostly follow the positions, with some out of order; every ninth change deletes."""
    rows = [(p, START + datetime.timedelta(minutes=p + (p * 7) % 5), "D" if p % 9 == 0 else "U", (p * 13) % 60, p * 10) for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "lsn long, commit_ts timestamp, op string, id long, val long")


def latest(changes, position):
    return changes.filter(F.col("lsn") <= position).agg(F.max("commit_ts").cast("string")).first()[0]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain"))
    snapshot, changes = spark.createDataFrame([(k, -k) for k in range(40)], "id long, val long"), log(spark)
    for position in (0, 200):
        state = state_at(snapshot, changes.filter(F.col("lsn") <= position), "id", ["lsn"], "commit_ts", F.lit("2030-01-01").cast("timestamp"))
        K.add_full(path, state, position, latest(changes, position) or "2023-12-31 00:00:00")
    for since, upto in ((0, 50), (50, 120), (200, 260)):
        K.add_increment(path, changes, "id", "lsn", since, upto, latest(changes, upto))
    K.archive_log(path, changes.filter("lsn <= 220"), "lsn", "commit_ts", 25)
    K.archive_log(path, changes.filter("lsn > 210"), "lsn", "commit_ts", 25)  # a piece is pushed again
    return path, snapshot, changes


@pytest.mark.parametrize("minute", [0, 3, 55, 90, 124, 125, 199, 204, 205, 250, 266, 399, 5000])
def test_restore_is_the_state(spark, made, minute):
    path, snapshot, changes = made
    target = F.lit(START + datetime.timedelta(minutes=minute))
    want = state_at(snapshot, changes, "id", ["lsn"], "commit_ts", target)
    got = K.restore(spark, path, "id", "lsn", "commit_ts", target)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_needed_parts_are_read(spark, made):
    path, _, _ = made
    target = F.lit(START + datetime.timedelta(minutes=150))
    assert [(b.kind, b.position) for b in K.backups_for(spark, path, target)] == [("full", 0), ("increment", 50), ("increment", 120)]
    log = K.needed_log(spark, path, 120, "lsn", "commit_ts", target)
    scan = log._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__segment" in scan and "(__segment#" in scan and ">= 4)" in scan and "<= 6)" in scan
    assert {r[0].split("__segment=")[1].split("/")[0] for r in log.select("_metadata.file_path").collect()} <= {"4", "5", "6"}
    assert K.needed_log(spark, path, 10**6, "lsn", "commit_ts", target) is None


def test_no_full_copy_by_the_target(spark, made):
    with pytest.raises(K.BrokenChain):
        K.restore(spark, made[0], "id", "lsn", "commit_ts", F.lit("2020-01-01").cast("timestamp"))
