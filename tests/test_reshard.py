import random

import pytest
from pyspark.sql import functions as F

from shardweave.operators import changes as C
from shardweave.operators import reshard as R
from shardweave.operators.placement import SHARD, assign_shard
from shardweave.sources import deltas as D
from shardweave.sources import layout as L
from shardweave.sources.topology import Range, equal_hash_topology

FOUR = equal_hash_topology("id", 4)
SPLIT = R.split_move(FOUR, "shard-1", ("left", "right"))


def table(spark, n=2000):
    return spark.range(n).select("id", (F.col("id") * 10).alias("val"))


@pytest.fixture
def dataset(spark, tmp_path):
    path = str(tmp_path / "t")
    L.write_sharded(assign_shard(table(spark), FOUR, strict=True), path)
    return path


def content(df):
    return sorted((r.id, r.val) for r in df.collect())


def test_split_conserves_rows_and_can_be_repeated(spark, dataset):
    before = content(L.read_sharded(spark, dataset))
    for _ in range(2):
        after, report = R.run_move(spark, dataset, FOUR, SPLIT)
        rows = R.active_rows(L.read_sharded(spark, dataset), after)
        assert content(rows) == before
        assert report["copied"] == report["scanned"] > 0
        wrong = assign_shard(rows, after, "now").filter(F.col("now") != F.col(SHARD))
        assert wrong.count() == 0
    assert after.shards == ["shard-0", "shard-2", "shard-3", "left", "right"]
    # Readers of the old topology see the old rows until they switch.
    assert content(R.active_rows(L.read_sharded(spark, dataset), FOUR)) == before


def test_online_split_with_changes_and_failures(spark, dataset, monkeypatch):
    log = [("U", i, i * 3, -i) for i in range(1, 200)] + [("D", 200 + i, i * 7, None) for i in range(100)] + [("I", 500 + i, 5000 + i, i) for i in range(50)]
    changes = spark.createDataFrame(log, "op string, lsn long, id long, val long")
    want = {r.id: r.val for r in L.read_sharded(spark, dataset).collect()}
    after = R.moved_topology(FOUR, SPLIT)
    moving = {r.id for r in R.rows_moving(changes.select("id").unionByName(table(spark).select("id")), after, ["left", "right"]).collect()}
    for op, _, i, val in log:
        if i in moving:
            want.pop(i, None)
            if op != "D":
                want[i] = val
    arrived = []

    def so_far():
        arrived.append(1)
        return changes.filter(F.col("lsn") < 100 * len(arrived))

    # fail once at each step, then run to the end: the copy, each commit, the switch and the clean-up
    steps = [(D, "write_sharded", 1), *[(D.DeltaTable, "_publish", k) for k in (1, 2)], (D, "write_sharded", 1)]
    steps += [(D.DeltaTable, "_publish", 1), (R, "switch_topology", 1), (R, "drop_shards", 1), (D.DeltaTable, "fold_into", 1), (D.DeltaTable, "_publish", 1)]
    for owner, step, at in steps:
        real, calls = getattr(owner, step), []

        def broken(*args, real=real, calls=calls, at=at, **named):
            calls.append(1)
            if len(calls) == at:
                raise OSError("lost")
            return real(*args, **named)

        with monkeypatch.context() as patch:
            patch.setattr(owner, step, broken)
            with pytest.raises(OSError):
                R.run_online_move(spark, dataset, FOUR, SPLIT, "id", so_far, max_lag=0, tries=20)
        rows = L.read_placed(spark, dataset, FOUR)
        assert rows.count() == rows.select("id").distinct().count()
    again, report = R.run_online_move(spark, dataset, FOUR, SPLIT, "id", lambda: changes)
    assert again == after and {r.target for r in report.collect()} == {"left", "right"}
    rows = L.read_sharded(spark, dataset)
    assert {r.id: r.val for r in rows.collect()} == want
    assert L.current_topology(spark, dataset, FOUR).shards == after.shards
    assert {r.id for r in L.read_placed(spark, dataset, FOUR).collect()} == set(want)


@pytest.mark.parametrize("stops", [True, False])
def test_online_move_loses_no_change_behind_the_gate(spark, dataset, stops):
    log = spark.createDataFrame([("U", i, i * 3, -i) for i in range(1, 200)], "op string, lsn long, id long, val long")
    arrived, stopped = [], []

    def so_far():
        if not stopped:
            arrived.append(1)
        return log.filter(F.col("lsn") <= min(199, 60 + 20 * len(arrived)))

    moved = R.run_online_move(
        spark, dataset, FOUR, SPLIT, "id", so_far, max_lag=60, tries=20, stop_writes=(lambda: stopped.append(1)) if stops else None
    )
    after, _ = moved
    assert moved.position == min(199, 60 + 20 * len(arrived))
    base = table(spark).select("id").unionByName(log.select("id"))
    moving = {r.id for r in R.rows_moving(base, after, ["left", "right"]).collect()}
    found = {r.id: r.val for r in L.read_placed(spark, dataset, FOUR).collect()}
    assert all(found[3 * i] == -i for i in range(1, moved.position + 1) if 3 * i in moving)
    assert any(3 * i in moving for i in range(moved.position - 20, moved.position + 1))


def test_catch_up_goes_on_from_the_committed_position(spark, dataset, monkeypatch):
    log = spark.createDataFrame([("U", i, i % 90, -i) for i in range(1, 400)], "op string, lsn long, id long, val long")
    seen, real = [], D.DeltaTable.append

    def watched(self, changes, upto):
        rows = changes.agg(F.min("lsn"), F.max("lsn")).first()
        done = real(self, changes, upto)
        seen.append((rows[0], rows[1], upto, done))
        if len(seen) == 2:
            raise OSError("lost")
        return done

    arrived = []

    def so_far():
        arrived.append(1)
        return log.filter(F.col("lsn") < 60 * len(arrived))

    monkeypatch.setattr(D.DeltaTable, "append", watched)
    with pytest.raises(OSError):
        R.run_online_move(spark, dataset, FOUR, SPLIT, "id", so_far, tries=20)
    table_ = D.DeltaTable(spark, f"{dataset}.moving/left-right")
    assert table_.commit().position == seen[1][2] and table_.commit().base == "base-0"
    R.run_online_move(spark, dataset, FOUR, SPLIT, "id", so_far, tries=20, fold=False)
    assert len(seen) > 2 and table_.commit().base == "base-0"
    for (*_, before, _), (low, _, _, n) in zip(seen, seen[1:]):  # no round reads what an earlier one has read
        assert low is None or low > before
        assert n <= 90
    merged = {r.id: r.val for r in L.read_placed(spark, dataset, FOUR).collect()}
    assert len(merged) == 2000 and all(merged[r.id] == -max(i for i in range(1, 400) if i % 90 == r.id) for r in table_.changes().collect())
    table_.fold_into(dataset)
    assert {r.id: r.val for r in L.read_placed(spark, dataset, FOUR).collect()} == merged == {r.id: r.val for r in L.read_sharded(spark, dataset).collect()}
    table_.clean()
    assert L.read_placed(spark, dataset, FOUR).count() == 2000


def test_changed_content_is_refused(spark, dataset, monkeypatch):
    real = D.write_sharded
    moving = R.rows_moving(table(spark), R.moved_topology(FOUR, SPLIT), ["left", "right"]).first().id
    wrong = F.when(F.col("id") == moving, -1).otherwise(F.col("val")).cast("long")
    monkeypatch.setattr(D, "write_sharded", lambda rows, path, whole=False: real(rows.withColumn("val", wrong), path, whole))
    with pytest.raises(D.ContentLost):
        R.run_online_move(spark, dataset, FOUR, SPLIT, "id", lambda: spark.createDataFrame([], "op string, lsn long, id long, val long"))
    assert L.current_topology(spark, dataset, FOUR) == FOUR


def test_content_digest_sees_every_change(spark):
    rows = [(1, None, 2), (2, 3, None), (2, 3, None), (None, None, None)]
    make = lambda r: D.digest_of(spark.createDataFrame(r, "a long, b long, c long"), ["a", "b", "c"])
    assert make(rows) == make(rows[::-1])
    others = [rows[:-1], rows + rows[:1], [(1, 2, None), *rows[1:]], [(1, None, 3), *rows[1:]], [rows[0], rows[0], rows[0], rows[3]]]
    assert all(make(o) != make(rows) for o in others)
    assert make([]) == {"n": 0, "mixed": 0, "total": 0}


@pytest.mark.parametrize("compacts", [(), (1, 3)])
def test_delta_table_equals_replay(spark, tmp_path, compacts):
    draw = random.Random(3)
    want = {i: i for i in range(200)}
    target = D.DeltaTable(spark, str(tmp_path / "d"))
    base = spark.createDataFrame(list(want.items()), "id long, val long")
    target.create(assign_shard(base, FOUR), FOUR.shards, "id", "lsn")
    lsn = 0
    for k in range(5):
        log = []
        for _ in range(draw.choice([0, 40])):
            lsn += 1
            op, key = draw.choice("IUD"), draw.randrange(260)
            log.append((op, lsn, key, None if op == "D" else draw.randrange(1000)))
            if op == "D":
                want.pop(key, None)
            else:
                want[key] = log[-1][3]
        part = assign_shard(spark.createDataFrame(log, "op string, lsn long, id long, val long"), FOUR)
        target.append(part, lsn)
        target.append(part, lsn)  # the same round again finds nothing after the position
        if k in compacts:
            target.compact()
            assert target.commit().rounds == ()
        assert {r.id: r.val for r in target.read().collect()} == want
    target.clean()
    assert {r.id: r.val for r in target.read().collect()} == want


def test_split_then_merge_is_identity(spark, dataset):
    before = content(L.read_shard(spark, dataset, "shard-1"))
    after, _ = R.run_move(spark, dataset, FOUR, SPLIT)
    back = R.Move(("left", "right"), (Range("0x40000000", "0x7fffffff", "again"),))
    merged, _ = R.run_move(spark, dataset, after, back)
    assert content(L.read_shard(spark, dataset, "again")) == before
    assert content(R.active_rows(L.read_sharded(spark, dataset), merged)) == content(table(spark))


def test_deletes_keep_all_keys(spark):
    after = R.moved_topology(FOUR, SPLIT)
    source = assign_shard(table(spark), FOUR)
    kept = R.delete_moved(source, after, ["left", "right"])
    moved = R.rows_moving(source, after, ["left", "right"])
    row = R.conservation(source, kept, moved, after).first()
    assert row.conserved and row.n_before == 2000
    assert R.delete_foreign(moved, after, "left").count() + R.delete_foreign(moved, after, "right").count() == moved.count()
    lost = R.conservation(source, kept, moved.filter("id <> 0 OR true").limit(1), after).first()
    assert not lost.conserved


def test_writing_one_shard_leaves_the_others(spark, dataset):
    one = L.read_shard(spark, dataset, "shard-2").withColumn("val", F.lit(-1).cast("long"))
    L.write_sharded(spark.createDataFrame(one.collect(), one.schema), dataset)
    by_shard = L.read_sharded(spark, dataset).groupBy(SHARD).agg(F.max("val").alias("m"), F.count("*").alias("n"))
    top = {r[SHARD]: r.m for r in by_shard.collect()}
    assert top["shard-2"] == -1 and top["shard-0"] > 0 and by_shard.agg(F.sum("n")).first()[0] == 2000


def test_point_read_scans_only_its_shards(spark, dataset):
    rows = L.point_read(L.read_sharded(spark, dataset), FOUR, [1, 42])
    assert [r.val for r in rows.orderBy("id").collect()] == [10, 420]
    assert len(rows.inputFiles()) >= 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard-" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_best_effort_read(spark, dataset):
    paths = {s: f"{dataset}/{SHARD}={s}" for s in ("shard-0", "gone")}
    rows, failed = L.read_best_effort(spark, paths)
    assert {r[SHARD] for r in rows.select(SHARD).distinct().collect()} == {"shard-0"}
    assert [r.shard for r in failed.collect()] == ["gone"]
    with pytest.raises(RuntimeError):
        L.read_best_effort(spark, {"gone": paths["gone"]})


def test_best_effort_read_of_a_shard_that_breaks(spark, tmp_path):
    for name, data in (("good", [(1, 2)]), ("other", [(3, "x")]), ("broken", [(5, 6)] * 5000)):
        kinds = "id long, v string" if name == "other" else "id long, v long"
        spark.createDataFrame(data, kinds).coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "broken").glob("*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[4:60] = b"\xff" * 56  # the footer is whole, the pages are not
    part.write_bytes(bytes(raw))
    for crc in (tmp_path / "broken").glob(".*.crc"):
        crc.unlink()
    rows, failed = L.read_best_effort(spark, {n: str(tmp_path / n) for n in ("good", "other", "broken")})
    assert [tuple(r) for r in rows.collect()] == [(1, 2, "good")]
    assert {r.shard for r in failed.collect()} == {"other", "broken"}
    assert all(r.error for r in failed.collect())
    # the shards were read once: one that breaks afterwards leaves the rows as they were
    next((tmp_path / "good").glob("*.parquet")).unlink()
    assert [tuple(r) for r in rows.collect()] == [(1, 2, "good")]


def test_catch_up_of_a_copied_table(spark):
    """Rows 1 to 50 are copied, 51 to 100 arrive later, row 1 changes, some rows go."""
    snapshot = table(spark).filter("id BETWEEN 1 AND 50")
    log = [("I", i, i, i * 10) for i in range(51, 101)] + [("U", 101, 1, 999)]
    log += [("U", 200 + i, i, -1) for i in range(2, 101, 2)] + [("D", 400 + i, i, None) for i in range(91, 100, 3)]
    changes = spark.createDataFrame(log, "op string, lsn long, id long, val long")
    got = {r.id: r.val for r in C.apply_changes(snapshot, changes, "id", ["lsn"]).collect()}
    want = {i: i * 10 for i in range(1, 101)} | {1: 999} | {i: -1 for i in range(2, 101, 2)}
    assert got == {k: v for k, v in want.items() if k not in (91, 94, 97)}
    early = C.state_at(snapshot, changes, "id", ["lsn"], "lsn", F.lit(101))
    assert {r.id: r.val for r in early.collect()} == {i: i * 10 for i in range(1, 101)} | {1: 999}


def test_gate_needs_load_and_lag(spark):
    pending = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 0)], "t string, pending long")
    lag = spark.createDataFrame([("a", 0), ("b", 0), ("c", 17 << 20), ("d", 5), ("x", 0)], "t string, lag long")
    found = {r.t: (r.ready, r.drained) for r in C.catch_up_gate(pending, lag, "t").collect()}
    assert found == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (True, False), "e": (False, False), "x": (False, False)}


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (1, -5), (2, None), (3, 9)], "id long, val long")
    assert [tuple(r) for r in L.duplicate_keys(df, ["id"]).collect()] == [(1, 2)]
    assert [r.val for r in L.check_violations(df, F.col("val") >= 0).collect()] == [-5]
    parents = spark.createDataFrame([(5,), (9,), (9,)], "p long")
    assert [r.val for r in L.missing_parents(df, parents, "val", "p").collect()] == [-5]
    assert L.check_name("orders_2") == "orders_2"
    for name in ("Orders", "a-b", "../x", ""):
        with pytest.raises(ValueError):
            L.check_name(name)


def test_diff_samples_the_same_keys_on_both_sides(spark):
    left = table(spark)
    right = left.filter("id <> 7").withColumn("val", F.when(F.col("id") == 8, None).otherwise(F.col("val")))
    found = {r.id: r.problem for r in R.table_diff(left, right, "id", share=1).collect()}
    assert found == {7: "missing in target", 8: "different"}
    assert R.table_diff(left, left.select("val", "id"), "id", share=0.1).count() == 0


def test_bucketed_join_needs_no_exchange(spark, tmp_path):
    df = table(spark)
    L.write_bucketed(df, "bucketed_a", "id", 4, str(tmp_path / "a"))
    L.write_bucketed(df, "bucketed_b", "id", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")
