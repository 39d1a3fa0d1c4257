"""M queries: moving rows between shards and catching up with changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import changes as C
from shardweave.operators import reshard as R
from shardweave.operators.placement import SHARD, assign_shard
from shardweave.plans.layouts import sharded_orders
from shardweave.plans.oracle import murmur3_sql
from shardweave.plans.placement import FOUR, ORDER_SHARDS_SQL
from shardweave.plans.registry import query, table
from shardweave.sources.deltas import DeltaTable
from shardweave.sources.layout import read_placed, read_sharded, write_sharded
from shardweave.sources.scratch import fresh_path
from shardweave.sources.topology import Range, equal_hash_topology

SPLIT = R.split_move(FOUR, "shard-3", ("shard-3a", "shard-3b"))
AFTER = FOUR.with_ranges([*FOUR.ranges[:3], *SPLIT.targets])
MERGE = R.Move(("shard-2", "shard-3"), (Range("0x80000000", "0xffffffff", "shard-23"),))


def after_sql(h: str) -> str:
    return (
        f"CASE WHEN {h} < 3221225472 THEN 'shard-' || ({h} // 1073741824) "
        f"WHEN {h} < 3758096384 THEN 'shard-3a' ELSE 'shard-3b' END"
    )


AFTER_SQL = f"{ORDER_SHARDS_SQL}, moved AS (SELECT *, {after_sql('h')} AS new_shard FROM placed)"


def orders_with_shard(spark, sf_dir):
    return read_sharded(spark, sharded_orders(spark, sf_dir)).select("o_orderkey", "o_custkey", SHARD)


@query("m01_full_copy", "SELECT *, (SELECT count(*) FROM supplier) AS copied FROM supplier")
def m01(spark, sf_dir):
    path = fresh_path(spark, "copy")
    copied = R.copy_table(table(spark, sf_dir, "supplier"), path)
    return spark.read.parquet(path).withColumn("copied", F.lit(copied).cast("long"))


@query(
    "m02_range_copy",
    f"WITH {AFTER_SQL} SELECT o_orderkey, o_custkey, new_shard AS __shard, "
    "(SELECT count(*) FROM moved WHERE shard = 'shard-3') AS scanned FROM moved WHERE shard = 'shard-3'",
)
def m02(spark, sf_dir):
    source = orders_with_shard(spark, sf_dir).filter(F.col(SHARD) == "shard-3")
    path = fresh_path(spark, "range-copy")
    report = R.copy_ranges(source, AFTER, ["shard-3a", "shard-3b"], path)
    return read_sharded(spark, path).withColumn("scanned", F.lit(report["scanned"]).cast("long"))


@query(
    "m03_delete_moved",
    f"WITH {AFTER_SQL} SELECT o_orderkey, o_custkey, shard AS __shard FROM moved WHERE new_shard <> 'shard-3b'",
)
def m03(spark, sf_dir):
    return R.delete_moved(orders_with_shard(spark, sf_dir), AFTER, ["shard-3b"])


@query(
    "m04_delete_foreign",
    f"WITH {AFTER_SQL} SELECT o_orderkey, o_custkey, shard AS __shard FROM moved WHERE new_shard = 'shard-3a'",
)
def m04(spark, sf_dir):
    return R.delete_foreign(orders_with_shard(spark, sf_dir), AFTER, "shard-3a")


def snapshot_and_changes(spark, sf_dir):
    """Orders as (id, val) and events as changes of ids, some of them new."""
    snapshot = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("val")
    )
    kind = F.col("event_type")
    changes = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"),
        F.col("ts").alias("commit_ts"),
        F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op"),
        (F.col("user_id") * 100 + F.col("event_id") % 50).alias("id"),
        F.floor("value").cast("long").alias("val"),
    )
    return snapshot, changes


CHANGES_SQL = (
    "snap AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS val FROM orders), "
    "log AS (SELECT event_id AS lsn, ts AS commit_ts, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, "
    "user_id * 100 + event_id % 50 AS id, floor(value)::BIGINT AS val FROM events)"
)


def state_sql(condition: str) -> str:
    return (
        f"net AS (SELECT id, arg_max(op, lsn) AS op, arg_max(val, lsn) AS val FROM log WHERE {condition} GROUP BY id) "
        "SELECT id, val FROM snap ANTI JOIN net USING (id) UNION ALL SELECT id, val FROM net WHERE op <> 'D'"
    )


@query("m05_online_catch_up", f"WITH {CHANGES_SQL}, {state_sql('true')}")
def m05(spark, sf_dir):
    snapshot, changes = snapshot_and_changes(spark, sf_dir)
    return C.apply_changes(snapshot, changes, "id", ["lsn"])


@query("m05_delta_catch_up", f"WITH {CHANGES_SQL}, {state_sql('true')}")
def m05_deltas(spark, sf_dir):
    """The log comes in three parts; each round writes the keys of its part, the base is written anew once."""
    snapshot, changes = snapshot_and_changes(spark, sf_dir)
    topology = equal_hash_topology("id", 4)
    target = DeltaTable(spark, fresh_path(spark, "deltas"))
    target.create(assign_shard(snapshot, topology, strict=True), topology.shards, "id", "lsn")
    log = assign_shard(changes, topology, strict=True)
    last = changes.agg(F.max("lsn")).first()[0] or 0
    for k in (1, 2, 3):
        target.append(log, last * k // 3)
        if k == 2:
            target.compact()
    return target.read().select("id", "val")


STATES_SQL = (
    "s AS (SELECT o_custkey AS target, CASE WHEN o_orderkey % 23 = 0 THEN 'd' WHEN o_orderkey % 2 = 0 THEN 'r' ELSE 's' END AS state FROM orders), "
    "pending AS (SELECT target, count(*) FILTER (state NOT IN ('r', 's')) + greatest(9 + target % 3 - count(*), 0) AS pending FROM s GROUP BY target)"
)


def load_states(spark, sf_dir):
    key = F.col("o_orderkey")
    states = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("target"), F.when(key % 23 == 0, "d").when(key % 2 == 0, "r").otherwise("s").alias("state")
    )
    return C.pending_tables(states, "target", "state", F.col("target") % 3 + 9)


@query("m06_initial_load", f"WITH {STATES_SQL} SELECT * FROM pending")
def m06(spark, sf_dir):
    return load_states(spark, sf_dir)


LAG_SQL = (
    "lag AS (SELECT user_id AS target, coalesce(max(event_id * 4096) - max(event_id * 4096) FILTER (event_type = 'purchase' AND value > 60), -1) AS lag "
    "FROM events GROUP BY user_id)"
)


def target_lag(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("target"), (F.col("event_id") * 4096).alias("lsn"), "event_type", "value"
    )
    applied = log.filter("event_type = 'purchase' AND value > 60")
    return C.lag_bytes(log, applied, "target")


@query("m07_lag_bytes", f"WITH {LAG_SQL} SELECT * FROM lag")
def m07(spark, sf_dir):
    return target_lag(spark, sf_dir)


@query(
    "m08_catch_up_gate",
    f"WITH {STATES_SQL}, {LAG_SQL}, g AS (SELECT target, pending, coalesce(lag, -1) AS lag FROM pending FULL JOIN lag USING (target)) "
    "SELECT *, coalesce(pending = 0, false) AND lag BETWEEN 0 AND 2097152 AS ready, coalesce(pending = 0, false) AND lag = 0 AS drained FROM g",
)
def m08(spark, sf_dir):
    return C.catch_up_gate(load_states(spark, sf_dir), target_lag(spark, sf_dir), "target", 2 << 20)


def own_copy(spark, sf_dir, name, key):
    """A table written by shard for one query alone, because the query adds shards to it."""
    path = fresh_path(spark, name)
    write_sharded(assign_shard(table(spark, sf_dir, name), equal_hash_topology(key, 4), strict=True), path)
    return path


def online_split(spark, sf_dir, fold=True):
    """A split of the orders while changes come in: the path of the dataset and the report per target."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = fresh_path(spark, "orders")
    write_sharded(assign_shard(orders, FOUR, strict=True), path)
    key, lsn = F.col("o_orderkey"), F.col("o_orderkey").alias("lsn")
    op = F.when(key % 11 == 0, "D").otherwise("U").alias("op")
    changed = orders.filter("o_orderkey % 11 = 0 OR o_orderkey % 10 = 0").select(lsn, op, "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"))
    new = orders.filter("o_orderkey % 13 = 0 AND o_orderkey > 0").select(lsn, F.lit("I").alias("op"), (-key).alias("o_orderkey"), "o_custkey")
    log, reads = changed.unionByName(new), []

    def changes():
        # the beginning of the log is there when the move begins, the rest comes during the first round
        reads.append(1)
        return log.filter("lsn <= 1000") if len(reads) <= 2 else log

    return path, R.run_online_move(spark, path, FOUR, SPLIT, "o_orderkey", changes, fold=fold)[1]


SPLIT_SQL = f"""{ORDER_SHARDS_SQL},
  kept AS (SELECT o_orderkey, o_custkey + CASE WHEN h >= 3221225472 AND o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS o_custkey, h
    FROM placed WHERE h < 3221225472 OR o_orderkey % 11 <> 0),
  added AS (SELECT * FROM (SELECT -o_orderkey AS o_orderkey, o_custkey, {murmur3_sql("(-o_orderkey)::VARCHAR")} AS h
    FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey > 0) WHERE h >= 3221225472),
  split AS (SELECT o_orderkey, o_custkey, {after_sql("h")} AS __shard FROM (SELECT * FROM kept UNION ALL SELECT * FROM added))"""


@query("m09_split_run", f"WITH {SPLIT_SQL} SELECT * FROM split")
def m09(spark, sf_dir):
    path, _ = online_split(spark, sf_dir, fold=False)
    # the targets are still base and rounds of changes, merged by this read
    return read_placed(spark, path, FOUR).select("o_orderkey", "o_custkey", SHARD)


@query(
    "m10_merge_shards",
    f"WITH {ORDER_SHARDS_SQL} SELECT o_orderkey, o_custkey, CASE WHEN shard IN ('shard-2', 'shard-3') THEN 'shard-23' ELSE shard END AS __shard FROM placed",
)
def m10(spark, sf_dir):
    path = own_copy(spark, sf_dir, "orders", "o_orderkey")
    after, _ = R.run_move(spark, path, FOUR, MERGE)
    return R.active_rows(read_sharded(spark, path), after).select("o_orderkey", "o_custkey", SHARD)


MOVED = (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("customer", "c_custkey"))


def _moved_sql(name: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS name, count(*) FILTER (h >= 3221225472) AS copied, "
        f"count(*) FILTER (h >= 3221225472) AS scanned FROM (SELECT {murmur3_sql(key + '::VARCHAR')} AS h FROM {name})"
    )


@query("m11_multi_table_move", " UNION ALL ".join(_moved_sql(n, k) for n, k in MOVED))
def m11(spark, sf_dir):
    tables = {name: (own_copy(spark, sf_dir, name, key), key) for name, key in MOVED}
    return R.move_tables(spark, tables, FOUR, SPLIT)[1]


@query(
    "m12_key_conservation",
    "SELECT count(*) AS n_before, count(*) AS n_after, 0 AS n_misplaced, true AS conserved FROM orders",
)
def m12(spark, sf_dir):
    source = orders_with_shard(spark, sf_dir)
    kept = R.delete_moved(source, AFTER, ["shard-3a", "shard-3b"])
    moved = R.rows_moving(source, AFTER, ["shard-3a", "shard-3b"]).select(*source.columns)
    return R.conservation(source, kept, moved, AFTER)


@query(
    "m12_content_conservation",
    f"WITH {AFTER_SQL}, c AS (SELECT new_shard AS target, count(*) AS n FROM moved WHERE shard = 'shard-3' GROUP BY 1) "
    "SELECT target, n AS n_source, n AS n_target, true AS same, target = 'shard-3a' AS same_flipped FROM c",
)
def m12_content(spark, sf_dir):
    """Content of each target against what the sources hold for it, and against targets with one value changed."""
    source = assign_shard(orders_with_shard(spark, sf_dir).filter(F.col(SHARD) == "shard-3").drop(SHARD), AFTER, strict=True)
    path = fresh_path(spark, "range-copy")
    R.copy_ranges(source, AFTER, ["shard-3a", "shard-3b"], path)
    target = read_sharded(spark, path)
    least = target.filter(F.col(SHARD) == "shard-3b").agg(F.min("o_orderkey")).first()[0]
    flipped = target.withColumn("o_custkey", F.when(F.col("o_orderkey") == least, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    columns = ["o_orderkey", "o_custkey"]
    return R.content_conservation(source, {"target": target, "flipped": flipped}, columns).select(
        F.col(SHARD).alias("target"), F.col("n_source"), F.col("n_target"), F.col("same_target").alias("same"), "same_flipped"
    )


@query(
    "m13_table_diff",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'missing in target' ELSE 'different' END AS problem "
    "FROM orders WHERE o_orderkey % 101 = 0 OR o_custkey % 37 = 0 "
    "UNION ALL SELECT -1 - o_orderkey, 'only in target' FROM orders WHERE o_orderkey % 211 = 0",
)
def m13(spark, sf_dir):
    left = table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_custkey") % 37 == 0, "X").otherwise(F.col("o_orderstatus"))
    right = left.filter("o_orderkey % 101 <> 0").withColumn("o_orderstatus", changed)
    extra = left.filter("o_orderkey % 211 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return R.tree_diff(left, right.unionByName(extra), "o_orderkey")


@query(
    "m14_split_progress",
    f"WITH {SPLIT_SQL} SELECT __shard AS target, count(*) AS done, count(*) AS total, 1.0::DOUBLE AS share FROM split "
    "WHERE __shard IN ('shard-3a', 'shard-3b') GROUP BY 1",
)
def m14(spark, sf_dir):
    return R.split_progress(online_split(spark, sf_dir)[1], "target")
