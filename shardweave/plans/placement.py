"""V queries: hashing keys and placing rows on shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.functions.hashing import key_text, with_key_hash
from shardweave.operators import placement as P
from shardweave.operators.intervals import dyadic_join, interval_join
from shardweave.plans.oracle import crc32_sql, fnv1a_sql, murmur3_sql, quarter_shard_sql
from shardweave.plans.registry import query, spread, table
from shardweave.sources.topology import Range, Topology, equal_hash_topology

FOUR = equal_hash_topology("o_orderkey", 4)
SEGMENTS = Topology(
    "c_mktsegment",
    (Range("A", "B", "shard-0"), Range("B", "FZ", "shard-1"), Range("HOUSEHOLD", "HOUSEHOLD", "shard-2")),
    vindex_type="range",
)
RING_3 = Topology(
    "o_orderkey",
    tuple(Range("", "", f"shard-{i}") for i in range(3)),
    vindex_type="consistent-hash",
    virtual_nodes=160,
)
RING_4 = RING_3.with_ranges([*RING_3.ranges, Range("", "", "shard-3")])
PARTIAL = FOUR.with_ranges([FOUR.ranges[0], Range("0x60000000", "0xbfffffff", "shard-1")])

ORDER_SHARDS_SQL = (
    f"placed AS (SELECT *, {quarter_shard_sql('h')} AS shard "
    f"FROM (SELECT *, {murmur3_sql('o_orderkey::VARCHAR')} AS h FROM orders))"
)


def ring_sql(name: str, shards: int, vnodes: int) -> str:
    return (
        f"{name} AS (SELECT h AS point, min(s) AS s FROM (SELECT s, {murmur3_sql('node')} AS h FROM "
        f"(SELECT 'shard-' || a.i AS s, 'shard-' || a.i || ':' || b.v AS node "
        f"FROM range({shards}) a(i), range({vnodes}) b(v))) GROUP BY h)"
    )


def ring_owner_sql(ring: str, source: str) -> str:
    """(key, shard) of every (key, h) row of ``source``."""
    return (
        f"SELECT k.key, coalesce(r.s, (SELECT min_by(s, point) FROM {ring})) AS shard "
        f"FROM {source} k ASOF LEFT JOIN {ring} r ON k.h <= r.point"
    )


HASHED_ORDERS_SQL = f"hashed AS (SELECT o_orderkey AS key, {murmur3_sql('o_orderkey::VARCHAR')} AS h FROM orders)"


@query("v01_murmur3_hash", f"SELECT o_orderkey, {murmur3_sql('o_orderkey::VARCHAR')} AS h FROM orders")
def v01(spark, sf_dir):
    return with_key_hash(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "murmur3", "h")


@query("v02_fnv_hash", f"SELECT c_name, {fnv1a_sql('c_name')} AS h FROM customer")
def v02(spark, sf_dir):
    return with_key_hash(table(spark, sf_dir, "customer").select("c_name"), "c_name", "fnv", "h")


@query("v03_crc32_hash", f"SELECT p_partkey, p_name, {crc32_sql('p_name')} AS h FROM part")
def v03(spark, sf_dir):
    return with_key_hash(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "crc32", "h")


@query("v04_resolve_hash", f"WITH {ORDER_SHARDS_SQL} SELECT o_orderkey, shard FROM placed")
def v04(spark, sf_dir):
    return P.assign_shard(table(spark, sf_dir, "orders").select("o_orderkey"), FOUR, "shard")


@query(
    "v05_resolve_range",
    "SELECT c_custkey, CASE WHEN c_mktsegment BETWEEN 'A' AND 'B' THEN 'shard-0' "
    "WHEN c_mktsegment BETWEEN 'B' AND 'FZ' THEN 'shard-1' "
    "WHEN c_mktsegment BETWEEN 'HOUSEHOLD' AND 'HOUSEHOLD' THEN 'shard-2' END AS shard FROM customer",
)
def v05(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return P.assign_shard(customers, SEGMENTS, "shard").drop("c_mktsegment")


@query(
    "v06_ring_build",
    f"SELECT s_name, vnode::INTEGER AS vnode, {murmur3_sql('node')} AS hash FROM "
    "(SELECT s_name, v AS vnode, s_name || ':' || v AS node FROM supplier, range(64) b(v))",
)
def v06(spark, sf_dir):
    return P.ring_points(table(spark, sf_dir, "supplier"), "s_name", 64)


@query(
    "v07_ring_lookup",
    f"WITH {ring_sql('ring', 4, 160)}, {HASHED_ORDERS_SQL} "
    f"SELECT key AS o_orderkey, shard FROM ({ring_owner_sql('ring', 'hashed')})",
)
def v07(spark, sf_dir):
    return P.assign_shard(spread(table(spark, sf_dir, "orders").select("o_orderkey")), RING_4, "shard")


@query(
    "v08_lookup_vindex",
    "SELECT o_orderkey, 'shard-' || (c_nationkey % 4) AS shard FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def v08(spark, sf_dir):
    mapping = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.concat(F.lit("shard-"), F.col("c_nationkey") % 4).alias("shard")
    )
    rule = Topology("o_custkey", FOUR.ranges, vindex_type="lookup")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return P.assign_shard(orders, rule, "shard", mapping=mapping).select("o_orderkey", "shard")


def _node_ring_sql(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT h AS point, min(s) AS s FROM (SELECT s, {murmur3_sql('node')} AS h FROM "
        f"(SELECT {source}, {source.split()[0]} || ':' || v AS node FROM {name}_shards, range(64) b(v))) GROUP BY h)"
    )


@query(
    "v07_large_ring_lookup",
    f"WITH ring_shards AS (SELECT * FROM supplier), {_node_ring_sql('ring', 's_name AS s')}, "
    f"hashed AS (SELECT p_partkey AS key, {murmur3_sql('p_partkey::VARCHAR')} AS h FROM part) "
    f"SELECT key AS p_partkey, shard AS s_name FROM ({ring_owner_sql('ring', 'hashed')})",
)
def v07_large(spark, sf_dir):
    points = P.ring_points(table(spark, sf_dir, "supplier"), "s_name", 64)
    return P.ring_lookup(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", points, "s_name")


@query(
    "v09_binned_interval_join",
    f"WITH ring_shards AS (SELECT * FROM nation), {_node_ring_sql('ring', 'n_name AS s')}, "
    f"hashed AS (SELECT p_partkey AS key, {murmur3_sql('p_partkey::VARCHAR')} AS h FROM part) "
    f"SELECT key AS p_partkey, shard AS n_name FROM ({ring_owner_sql('ring', 'hashed')})",
)
def v09(spark, sf_dir):
    # Nations times 64 virtual nodes is a bounded list; Spark broadcasts it by its size.
    ring = P.ring_intervals(P.ring_points(table(spark, sf_dir, "nation"), "n_name", 64), "n_name")
    parts = with_key_hash(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return interval_join(parts, "__hash", ring, "lo", "hi").select("p_partkey", "n_name")


@query(
    "v09_dyadic_interval_join",
    f"WITH i AS (SELECT s_suppkey, {murmur3_sql('s_suppkey::VARCHAR')} AS lo FROM supplier), "
    f"v AS (SELECT p_partkey, {murmur3_sql('p_partkey::VARCHAR')} AS h FROM part) "
    "SELECT p_partkey, count(s_suppkey) AS n_intervals, coalesce(sum(s_suppkey), 0)::BIGINT AS keys FROM v "
    "LEFT JOIN i ON h BETWEEN lo AND lo + s_suppkey % 97 * 5000000 GROUP BY p_partkey",
)
def v09_dyadic(spark, sf_dir):
    """Overlapping and nested intervals of very different widths: how many cover the hash of each part."""
    owners = with_key_hash(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    intervals = owners.select("s_suppkey", F.col("__hash").alias("lo"), (F.col("__hash") + F.col("s_suppkey") % 97 * 5_000_000).alias("hi"))
    parts = with_key_hash(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    sums = {"n_intervals": F.col("s_suppkey").isNotNull().cast("long"), "keys": F.col("s_suppkey")}
    found = dyadic_join(parts, "__hash", intervals, "lo", "hi", how="left", bits=33, sums=sums)
    return found.groupBy("p_partkey").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in sums])


@query(
    "v10_assign_table",
    f"SELECT {quarter_shard_sql('h')} AS shard, l_linenumber, count(*) AS n_rows, "
    "sum(l_quantity)::BIGINT AS quantity FROM (SELECT l_linenumber, l_quantity, "
    f"{murmur3_sql('l_orderkey::VARCHAR')} AS h FROM lineitem) GROUP BY ALL",
)
def v10(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    placed = P.assign_shard(lines, equal_hash_topology("L_ORDERKEY", 4), "shard")
    return placed.groupBy("shard", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("quantity")
    )


@query(
    "v11_unmatched_keys",
    f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, {murmur3_sql('o_orderkey::VARCHAR')} AS h FROM orders) "
    "WHERE h BETWEEN 1073741824 AND 1610612735 OR h > 3221225471",
)
def v11(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return P.assign_shard(orders, PARTIAL).filter(F.col(P.SHARD).isNull()).drop(P.SHARD)


@query(
    "v12_shard_distribution",
    f"WITH {ORDER_SHARDS_SQL}, counts AS (SELECT shard, count(*) AS n_rows FROM placed GROUP BY shard) "
    "SELECT shard, n_rows, round(n_rows / avg(n_rows) OVER (), 6) AS ratio FROM counts",
)
def v12(spark, sf_dir):
    placed = P.assign_shard(table(spark, sf_dir, "orders").select("o_orderkey"), FOUR, "shard")
    return P.shard_distribution(placed, "shard")


@query(
    "v13_movement",
    f"WITH {ring_sql('ring3', 3, 160)}, {ring_sql('ring4', 4, 160)}, {HASHED_ORDERS_SQL}, "
    f"a AS ({ring_owner_sql('ring3', 'hashed')}), b AS ({ring_owner_sql('ring4', 'hashed')}), "
    "pairs AS (SELECT a.shard AS from_shard, b.shard AS to_shard, count(*) AS n_rows FROM a JOIN b USING (key) GROUP BY ALL) "
    "SELECT from_shard, to_shard, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share, "
    "from_shard <> to_shard AS moved FROM pairs",
)
def v13(spark, sf_dir):
    return P.movement(spread(table(spark, sf_dir, "orders").select("o_orderkey")), RING_3, RING_4)


@query(
    "v14_key_normalization",
    f"SELECT o_orderkey, key, {murmur3_sql('key')} AS h FROM "
    "(SELECT o_orderkey, coalesce(nullif(o_custkey % 50, 0)::VARCHAR, '') AS key FROM orders)",
)
def v14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("raw")
    )
    keyed = orders.withColumn("key", key_text(orders, "raw"))
    return with_key_hash(keyed, "raw", "murmur3", "h").drop("raw")


