"""S queries: sources, sinks and checks of copied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators.placement import SHARD, assign_shard
from shardweave.plans.oracle import murmur3_sql
from shardweave.plans.placement import FOUR, ORDER_SHARDS_SQL
from shardweave.plans.registry import query, table
from shardweave.sources import events as E
from shardweave.sources import layout as L
from shardweave.sources.scratch import fresh_path
from shardweave.sources.topology import Range, Topology, parse_range_list, read_topology

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_written: dict[tuple[str, str], str] = {}


def sharded_orders(spark, sf_dir):
    """Path of the orders written by shard, once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _written:
        path = fresh_path(spark, "orders-by-shard")
        L.write_sharded(assign_shard(table(spark, sf_dir, "orders"), FOUR, strict=True), path)
        _written[at] = path
    return _written[at]


@query("s01_full_scan", f"WITH {ORDER_SHARDS_SQL} SELECT * EXCLUDE (h, shard) FROM placed WHERE shard = 'shard-1'")
def s01(spark, sf_dir):
    return L.read_shard(spark, sharded_orders(spark, sf_dir), "shard-1").drop(SHARD)


@query("s02_multi_shard_scan", f"WITH {ORDER_SHARDS_SQL} SELECT * EXCLUDE (h, shard), shard AS __shard FROM placed")
def s02(spark, sf_dir):
    return L.read_sharded(spark, sharded_orders(spark, sf_dir))


def discovered(spark, sf_dir):
    """Names of the tables found in the folder, with a row count each."""
    names = L.folder_tables(spark, sf_dir)
    counts = None
    for row in names.collect():
        one = table(spark, sf_dir, row.name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(row.name))
        counts = one if counts is None else counts.unionByName(one)
    return names.join(counts, "name")


COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES)


@query("s03_table_discovery", f"SELECT * FROM ({COUNTS_SQL}) ORDER BY name")
def s03(spark, sf_dir):
    return discovered(spark, sf_dir).orderBy("name")


@query("s04_exclude_reference_tables", f"SELECT * FROM ({COUNTS_SQL}) WHERE name NOT IN ('region', 'nation')")
def s04(spark, sf_dir):
    return L.exclude_tables(discovered(spark, sf_dir), ["Region", "NATION"])


@query("s05_create_target", "SELECT * FROM customer")
def s05(spark, sf_dir):
    source = table(spark, sf_dir, "customer")
    path = fresh_path(spark, "target")
    L.create_target(spark, source.schema, path)
    target = spark.read.parquet(path)
    source.select(*target.columns).write.mode("append").parquet(path)
    return spark.read.schema(target.schema).parquet(path)


@query(
    "s06_idempotent_sink",
    f"WITH {ORDER_SHARDS_SQL} SELECT shard AS __shard, count(*) AS n_rows, "
    "sum(CASE WHEN shard = 'shard-2' THEN 2 ELSE 1 END * o_orderkey)::BIGINT AS key_sum FROM placed WHERE shard <> 'shard-3' GROUP BY shard",
)
def s06(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    placed = assign_shard(orders, FOUR, strict=True)
    path = fresh_path(spark, "sink")
    L.write_sharded(placed, path)
    # a full load in which one shard has become empty, twice
    for _ in range(2):
        L.write_sharded(placed.filter(F.col(SHARD) != "shard-3"), path, whole=True)
    doubled = placed.filter(F.col(SHARD) == "shard-2").withColumn("o_orderkey", F.col("o_orderkey") * 2)
    L.write_sharded(doubled, path)
    return L.read_sharded(spark, path).groupBy(SHARD).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "s07_range_list_source",
    "SELECT o_orderkey, 0 AS pos, 'shard-' || (o_orderkey % 7) AS shard, (o_orderkey * 10)::VARCHAR AS lo, "
    "(o_orderkey * 10 + 4)::VARCHAR AS hi FROM orders UNION ALL SELECT o_orderkey, 1, 'shard-' || (o_custkey % 7), "
    "(o_orderkey * 10 + 5)::VARCHAR, (o_orderkey * 10 + 9)::VARCHAR FROM orders",
)
def s07(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("shard-"), key % 7, F.lit(":"), key * 10, F.lit(":"), key * 10 + 4, F.lit(",shard-"),
        F.col("o_custkey") % 7, F.lit(":"), key * 10 + 5, F.lit(":"), key * 10 + 9,
    )
    texts = table(spark, sf_dir, "orders").select(key, text.alias("text"))
    return parse_range_list(texts, "text").drop("text")


@query(
    "s08_topology_source",
    f"SELECT c_custkey, 'NATION_3-' || (h // 2147483648) AS shard FROM "
    f"(SELECT c_custkey, {murmur3_sql('c_custkey::VARCHAR')} AS h FROM customer)",
)
def s08(spark, sf_dir):
    halves = ((0, "0x00000000", "0x7fffffff"), (1, "0x80000000", "0xffffffff"))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for p, a, b in halves]))
    frame = table(spark, sf_dir, "nation").select("n_name", rows.alias("r")).select(
        F.lit("main").alias("cluster"), F.col("n_name").alias("keyspace"), "r.pos", "r.lo", "r.hi",
        F.concat_ws("-", "n_name", F.col("r.pos").cast("string")).alias("shard"), F.lit("hash").alias("vindex_type"),
        F.lit("c_custkey").alias("vindex_column"), F.lit("murmur3").alias("vindex_function"),
        F.lit(0).alias("virtual_nodes"), F.array().cast("array<string>").alias("reference_tables"),
        F.lit(False).alias("write_blocked"),
    )
    topology = read_topology(frame, "main", "NATION_3")
    return assign_shard(table(spark, sf_dir, "customer").select("c_custkey"), topology, "shard", strict=True)


@query(
    "s09_heartbeat_source",
    "SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN false ELSE true END AS has_status, "
    "CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS role, "
    "CASE WHEN event_type NOT IN ('signup', 'error') THEN floor(value * 1000)::BIGINT END AS lag FROM events",
)
def s09(spark, sf_dir):
    kind = F.col("event_type")
    body = F.to_json(F.struct(kind.alias("role"), F.floor(F.col("value") * 1000).alias("lagBytes")))
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "error", F.concat(F.lit("{"), body)).when(kind != "signup", body).alias("annotation")
    )
    status = F.col("status")
    return E.parse_heartbeats(raw, "annotation").select(
        "event_id", status.isNotNull().alias("has_status"), status["role"].alias("role"), status["lagBytes"].alias("lag")
    )


@query(
    "s10_change_source",
    "SELECT event_id AS lsn, 'user' AS tbl, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, "
    "user_id::VARCHAR AS key, value FROM events WHERE event_type <> 'view'",
)
def s10(spark, sf_dir):
    return E.changes_of(E.events_as_changes(table(spark, sf_dir, "events")), ["user"]).select("lsn", "tbl", "op", "key", "value")


@query(
    "s11_metric_source",
    "SELECT event_type, user_id % 3 AS zone, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL",
)
def s11(spark, sf_dir):
    samples = E.events_as_samples(table(spark, sf_dir, "events"))
    return samples.groupBy(F.col("labels")["kind"].alias("event_type"), F.col("labels")["zone"].cast("long").alias("zone")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")
    )


@query(
    "s12_uniqueness_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def s12(spark, sf_dir):
    return L.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "s13_check_constraint",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (nullif(o_custkey % 50, 0) > 5 OR o_totalprice > 400000)",
)
def s13(spark, sf_dir):
    check = F.expr("nullif(o_custkey % 50, 0) > 5 OR o_totalprice > 400000")
    return L.check_violations(table(spark, sf_dir, "orders"), check).select("o_orderkey", "o_custkey")


@query(
    "s14_foreign_key_report",
    "SELECT 'lineitem.l_orderkey' AS fk, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) "
    "UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer)",
)
def s14(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    users = table(spark, sf_dir, "events").select((F.col("user_id") * 11).alias("parent"))
    customers = table(spark, sf_dir, "customer")
    checks = {
        "lineitem.l_orderkey": L.missing_parents(lines, orders, "l_orderkey", "o_orderkey"),
        "events.user_id": L.missing_parents(users, customers, "parent", "c_custkey"),
    }
    reports = [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("fk", F.lit(fk)) for fk, df in checks.items()]
    return reports[0].unionByName(reports[1])


@query(
    "s15_key_range_read",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'AZ' AND 'HZ'",
)
def s15(spark, sf_dir):
    rule = Topology(
        "c_mktsegment", (Range("A", "AZ", "s-a"), Range("B", "FZ", "s-b"), Range("G", "LZ", "s-c"), Range("M", "ZZ", "s-d")),
        vindex_type="range",
    )
    path = fresh_path(spark, "customers-by-segment")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    L.write_sharded(assign_shard(customers, rule, strict=True), path)
    return L.key_range_read(L.read_sharded(spark, path), rule, "AZ", "HZ").drop(SHARD)
