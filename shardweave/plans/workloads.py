"""W queries: a statement log derived from the orders, one statement per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import workload as W
from shardweave.operators.scan import DAY, micros
from shardweave.plans.oracle import murmur3_sql, quarter_shard_sql
from shardweave.plans.registry import query, spread, table
from shardweave.sources.topology import equal_hash_topology

RULE = equal_hash_topology("o_orderkey", 4, reference_tables=("nation", "region"))

# {k} is the order key, {n} the next one, {c} the customer key.
STATEMENTS = (
    "SELECT * FROM orders WHERE o_orderkey = {k}",
    "UPDATE public.orders SET note = 'for k' WHERE status = 'P' AND o_orderkey = '{k}'",
    "INSERT INTO orders (o_custkey, O_ORDERKEY) VALUES ({c}, {k})",
    "INSERT INTO orders (o_orderkey, o_custkey) VALUES ({k}, 1), ('{n}', 2), ({c}, 3) RETURNING o_orderkey",
    "SELECT count(*) FROM orders WHERE o_custkey = {c}",
    "DELETE FROM orders WHERE o_custkey = {c}",
    "SELECT * FROM nation JOIN ref.Region ON n_regionkey = r_regionkey JOIN nation n ON true",
    "SELECT * FROM orders WHERE o_orderkey = {k} OR o_orderkey = {n}",
    "SELECT * FROM orders o JOIN sales.customer c ON true WHERE o_orderkey = {k} FOR UPDATE",
    "INSERT INTO orders (o_orderkey, x) VALUES (DEFAULT, 1), ({k}, 2)",
)


def statement_log(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = key % len(STATEMENTS)
    sql = None
    for i, text in enumerate(STATEMENTS):
        filled = F.lit(text)
        for mark, value in (("{k}", key), ("{n}", key + 1), ("{c}", customer)):
            filled = F.replace(filled, F.lit(mark), value.cast("string"))
        sql = F.when(pick == i, filled) if sql is None else sql.when(pick == i, filled)
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return orders.select(
        key.alias("stmt_id"),
        F.expr("o_orderkey div 4").alias("tx_id"),
        F.concat(F.lit("ks"), customer % 25).alias("keyspace"),
        micros("o_orderdate").alias("at"),
        sql.alias("sql"),
    )


def by_pick(cases: dict[int, str]) -> str:
    """What the statement generator put in, as SQL over the orders."""
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {v}" for i, v in cases.items()) + " END"


KEY, NEXT, CUSTOMER = "o_orderkey::VARCHAR", "(o_orderkey + 1)::VARCHAR", "o_custkey::VARCHAR"


@query(
    "w01_key_by_column",
    f"SELECT o_orderkey AS stmt_id, {by_pick({0: KEY, 1: KEY, 7: KEY, 8: KEY})} AS key FROM orders",
)
def w01(spark, sf_dir):
    return statement_log(spark, sf_dir).select("stmt_id", W.key_by_column(F.col("sql"), "o_orderkey").alias("key"))


@query("w02_first_literal", f"SELECT o_orderkey AS stmt_id, {by_pick({1: chr(39) + 'P' + chr(39)})} AS key FROM orders")
def w02(spark, sf_dir):
    return statement_log(spark, sf_dir).select("stmt_id", W.first_literal(F.col("sql")).alias("key"))


@query("w03_insert_key", f"SELECT o_orderkey AS stmt_id, {by_pick({2: KEY, 3: KEY})} AS key FROM orders")
def w03(spark, sf_dir):
    return statement_log(spark, sf_dir).select("stmt_id", W.insert_key(F.col("sql"), "o_orderkey").alias("key"))


@query(
    "w04_multi_row_insert_keys",
    f"SELECT o_orderkey AS stmt_id, {by_pick({2: KEY, 3: f'{KEY} || chr(44) || {NEXT} || chr(44) || {CUSTOMER}'})} AS keys FROM orders",
)
def w04(spark, sf_dir):
    keys = F.array_join(W.insert_keys(F.col("sql"), "o_orderkey"), ",")
    return statement_log(spark, sf_dir).select("stmt_id", keys.alias("keys"))


@query(
    "w05_ambiguous_key",
    f"SELECT o_orderkey AS stmt_id, {by_pick({0: KEY, 1: KEY, 8: KEY})} AS key, o_orderkey % 10 = 7 AS ambiguous FROM orders",
)
def w05(spark, sf_dir):
    sql = F.col("sql")
    return statement_log(spark, sf_dir).select(
        "stmt_id",
        W.unambiguous_key(sql, "o_orderkey").alias("key"),
        (F.size(W.column_literals(sql, "o_orderkey")) > 1).alias("ambiguous"),
    )


@query("w06_read_only_flag", "SELECT o_orderkey AS stmt_id, o_orderkey % 10 IN (0, 4, 6, 7) AS read FROM orders")
def w06(spark, sf_dir):
    return statement_log(spark, sf_dir).select("stmt_id", W.is_read_only(F.col("sql")).alias("read"))


@query(
    "w07_tables_touched",
    "SELECT o_orderkey AS stmt_id, CASE o_orderkey % 10 WHEN 6 THEN 'nation,region' WHEN 8 THEN 'orders,customer' "
    "ELSE 'orders' END AS tables FROM orders",
)
def w07(spark, sf_dir):
    return statement_log(spark, sf_dir).select("stmt_id", F.array_join(W.tables_touched(F.col("sql")), ",").alias("tables"))


KEYS_SQL = (
    "k AS (SELECT o_orderkey AS stmt_id, o_orderkey // 4 AS tx_id, unnest(list_distinct(CASE "
    f"WHEN o_orderkey % 10 IN (0, 1, 2, 8) THEN [{KEY}] WHEN o_orderkey % 10 = 3 THEN [{KEY}, {NEXT}, {CUSTOMER}] END)) AS key FROM orders), "
    f"ks AS (SELECT stmt_id, tx_id, key, {quarter_shard_sql('h')} AS shard FROM (SELECT *, {murmur3_sql('key')} AS h FROM k))"
)
ROUTED_SQL = (
    f"{KEYS_SQL}, span AS (SELECT stmt_id, min(shard) AS a, max(shard) AS b FROM ks GROUP BY stmt_id), "
    "decided AS (SELECT o_orderkey AS stmt_id, o_orderkey % 10 IN (0, 4, 6, 7) AS read, CASE WHEN o_orderkey % 10 = 6 THEN 'any shard' "
    "WHEN a < b THEN 'reject: several shards' WHEN a IS NOT NULL THEN 'single' WHEN o_orderkey % 10 IN (4, 7) THEN 'scatter' "
    "ELSE 'reject: write without key' END AS decision, a FROM orders LEFT JOIN span ON o_orderkey = stmt_id), "
    "routed AS (SELECT stmt_id, read, decision, CASE decision WHEN 'single' THEN a WHEN 'any shard' THEN 'shard-0' END AS shard FROM decided)"
)


@query("w08_routing_decision", f"WITH {ROUTED_SQL} SELECT * FROM routed")
def w08(spark, sf_dir):
    return W.route(statement_log(spark, sf_dir), RULE)


@query(
    "w09_cross_shard_inserts",
    f"WITH {KEYS_SQL} SELECT stmt_id, count(DISTINCT shard) AS n_shards FROM ks GROUP BY stmt_id HAVING count(DISTINCT shard) > 1",
)
def w09(spark, sf_dir):
    return W.cross_shard_inserts(statement_log(spark, sf_dir), RULE)


@query(
    "w10_workload_report",
    f"WITH {ROUTED_SQL}, c AS (SELECT decision, shard, count(*) AS n FROM routed GROUP BY ALL) "
    "SELECT *, round(n / sum(n) OVER (), 6) AS share FROM c",
)
def w10(spark, sf_dir):
    return W.workload_report(W.route(statement_log(spark, sf_dir), RULE))


@query(
    "w10_hot_keys",
    f"WITH {KEYS_SQL} SELECT key, shard, count(*) AS n FROM ks GROUP BY ALL ORDER BY n DESC, key LIMIT 20",
)
def w10_hot(spark, sf_dir):
    return W.hot_keys(statement_log(spark, sf_dir), RULE, 20)


@query(
    "w11_transaction_span",
    f"WITH {KEYS_SQL}, t AS (SELECT DISTINCT o_orderkey // 4 AS tx_id FROM orders), "
    "n AS (SELECT t.tx_id, count(DISTINCT shard) AS n_shards FROM t LEFT JOIN ks ON t.tx_id = ks.tx_id GROUP BY 1) "
    "SELECT *, CASE n_shards WHEN 0 THEN 'empty' WHEN 1 THEN 'local' ELSE 'distributed' END AS span FROM n",
)
def w11(spark, sf_dir):
    return W.transaction_span(statement_log(spark, sf_dir), RULE)


@query(
    "w12_write_block_filter",
    "SELECT o_orderkey AS stmt_id FROM orders ANTI JOIN nation ON o_custkey % 25 = n_nationkey "
    "AND o_orderkey % 10 NOT IN (0, 4, 6, 7) AND epoch_us(o_orderdate) >= epoch_us(TIMESTAMP '1994-01-01') + n_nationkey * 2592000000000 "
    "AND epoch_us(o_orderdate) < epoch_us(TIMESTAMP '1994-01-01') + n_nationkey * 2592000000000 + 15552000000000",
)
def w12(spark, sf_dir):
    start = micros(F.lit("1994-01-01 00:00:00")) + F.col("n_nationkey") * F.lit(30 * DAY)
    blocks = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("ks"), "n_nationkey").alias("keyspace"), start.alias("from_at"), (start + F.lit(180 * DAY)).alias("to_at")
    )
    return W.accepted_statements(statement_log(spark, sf_dir), blocks).select("stmt_id")
