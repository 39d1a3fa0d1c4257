"""G queries: reading sharded tables as one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import gather as G
from shardweave.operators.placement import SHARD, assign_shard
from shardweave.operators.scan import micros, split_hot
from shardweave.operators.skew import heavy_keys, heavy_sketches, spread_join
from shardweave.plans.layouts import sharded_orders
from shardweave.plans.oracle import murmur3_sql, quarter_shard_sql
from shardweave.plans.placement import FOUR, ORDER_SHARDS_SQL
from shardweave.plans.registry import event_bucket, query, table
from shardweave.sources import layout as L
from shardweave.sources.scratch import folder_of, fresh_path
from shardweave.sources.topology import equal_hash_topology

MONEY = "decimal(18,2)"
PRIORITY = "nullif(o_orderpriority, '5-LOW')"


def placed_orders(spark, sf_dir):
    """Orders with their shard, a priority that is NULL for one value, and exact money."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
    )
    return assign_shard(orders, FOUR)


PLACED_SQL = (
    f"{ORDER_SHARDS_SQL}, p AS (SELECT o_orderkey, o_custkey, {PRIORITY} AS priority, "
    "o_totalprice::DECIMAL(18, 2) AS price, shard AS __shard FROM placed)"
)


@query("g01_point_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 1203)")
def g01(spark, sf_dir):
    orders = L.read_sharded(spark, sharded_orders(spark, sf_dir))
    return L.point_read(orders, FOUR, [7, 1203]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("g02_concat", f"WITH {PLACED_SQL} SELECT __shard, o_orderkey, o_custkey FROM p ORDER BY __shard, o_orderkey")
def g02(spark, sf_dir):
    orders = L.read_sharded(spark, sharded_orders(spark, sf_dir))
    return orders.select(SHARD, "o_orderkey", "o_custkey").orderBy(SHARD, "o_orderkey")


@query("g03_global_order", f"WITH {PLACED_SQL} SELECT * FROM p ORDER BY priority DESC NULLS FIRST, __shard, o_orderkey")
def g03(spark, sf_dir):
    return G.merge_ordered(placed_orders(spark, sf_dir), ["PRIORITY"], descending=True, ties=["o_orderkey"])


@query(
    "g04_order_by_position",
    f"WITH {PLACED_SQL} SELECT o_custkey, priority, o_orderkey, __shard FROM p ORDER BY 2 NULLS LAST, 1 NULLS LAST, __shard, o_orderkey",
)
def g04(spark, sf_dir):
    rows = placed_orders(spark, sf_dir).select("o_custkey", "priority", "o_orderkey", SHARD)
    return G.merge_ordered(rows, ["2", 1], ties=["o_orderkey"])


@query(
    "g05_limit",
    f"WITH {PLACED_SQL} SELECT * FROM p ORDER BY price DESC NULLS FIRST, __shard, o_orderkey LIMIT 100",
)
def g05(spark, sf_dir):
    return G.merge_ordered(placed_orders(spark, sf_dir), ["price"], descending=True, ties=["o_orderkey"]).limit(100)


@query(
    "g06_shard_top_n",
    f"WITH {PLACED_SQL} SELECT * FROM (SELECT __shard, o_orderkey, price, row_number() OVER "
    "(PARTITION BY __shard ORDER BY price DESC NULLS FIRST, o_orderkey)::INTEGER AS nth FROM p) WHERE nth <= 25",
)
def g06(spark, sf_dir):
    rows = placed_orders(spark, sf_dir).select(SHARD, "o_orderkey", "price")
    return G.shard_top(rows, [F.col("price").desc_nulls_first(), F.col("o_orderkey")], 25)


TOTALS = {
    "n": G.Aggregate("count"),
    "n_priority": G.Aggregate("count", "priority"),
    "total": G.Aggregate("sum", "price"),
    "low": G.Aggregate("min", "price"),
    "high": G.Aggregate("max", "price"),
}
TOTALS_SQL = (
    "count(*) AS n, count(priority) AS n_priority, sum(price) AS total, min(price) AS low, max(price) AS high"
)


@query("g07_scalar_aggregate_merge", f"WITH {PLACED_SQL} SELECT {TOTALS_SQL} FROM p")
def g07(spark, sf_dir):
    return G.merge_partials(G.shard_partials(placed_orders(spark, sf_dir), [], TOTALS), [], TOTALS)


@query("g08_grouped_aggregate_merge", f"WITH {PLACED_SQL} SELECT priority, {TOTALS_SQL} FROM p GROUP BY priority")
def g08(spark, sf_dir):
    partials = G.shard_partials(placed_orders(spark, sf_dir), ["priority"], TOTALS)
    return G.merge_partials(partials, ["priority"], TOTALS)


@query(
    "g09_stored_partials",
    f"WITH {PLACED_SQL} SELECT o_custkey, {TOTALS_SQL} FROM p GROUP BY o_custkey",
)
def g09(spark, sf_dir):
    path = fresh_path(spark, "partials")
    L.write_sharded(G.shard_partials(placed_orders(spark, sf_dir), ["o_custkey"], TOTALS), path)
    return G.merge_partials(L.read_sharded(spark, path), ["o_custkey"], TOTALS)


@query(
    "g10_average",
    f"WITH {PLACED_SQL} SELECT priority, round(sum(price)::DOUBLE / count(price), 6) AS mean FROM p GROUP BY priority",
)
def g10(spark, sf_dir):
    mean = {"mean": G.Aggregate("avg", "price")}
    partials = G.shard_partials(placed_orders(spark, sf_dir), ["priority"], mean)
    return G.merge_partials(partials, ["priority"], mean).withColumn("mean", F.round("mean", 6))


@query(
    "g11_count_distinct",
    f"WITH {PLACED_SQL} SELECT priority, count(DISTINCT o_custkey) AS customers FROM p GROUP BY priority",
)
def g11(spark, sf_dir):
    return placed_orders(spark, sf_dir).groupBy("priority").agg(F.count_distinct("o_custkey").alias("customers"))


@query(
    "g11_stored_distinct",
    f"WITH {PLACED_SQL} SELECT priority, count(DISTINCT o_custkey)::BIGINT AS customers FROM p GROUP BY priority",
)
def g11_stored(spark, sf_dir):
    # A customer has orders on several shards: stored counts would add up to more, stored bitmaps do not.
    path = fresh_path(spark, "distinct")
    L.write_sharded(G.distinct_partials(placed_orders(spark, sf_dir), ["priority"], "o_custkey"), path)
    return G.merge_distinct(L.read_sharded(spark, path), ["priority"], "customers")


ITEMS = ("count(*)", "SUM(o_totalprice)", "min(o_orderdate)", "Max (o_orderkey)", "avg(o_totalprice)",
         "count(DISTINCT o_custkey)", " o_orderpriority ", "lower(o_orderstatus)", "sum(o_totalprice) + 1",
         "max(o_totalprice) - min(o_totalprice)", "count(*) over (partition by o_custkey)", "sum(abs(o_totalprice)) AS total",
         "max(o_clerk || ')') last_clerk")
KINDS = ("count", "sum", "min", "max", "not mergeable", "not mergeable", "group key", "not mergeable", "not mergeable",
         "not mergeable", "not mergeable", "sum", "max")


@query(
    "g12_mergeability",
    f"SELECT o_orderkey, CASE o_orderkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    + " END AS kind FROM orders",
)
def g12(spark, sf_dir):
    item = F.element_at(F.array(*[F.lit(i) for i in ITEMS]), (F.col("o_orderkey") % len(ITEMS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.item_merge_kind(item).alias("kind"))


@query(
    "g13_failure_policy",
    f"WITH {PLACED_SQL} SELECT __shard AS shard, count(*) AS n_rows, NULL::VARCHAR AS error FROM p GROUP BY 1 "
    "UNION ALL SELECT 'shard-9', 0, 'PATH_NOT_FOUND'",
)
def g13(spark, sf_dir):
    root = sharded_orders(spark, sf_dir)
    paths = {f"shard-{i}": f"{root}/{SHARD}=shard-{i}" for i in (0, 1, 2, 3, 9)}
    rows, failed = L.read_best_effort(spark, paths)
    good = rows.groupBy(F.col(SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"))
    lost = failed.withColumn("n_rows", F.lit(0).cast("long"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(lost)


@query(
    "g14_reference_only_read",
    "SELECT r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def g14(spark, sf_dir):
    # Suppliers, nations and regions are on every shard: one copy is read and no shard is scanned.
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.groupBy("r_name").agg(F.sum("n").alias("suppliers"))


@query(
    "g15_reference_join",
    f"SELECT {quarter_shard_sql('h')} AS shard, n_name, count(*) AS n_rows, sum(c_acctbal::DECIMAL(18, 2)) AS balance FROM "
    f"(SELECT *, {murmur3_sql('c_custkey::VARCHAR')} AS h FROM customer) JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def g15(spark, sf_dir):
    customers = assign_shard(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), equal_hash_topology("c_custkey", 4), "shard"
    )
    # The nation table is broadcast by its size on disk, not by a hint.
    joined = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("shard", "n_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("c_acctbal").cast(MONEY)).alias("balance")
    )


_bucketed: dict[tuple[str, str], tuple] = {}
BUCKET_BYTES = 128 << 20


def bucketed_pair(spark, sf_dir):
    """Orders and lines bucketed by the order key, and the heavy keys of the lines; written once per session and folder.

    Buckets grow with the lines.  The tables leave the catalogue once they are resolved; their files stay in the shared folder.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _bucketed:
        source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
        path, system = folder_of(spark, f"{sf_dir}/lineitem.parquet")
        buckets = max(16, -(-system.getContentSummary(path).getLength() // BUCKET_BYTES))
        tables = []
        for name, key, rows in (("orders", "o_orderkey", placed_orders(spark, sf_dir)), ("lines", "l_orderkey", source)):
            folder = fresh_path(spark, f"bucketed-{name}")
            table_name = f"bucketed_{name}_{folder[-8:]}"
            L.write_bucketed(rows, table_name, key, buckets, folder)
            tables.append(spark.table(table_name))
            spark.sql(f"DROP TABLE {table_name}")
        _bucketed[at] = (*tables, heavy_keys(heavy_sketches(tables[1], "l_orderkey")))
    return _bucketed[at]


@query(
    "g16_colocated_join",
    f"WITH {PLACED_SQL} SELECT __shard, priority, count(*) AS lines, sum(l_extendedprice::DECIMAL(18, 2)) AS revenue "
    "FROM p JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
)
def g16(spark, sf_dir):
    # Both tables lie bucketed by the order key, so bucket joins bucket; only rows of heavy keys are dealt anew.
    orders, lines, heavy = bucketed_pair(spark, sf_dir)
    joined = spread_join(lines, orders.hint("merge"), "l_orderkey", "o_orderkey", heavy)
    return joined.groupBy(SHARD, "priority").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(38,2)").alias("revenue")
    )


@query(
    "g17_cross_shard_join",
    "SELECT c_mktsegment, count(*) AS n_rows, sum(o_totalprice::DECIMAL(18, 2)) AS total "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def g17(spark, sf_dir):
    orders = placed_orders(spark, sf_dir).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("total")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.sum("n_rows").alias("n_rows"), F.sum("total").cast("decimal(38,2)").alias("total"))


@query(
    "g17_heavy_hitter_join",
    "SELECT c_mktsegment, count(*) AS n_rows, count(c_custkey) AS known, sum(o_totalprice::DECIMAL(18, 2)) AS total FROM "
    "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS buyer, o_totalprice FROM orders) "
    "LEFT JOIN customer ON buyer = c_custkey GROUP BY 1",
)
def g17_heavy(spark, sf_dir):
    # A third of the orders has one buyer; shards sketch their keys and only the rows of the named ones are dealt anew.
    buyer = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")).cast("long")
    orders = placed_orders(spark, sf_dir).select(SHARD, "o_orderkey", buyer.alias("buyer"), "price")
    heavy = heavy_keys(heavy_sketches(orders, "buyer", [SHARD]))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = spread_join(orders, customers, "buyer", "c_custkey", heavy, how="left", deal=F.col("o_orderkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("c_custkey").alias("known"), F.sum("price").cast("decimal(38,2)").alias("total")
    )


MEMBERS_SQL = """members AS (SELECT 'shard-' || (s_suppkey // 5) AS shard, s_name AS pod,
  CASE s_suppkey % 5 WHEN 0 THEN 'primary' ELSE 'replica' END AS role,
  s_acctbal > 0 AND s_suppkey // 5 % 4 <> 1 OR s_suppkey % 5 = 0 AS ready,
  s_name || ':5432' AS endpoint, floor(abs(s_acctbal))::BIGINT AS lag FROM supplier)"""


@query(
    "g18_read_replica_choice",
    f"WITH {MEMBERS_SQL}, r AS (SELECT shard, endpoint, row_number() OVER (PARTITION BY shard ORDER BY pod) - 1 AS slot, "
    "count(*) OVER (PARTITION BY shard) AS n FROM members WHERE role = 'replica' AND ready AND lag <= 7000), "
    "q AS (SELECT event_id, 'shard-' || (user_id // 5) AS shard, ts FROM events), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) - 1 AS turn FROM q) "
    "SELECT event_id, t.shard, coalesce(r.endpoint, m.endpoint) AS endpoint FROM t "
    "LEFT JOIN (SELECT DISTINCT shard, n FROM r) z ON z.shard = t.shard "
    "LEFT JOIN r ON r.shard = t.shard AND r.slot = t.turn % z.n "
    "LEFT JOIN members m ON m.shard = t.shard AND m.role = 'primary' AND m.ready",
)
def g18(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").selectExpr(
        "concat('shard-', s_suppkey div 5) AS shard", "s_name AS pod",
        "CASE s_suppkey % 5 WHEN 0 THEN 'primary' ELSE 'replica' END AS role",
        "s_acctbal > 0 AND s_suppkey div 5 % 4 <> 1 OR s_suppkey % 5 = 0 AS ready",
        "concat(s_name, ':5432') AS endpoint", "CAST(floor(abs(s_acctbal)) AS BIGINT) AS lag",
    )
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("shard-"), F.expr("user_id div 5")).alias("shard"), micros("ts").alias("at")
    )
    bucket = split_hot(requests, ["shard"], event_bucket(spark, sf_dir, "at"))
    return G.choose_read_endpoint(requests, ["at", "event_id"], bucket, members, 7000).drop("at")
