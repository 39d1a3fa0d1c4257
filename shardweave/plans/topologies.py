"""T queries: set-level checks over range tables.

Every customer is a keyspace of the cluster of their nation, and every order one of its
ranges, so range tables grow with the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import topologies as T
from shardweave.operators.scan import micros, split_hot
from shardweave.plans.oracle import crc32_sql
from shardweave.plans.registry import event_bucket, query, table
from shardweave.sources.topology import bound_text

RANGES_SQL = """ranges AS (
  SELECT 'c' || c_nationkey AS cluster, 'ks' || o_custkey AS keyspace, o_orderkey AS pos,
         (o_orderkey * 285731) % 4294967296 AS lo,
         (o_orderkey * 285731) % 4294967296 + (o_orderkey % 50) * 2000000 - 3 * (1 - sign(o_orderkey % 50))::BIGINT AS hi,
         'shard-' || (o_orderkey % 7) AS shard
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def hex_sql(x: str) -> str:
    return f"('0x' || lpad(lower(to_hex(({x})::BIGINT)), 8, '0'))"


def ranges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    lo = (key * 285731) % F.lit(1 << 32).cast("long")
    slot = key % 50
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("c"), "c_nationkey").alias("cluster"),
        F.concat(F.lit("ks"), "o_custkey").alias("keyspace"),
        key.alias("pos"),
        lo.alias("lo"),
        (lo + slot * 2000000 - F.when(slot == 0, 3).otherwise(0)).alias("hi"),
        F.concat(F.lit("shard-"), key % 7).alias("shard"),
    )


REACH_SQL = (
    "reach AS (SELECT *, max(hi) OVER (PARTITION BY cluster, keyspace ORDER BY lo, pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges)"
)


@query(
    "t01_overlap_check",
    f"WITH {RANGES_SQL}, {REACH_SQL} SELECT * FROM (SELECT *, CASE WHEN lo > hi THEN 'inverted' "
    "WHEN lo <= reach THEN 'overlap' END AS problem FROM reach) WHERE problem IS NOT NULL",
)
def t01(spark, sf_dir):
    tables = ranges(spark, sf_dir)
    return T.find_overlaps(tables, bucket=T.hot_keyspaces(tables))


@query(
    "t02_gap_check",
    f"WITH {RANGES_SQL}, {REACH_SQL} SELECT cluster, keyspace, reach + 1 AS gap_lo, lo - 1 AS gap_hi "
    "FROM reach WHERE lo > reach + 1",
)
def t02(spark, sf_dir):
    tables = ranges(spark, sf_dir)
    return T.find_gaps(tables, bucket=T.hot_keyspaces(tables))


SPAN_SQL = """
  span AS (SELECT cluster, keyspace, min(lo) AS lo, max(hi) AS hi FROM ranges GROUP BY ALL HAVING min(lo) < max(hi)),
  t AS (SELECT cluster, keyspace, 0 AS pos, lo, lo + (hi - lo) // 2 AS hi FROM span
        UNION ALL SELECT cluster, keyspace, 1, lo + (hi - lo) // 2 + CASE substr(keyspace, -1)
          WHEN '3' THEN 2 WHEN '5' THEN 0 ELSE 1 END, hi - CASE substr(keyspace, -1) WHEN '7' THEN 1 ELSE 0 END FROM span),
  s AS (SELECT cluster, keyspace, 0 AS pos, lo, hi FROM span)"""


def _side_sql(name: str, side: str) -> str:
    return (
        f"{side} AS (SELECT cluster, keyspace, min(lo) AS {side}_lo, max(hi) AS {side}_hi, "
        f"count(*) FILTER (lo > hi) AS {side}_inverted, count(*) FILTER (lo <= r) AS {side}_overlaps, "
        f"count(*) FILTER (lo > r + 1) AS {side}_gaps FROM (SELECT *, max(hi) OVER (PARTITION BY cluster, keyspace "
        f"ORDER BY lo, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {name}) GROUP BY ALL)"
    )


@query(
    "t03_coverage_check",
    f"WITH {RANGES_SQL}, {SPAN_SQL}, {_side_sql('s', 'source')}, {_side_sql('t', 'target')} "
    "SELECT *, source_lo = target_lo AND source_hi = target_hi AS covered, "
    "source_lo = target_lo AND source_hi = target_hi AND source_inverted + source_overlaps + source_gaps "
    "+ target_inverted + target_overlaps + target_gaps = 0 AS valid FROM source JOIN target USING (cluster, keyspace)",
)
def t03(spark, sf_dir):
    span = (
        ranges(spark, sf_dir).groupBy("cluster", "keyspace")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    )
    last, mid = F.substring("keyspace", -1, 1), F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
    first = F.struct(F.lit(0).alias("pos"), F.col("lo").alias("lo"), mid.alias("hi"))
    second = F.struct(
        F.lit(1).alias("pos"),
        (mid + F.when(last == "3", 2).when(last == "5", 0).otherwise(1)).alias("lo"),
        (F.col("hi") - F.when(last == "7", 1).otherwise(0)).alias("hi"),
    )
    targets = span.select("cluster", "keyspace", F.explode(F.array(first, second)).alias("x"))
    one = F.lit(0).cast("long")  # a plan has one source and two targets here
    return T.check_split_plans(
        span.withColumn("pos", F.lit(0)), targets.select("cluster", "keyspace", "x.*"), source_bucket=one, target_bucket=one
    )


@query(
    "t04_split_midpoint",
    f"WITH {RANGES_SQL} SELECT keyspace, pos, "
    f"CASE WHEN lo < hi THEN {hex_sql('lo')} END AS lo0, CASE WHEN lo < hi THEN {hex_sql('lo + (hi - lo) // 2')} END AS hi0, "
    f"CASE WHEN lo < hi THEN {hex_sql('lo + (hi - lo) // 2 + 1')} END AS lo1, CASE WHEN lo < hi THEN {hex_sql('hi')} END AS hi1, "
    "CASE WHEN lo > hi THEN 'inverted' WHEN lo = hi THEN 'single key' END AS error FROM ranges",
)
def t04(spark, sf_dir):
    return T.split_midpoint(ranges(spark, sf_dir)).drop("cluster", "lo", "hi", "shard")


@query(
    "t05_target_names",
    f"WITH {RANGES_SQL}, x AS (SELECT *, {hex_sql('lo')} || '-' || {hex_sql('hi')} AS label FROM ranges WHERE lo < hi), "
    f"y AS (SELECT *, 'as' || lpad(lower(to_hex({crc32_sql('label')} & 16777215)), 6, '0') AS stem FROM x) "
    "SELECT keyspace, pos, stem || 'a' AS shard, lo, lo + (hi - lo) // 2 AS hi FROM y "
    "UNION ALL SELECT keyspace, pos, stem || 'b', lo + (hi - lo) // 2 + 1, hi FROM y",
)
def t05(spark, sf_dir):
    return T.split_targets(ranges(spark, sf_dir)).drop("cluster")


@query(
    "t06_apply_split",
    f"WITH {RANGES_SQL}, chosen AS (SELECT * FROM ranges WHERE shard = 'shard-3' AND lo < hi), "
    f"x AS (SELECT *, {hex_sql('lo')} || '-' || {hex_sql('hi')} AS label FROM chosen), "
    f"y AS (SELECT *, 'as' || lpad(lower(to_hex({crc32_sql('label')} & 16777215)), 6, '0') AS stem FROM x) "
    "SELECT cluster, keyspace, pos, lo, hi, shard FROM ranges ANTI JOIN chosen USING (cluster, keyspace, shard) "
    "UNION ALL SELECT cluster, keyspace, pos, lo, lo + (hi - lo) // 2, stem || 'a' FROM y "
    "UNION ALL SELECT cluster, keyspace, pos, lo + (hi - lo) // 2 + 1, hi, stem || 'b' FROM y",
)
def t06(spark, sf_dir):
    routing = ranges(spark, sf_dir)
    sources = routing.filter("shard = 'shard-3' AND lo < hi")
    return T.apply_split(routing, sources, T.split_targets(sources))


@query("t07_active_shards", f"WITH {RANGES_SQL} SELECT DISTINCT cluster, shard FROM ranges WHERE shard <> ''")
def t07(spark, sf_dir):
    return T.active_shards(ranges(spark, sf_dir))


@query(
    "t08_dangling_ranges",
    "SELECT o_orderkey AS pos, 'shard-' || (o_custkey % 1000) AS shard FROM orders "
    "WHERE 'shard-' || (o_custkey % 1000) NOT IN (SELECT 'shard-' || s_suppkey FROM supplier)",
)
def t08(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("shard-"), F.col("o_custkey") % 1000).alias("shard")
    )
    shards = table(spark, sf_dir, "supplier").select(F.concat(F.lit("shard-"), "s_suppkey").alias("shard"))
    return T.dangling_ranges(named, shards)


DRIFT_SQL = """spec AS (SELECT 's' || p_partkey AS shard_id,
    CASE WHEN p_size % 10 = 0 THEN '' ELSE 'zone-' || (p_size % 3) END AS preferred_zone,
    'node-' || (p_partkey % 5) AS preferred_node FROM part),
  observed AS (SELECT 's' || (c_custkey * 3 // 2) AS shard_id, 'zone-' || (c_nationkey % 3) AS zone,
    CASE WHEN c_nationkey = 4 THEN '' ELSE 'node-' || (c_custkey % 5) END AS node, c_acctbal > 0 AS ready FROM customer),
  named AS (SELECT DISTINCT 's' || (o_custkey * 2) AS shard_id FROM orders),
  pair AS (SELECT * FROM spec JOIN observed USING (shard_id))"""


@query(
    "t09_placement_drift",
    f"WITH {DRIFT_SQL} SELECT shard_id, 'Missing' AS reason, 'wanted but not observed' AS detail FROM spec ANTI JOIN observed USING (shard_id) "
    "UNION ALL SELECT shard_id, 'Extra', 'observed but not wanted' FROM observed ANTI JOIN spec USING (shard_id) "
    "UNION ALL SELECT shard_id, 'ZoneMismatch', 'preferredZone=' || preferred_zone || ' observed=' || zone FROM pair "
    "WHERE preferred_zone <> '' AND zone <> '' AND preferred_zone <> zone "
    "UNION ALL SELECT shard_id, 'NodeMismatch', 'preferredNode=' || preferred_node || ' observed=' || node FROM pair "
    "WHERE preferred_node <> '' AND node <> '' AND preferred_node <> node "
    "UNION ALL SELECT shard_id, 'NotReady', 'observed but not ready' FROM pair WHERE NOT ready "
    "UNION ALL SELECT shard_id, 'RangeUncovered', 'a range names this shard' FROM named ANTI JOIN spec USING (shard_id)",
)
def t09(spark, sf_dir):
    size, part = F.col("p_size"), F.col("p_partkey")
    spec = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), part).alias("shard_id"),
        F.when(size % 10 == 0, "").otherwise(F.concat(F.lit("zone-"), size % 3)).alias("preferred_zone"),
        F.concat(F.lit("node-"), part % 5).alias("preferred_node"),
    )
    observed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), F.expr("c_custkey * 3 div 2")).alias("shard_id"),
        F.concat(F.lit("zone-"), F.col("c_nationkey") % 3).alias("zone"),
        F.when(F.col("c_nationkey") == 4, "").otherwise(F.concat(F.lit("node-"), F.col("c_custkey") % 5)).alias("node"),
        (F.col("c_acctbal") > 0).alias("ready"),
    )
    named = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") * 2).alias("shard"))
    return T.placement_drift(spec, observed, named)


@query(
    "t10_placement_validation",
    "WITH spec AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 's' || (p_partkey - p_partkey % 3 // 2) END AS shard_id, "
    "p_size - 4 AS weight FROM part), g AS (SELECT shard_id, count(*) AS n, count(*) FILTER (weight < 0) AS neg FROM spec GROUP BY 1) "
    "SELECT shard_id, 'empty id' AS violation, n AS n_rows FROM g WHERE shard_id = '' "
    "UNION ALL SELECT shard_id, 'duplicate id', n FROM g WHERE shard_id <> '' AND n > 1 "
    "UNION ALL SELECT shard_id, 'negative weight', neg FROM g WHERE neg > 0",
)
def t10(spark, sf_dir):
    spec = table(spark, sf_dir, "part").select(
        F.expr("CASE WHEN p_partkey % 97 = 0 THEN '' ELSE concat('s', p_partkey - p_partkey % 3 div 2) END").alias("shard_id"),
        (F.col("p_size") - 4).alias("weight"),
    )
    return T.placement_violations(spec)


META_SQL = f"""{RANGES_SQL},
  meta AS (SELECT cluster, keyspace, {hex_sql('lo')} AS range_lo, {hex_sql('lo + 1000000')} AS range_hi, shard AS shard_id,
    'hash' AS vindex_type, 1 + pos % 3 AS generation, pos AS updated_at FROM ranges),
  incoming AS (SELECT cluster, keyspace, {hex_sql('lo')} AS range_lo,
    {hex_sql("lo + 1000000 + CASE WHEN shard = 'shard-1' THEN 1 ELSE 0 END")} AS range_hi,
    CASE WHEN pos % 11 = 0 THEN '' ELSE 'moved-' || pos % 5 END AS shard_id, 'hash' AS vindex_type
    FROM ranges WHERE shard IN ('shard-1', 'shard-2'))"""


def metadata(spark, sf_dir):
    r = ranges(spark, sf_dir)
    lo, pos = F.col("lo"), F.col("pos")
    current = r.select(
        "cluster", "keyspace", bound_text(lo).alias("range_lo"), bound_text(lo + 1000000).alias("range_hi"),
        F.col("shard").alias("shard_id"), F.lit("hash").alias("vindex_type"),
        (pos % 3 + 1).alias("generation"), pos.alias("updated_at"),
    )
    shift = F.when(F.col("shard") == "shard-1", 1).otherwise(0)
    incoming = r.filter(F.col("shard").isin("shard-1", "shard-2")).select(
        "cluster", "keyspace", bound_text(lo).alias("range_lo"), bound_text(lo + 1000000 + shift).alias("range_hi"),
        F.when(pos % 11 == 0, "").otherwise(F.concat(F.lit("moved-"), pos % 5)).alias("shard_id"),
        F.lit("hash").alias("vindex_type"),
    )
    return current, incoming


@query(
    "t11_metadata_upsert",
    f"WITH {META_SQL}, i AS (SELECT * FROM incoming WHERE shard_id <> '') "
    "SELECT cluster, keyspace, range_lo, range_hi, coalesce(i.shard_id, m.shard_id) AS shard_id, "
    "coalesce(i.vindex_type, m.vindex_type) AS vindex_type, "
    "coalesce(m.generation, 0) + CASE WHEN i.shard_id IS NULL THEN 0 ELSE 1 END AS generation, "
    "CASE WHEN i.shard_id IS NULL THEN m.updated_at ELSE -1 END AS updated_at "
    "FROM meta m FULL JOIN i USING (cluster, keyspace, range_lo, range_hi)",
)
def t11(spark, sf_dir):
    current, incoming = metadata(spark, sf_dir)
    return T.metadata_upsert(current, incoming, F.lit(-1).cast("long"))


@query("t12_metadata_list", f"WITH {META_SQL} SELECT * FROM meta ORDER BY range_lo, generation DESC")
def t12(spark, sf_dir):
    return T.metadata_list(metadata(spark, sf_dir)[0])


@query(
    "t13_metadata_delete",
    f"WITH {META_SQL} SELECT * FROM meta ANTI JOIN incoming USING (cluster, keyspace, range_lo, range_hi)",
)
def t13(spark, sf_dir):
    return T.metadata_delete(*metadata(spark, sf_dir))


@query(
    "t14_generation_bump",
    "WITH v AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT user_id, event_id, event_type, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY e.ts, event_id "
    "ROWS UNBOUNDED PRECEDING)::BIGINT AS generation FROM v JOIN (SELECT event_id, ts FROM events) e USING (event_id)",
)
def t14(spark, sf_dir):
    versions = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros("ts").alias("at"))
    bucket = split_hot(versions, ["user_id"], event_bucket(spark, sf_dir, "at"))
    return T.with_generation(versions, ["user_id"], ["at", "event_id"], bucket, ["event_type"]).drop("at")


@query(
    "t15_topology_rollup",
    f"WITH {RANGES_SQL}, n AS (SELECT cluster, keyspace, shard, count(*) AS n FROM ranges GROUP BY ALL) "
    "SELECT cluster, keyspace, sum(n)::BIGINT AS total_ranges, string_agg(shard || '=' || n, ',' ORDER BY shard) AS by_shard "
    "FROM n GROUP BY ALL",
)
def t15(spark, sf_dir):
    rolled = T.topology_rollup(ranges(spark, sf_dir))
    entries = F.transform(F.map_entries("ranges_by_shard"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rolled.select("cluster", "keyspace", "total_ranges", F.array_join(entries, ",").alias("by_shard"))
