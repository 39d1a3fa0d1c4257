"""A queries: automatic split decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardweave.operators import autosplit as A
from shardweave.operators.scan import DAY, HOUR, bucket_of, micros
from shardweave.plans.oracle import crc32_sql
from shardweave.plans.registry import event_bucket, query, table
from shardweave.plans.topologies import RANGES_SQL, hex_sql, ranges
from shardweave.sources.scratch import fresh_path

TRIGGERS = A.Triggers(size_gb=1, volume_percent=30, duration_minutes=240)


def shard_of(user: str) -> Column:
    return F.concat(F.lit("shard-"), F.expr(f"{user} div 5"))


def usage(spark, sf_dir):
    """Size, CPU and capacity tables per shard and hour, with holes."""
    events = table(spark, sf_dir, "events").select(
        shard_of("user_id").alias("shard"), (bucket_of(micros("ts"), HOUR) * F.lit(HOUR)).alias("hour"), "event_type", "value"
    )
    status = events.groupBy("shard", "hour").agg(F.max(F.floor(F.col("value") * 10000000)).alias("size"))
    used = events.filter("event_type <> 'view'").groupBy("shard", "hour").agg(F.max(F.floor(F.col("value") * 10)).alias("used"))
    cpu = used.select("shard", "hour", A.cpu_percent(F.col("used"), F.lit(1500)).alias("cpu_percent"))
    number = F.expr("c_custkey div 5")
    capacity = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("shard-"), number).alias("shard"), (number % 4 * 1000000000).alias("capacity")
    ).distinct()
    return status, cpu, capacity


def observations(spark, sf_dir):
    return A.observe_shards(*usage(spark, sf_dir), on=["shard", "hour"])


OBSERVED_SQL = f"""e AS (SELECT 'shard-' || (user_id // 5) AS shard, epoch_us(ts) // {HOUR} * {HOUR} AS hour, user_id // 5 AS n, event_type, value FROM events),
  obs AS (SELECT shard, hour, max(floor(value * 10000000))::BIGINT AS size,
    coalesce(CASE WHEN max(floor(value * 10)) FILTER (event_type <> 'view') > 0
      THEN max(floor(value * 10)::BIGINT) FILTER (event_type <> 'view') * 100 // 1500 END, 0) AS cpu_percent,
    coalesce((any_value(n) % 4) * 1000000000 * (any_value(n) * 5 <= (SELECT max(c_custkey) FROM customer))::INT, 0) AS capacity FROM e GROUP BY shard, hour)"""


@query("a01_shard_observations", f"WITH {OBSERVED_SQL} SELECT * FROM obs")
def a01(spark, sf_dir):
    return observations(spark, sf_dir)


@query(
    "a02_cpu_percent",
    "SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN floor(o_totalprice)::BIGINT * 100 // ((o_custkey % 7) * 10000) END AS cpu_percent FROM orders",
)
def a02(spark, sf_dir):
    used, request = F.floor("o_totalprice").cast("long"), F.col("o_custkey") % 7 * 10000
    return table(spark, sf_dir, "orders").select("o_orderkey", A.cpu_percent(used, request).alias("cpu_percent"))


@query(
    "a03_trigger_test",
    f"WITH {OBSERVED_SQL} SELECT shard, hour, size >= 1000000000 AND cpu_percent >= 40 AS both_hold, size >= 1000000000 AS size_holds, false AS none_enabled FROM obs",
)
def a03(spark, sf_dir):
    seen = (F.col("size"), F.col("cpu_percent"), F.lit(0), F.col("capacity"))
    return observations(spark, sf_dir).select(
        "shard", "hour",
        A.breached(A.Triggers(size_gb=1, cpu_percent=40), *seen).alias("both_hold"),
        A.breached(A.Triggers(size_gb=1), *seen).alias("size_holds"),
        A.breached(A.Triggers(), *seen).alias("none_enabled"),
    )


@query("a04_volume_utilization", f"WITH {OBSERVED_SQL} SELECT shard, hour, capacity > 0 AND size > 0 AND size * 100 >= 30 * capacity AS full FROM obs")
def a04(spark, sf_dir):
    full = A.volume_breached(F.col("size"), F.col("capacity"), 30)
    return observations(spark, sf_dir).select("shard", "hour", full.alias("full"))


HELD_SQL = f"""{OBSERVED_SQL},
  b AS (SELECT *, size >= 1000000000 AND capacity > 0 AND size * 100 >= 30 * capacity AS breach FROM obs),
  runs AS (SELECT *, sum((NOT breach)::INT) OVER (PARTITION BY shard ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM b),
  held AS (SELECT shard, hour, breach, breach AND hour - min(hour) FILTER (breach) OVER (PARTITION BY shard, run) >= 4 * {HOUR} AS held FROM runs)"""


def held_breaches(spark, sf_dir):
    return A.sustained_breach(observations(spark, sf_dir), ["shard"], "hour", "size", TRIGGERS, event_bucket(spark, sf_dir, "hour"))


@query("a05_sustained_breach", f"WITH {HELD_SQL} SELECT shard, hour, breach, coalesce(held, false) AS held FROM held")
def a05(spark, sf_dir):
    return held_breaches(spark, sf_dir).select("shard", "hour", "breach", "held")


def typed_ranges(spark, sf_dir):
    """Range tables of which some belong to keyspaces that are not hashed."""
    kind = F.when(F.expr("CAST(substr(keyspace, 3) AS BIGINT) % 9 = 0"), "range").otherwise("hash")
    return ranges(spark, sf_dir).withColumn("vindex_type", kind)


TYPED_SQL = f"""{RANGES_SQL},
  typed AS (SELECT *, CASE WHEN substr(keyspace, 3)::BIGINT % 9 = 0 THEN 'range' ELSE 'hash' END AS vindex_type FROM ranges),
  splittable AS (SELECT * FROM typed WHERE vindex_type = 'hash' AND shard <> ''
    QUALIFY count(*) OVER (PARTITION BY cluster, keyspace, shard) = 1),
  hot AS (SELECT * FROM splittable WHERE (hi - lo) > 80000000),
  jobs AS (SELECT DISTINCT 'c' || n_nationkey AS cluster, CASE n_nationkey % 5 WHEN 0 THEN 'Copying' WHEN 1 THEN 'Completed' ELSE 'Aborted' END AS phase FROM nation)"""


def hot_ranges(spark, sf_dir):
    return A.splittable_ranges(typed_ranges(spark, sf_dir)).filter("hi - lo > 80000000")


def split_jobs(spark, sf_dir):
    key = F.col("n_nationkey") % 5
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("c"), "n_nationkey").alias("cluster"),
        F.when(key == 0, "Copying").when(key == 1, "Completed").otherwise("Aborted").alias("phase"),
    )


@query("a06_splittable_ranges", f"WITH {TYPED_SQL} SELECT * FROM splittable")
def a06(spark, sf_dir):
    return A.splittable_ranges(typed_ranges(spark, sf_dir))


CHOSEN_SQL = f"""{TYPED_SQL},
  chosen AS (SELECT * FROM hot WHERE cluster NOT IN (SELECT cluster FROM jobs WHERE phase = 'Copying')
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY keyspace, pos) = 1)"""


@query("a07_choose_split", f"WITH {CHOSEN_SQL} SELECT * FROM chosen")
def a07(spark, sf_dir):
    return A.choose_split(hot_ranges(spark, sf_dir), split_jobs(spark, sf_dir))


PLAN_SQL = (
    f"x AS (SELECT *, {hex_sql('lo')} || '-' || {hex_sql('hi')} AS label FROM hot), "
    f"y AS (SELECT *, lpad(lower(to_hex({crc32_sql('label')} & 16777215)), 6, '0') AS code FROM x), "
    "z AS (SELECT *, 'autosplit-' || keyspace || '-' || shard || '-' || code AS job FROM y WHERE pos % 6 <> 0)"
)


@query(
    "a08_emit_plan",
    f"WITH {TYPED_SQL}, {PLAN_SQL} SELECT cluster, keyspace, job, shard AS source, 'as' || code || 'a' AS shard, lo, lo + (hi - lo) // 2 AS hi, 'required' AS approval FROM z "
    "UNION ALL SELECT cluster, keyspace, job, shard, 'as' || code || 'b', lo + (hi - lo) // 2 + 1, hi, 'required' FROM z",
)
def a08(spark, sf_dir):
    hot = hot_ranges(spark, sf_dir)
    name = A.split_job_name(F.col("keyspace"), F.col("shard"), F.col("lo"), F.col("hi"))
    existing = hot.filter("pos % 6 = 0").select(name.alias("job"))
    return A.emit_plans(hot, existing, approval=True)


@query(
    "a09_approval_hold",
    "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'F' AND coalesce(nullif(o_custkey % 3, 0) <> 1, true)",
)
def a09(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 2 == 0).alias("automatic"),
        F.when(F.col("o_orderstatus") == "F", "auto").otherwise("required").alias("approval"),
        (F.nullif(F.col("o_custkey") % 3, F.lit(0)) == 1).alias("approved"),
    )
    return A.held_for_approval(jobs).select("o_orderkey")


@query(
    "a10_split_reason",
    f"WITH {TYPED_SQL}, c AS (SELECT DISTINCT cluster FROM ranges), g AS (SELECT cluster, count(*) AS n FROM hot GROUP BY 1) "
    "SELECT c.cluster, coalesce(n, 0) AS eligible, CASE WHEN substr(c.cluster, 2)::INT % 7 = 0 THEN 'Disabled' "
    "WHEN n IS NULL AND c.cluster IN (SELECT cluster FROM typed WHERE vindex_type <> 'hash') THEN 'UnsupportedVindex' WHEN n IS NULL THEN 'NoCandidate' "
    "WHEN c.cluster IN (SELECT cluster FROM jobs WHERE phase = 'Copying') THEN 'SplitInProgress' ELSE 'SplitCandidate' END AS reason FROM c LEFT JOIN g ON g.cluster = c.cluster",
)
def a10(spark, sf_dir):
    known = typed_ranges(spark, sf_dir)
    clusters = known.select("cluster").distinct().withColumn("enabled", F.expr("CAST(substr(cluster, 2) AS INT) % 7 <> 0"))
    return A.split_reason(clusters, known, hot_ranges(spark, sf_dir), split_jobs(spark, sf_dir), TRIGGERS)


@query(
    "a11_p99_latency",
    f"SELECT 'shard-' || (user_id // 5) AS shard, epoch_us(ts) // {DAY} AS day, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL",
)
def a11(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(
        shard_of("user_id").alias("shard"), bucket_of(micros("ts"), DAY).alias("day"), "value"
    )
    return A.p99_latency(samples, ["shard", "day"], "value")


QUANTILES = {"p50": 0.5, "p99": 0.99}
RANK_ERROR = 0.01


@query(
    "a11_stored_sketches",
    f"SELECT epoch_us(ts) // {7 * DAY} AS week, count(*) AS n_samples, true AS p50_within, true AS p99_within FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def a11_stored(spark, sf_dir):
    """Sketches of every shard and day are stored; a week's are merged, and its samples tell the ranks of what they say."""
    samples = table(spark, sf_dir, "events").select(shard_of("user_id").alias("shard"), bucket_of(micros("ts"), DAY).alias("day"), "value")
    path = fresh_path(spark, "latencies")
    A.quantile_sketches(samples, ["shard", "day"], "value").write.parquet(path)
    week = F.floor(F.col("day") / 7).cast("long").alias("week")
    found = A.merged_quantiles(spark.read.parquet(path).select(week, "sketch"), ["week"], QUANTILES)
    # one row a week on the found side
    ranked = samples.filter("value IS NOT NULL").select(week, "value").join(found, "week")
    within = []
    for name, q in QUANTILES.items():
        below, upto = F.count_if(F.col("value") < F.col(name)), F.count_if(F.col("value") <= F.col(name))
        n = F.count(F.lit(1))
        within.append(((below <= (q + RANK_ERROR) * n) & (upto >= (q - RANK_ERROR) * n)).alias(f"{name}_within"))
    return ranked.groupBy("week", "n_samples").agg(*within)
