"""F queries: member status from heartbeats and the decisions that follow from it.

Every customer is a pod, five pods make a shard and five shards a cluster; events are the
heartbeats of the pods named by their user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import fleet as M
from shardweave.operators.coalesce import coalesce_signals
from shardweave.operators.held import sustained, with_held_since
from shardweave.operators.scan import HOUR, MINUTE, micros
from shardweave.plans.registry import event_bucket, query, table

AS_OF = 1706659200 * 1_000_000  # 2024-01-31 00:00:00 UTC, after the last heartbeat
STALE = 30 * HOUR


def heartbeats(spark, sf_dir):
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    pod = F.concat(F.lit("pod-"), user)
    return table(spark, sf_dir, "events").select(
        pod.alias("pod"),
        F.when((user + event) % 4 == 0, "primary").otherwise("replica").alias("role"),
        kind.isin("purchase", "click").alias("promoted"),
        (kind != "error").alias("ready"),
        F.concat(pod, F.lit(":6432")).alias("endpoint"),
        (F.floor(F.col("value") * 1000) - 5000).alias("lag"),
        F.floor(F.col("value") * 10000000).alias("size"),
        F.when(kind == "error", "probe-failed").alias("reason"),
        micros("ts").alias("at"),
        event.alias("seq"),
    )


def pods(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("pod-"), key).alias("pod"),
        F.concat(F.lit("shard-"), F.expr("c_custkey div 5")).alias("shard"),
        F.concat(F.lit("c"), F.expr("c_custkey div 25")).alias("cluster"),
        (F.col("c_acctbal") > -500).alias("pod_ready"),
        (key % 50 == 49).alias("is_job"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_target"),
        (F.lit(AS_OF) - key % 20 * MINUTE).alias("created_at"),
    )


def fences(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey % 13 = 0").select(F.concat(F.lit("pod-"), "c_custkey").alias("pod"))


def members(spark, sf_dir):
    latest = M.latest_status(heartbeats(spark, sf_dir))
    return M.member_status(pods(spark, sf_dir), latest, fences(spark, sf_dir), AS_OF, STALE)


def shards(spark, sf_dir):
    return M.shard_status(members(spark, sf_dir))


HEARTBEATS_SQL = """hb AS (SELECT 'pod-' || user_id AS pod, CASE WHEN (user_id + event_id) % 4 = 0 THEN 'primary' ELSE 'replica' END AS role,
  event_type IN ('purchase', 'click') AS promoted, event_type <> 'error' AS said_ready, 'pod-' || user_id || ':6432' AS endpoint,
  floor(value * 1000)::BIGINT - 5000 AS lag, floor(value * 10000000)::BIGINT AS size,
  CASE WHEN event_type = 'error' THEN 'probe-failed' END AS reason, epoch_us(ts) AS at_us, event_id AS seq FROM events),
  latest AS (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY pod ORDER BY at_us DESC, seq DESC) = 1)"""

MEMBERS_SQL = f"""{HEARTBEATS_SQL},
  pods AS (SELECT 'pod-' || c_custkey AS pod, 'shard-' || (c_custkey // 5) AS shard, 'c' || (c_custkey // 25) AS cluster,
    c_acctbal > -500 AS pod_ready, c_custkey % 13 = 0 AS fenced, c_mktsegment = 'BUILDING' AS is_target,
    {AS_OF} - c_custkey % 20 * {MINUTE} AS created_at, c_custkey FROM customer WHERE c_custkey % 50 <> 49),
  m1 AS (SELECT p.*, l.pod IS NOT NULL AS has_status, role, promoted, said_ready, l.endpoint AS said_endpoint, lag AS said_lag,
    size AS said_size, l.reason AS said_reason, at_us FROM pods p LEFT JOIN latest l USING (pod)),
  m2 AS (SELECT *, coalesce(bool_or(role = 'primary' AND promoted AND NOT fenced) OVER (PARTITION BY shard), false) AS proven FROM m1),
  m3 AS (SELECT *, coalesce(role = 'primary' AND NOT fenced AND NOT promoted AND proven, false) AS rogue,
    NOT has_status AND is_target AND pod_ready AS target FROM m2),
  m4 AS (SELECT *, coalesce(role = 'primary' AND NOT fenced AND NOT rogue, false) OR target AS candidate FROM m3),
  m5 AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY candidate DESC, pod) AS nth,
    count(*) FILTER (candidate AND NOT target) OVER (PARTITION BY shard) AS claimants,
    count(*) FILTER (candidate) OVER (PARTITION BY shard) AS n_candidates FROM m4),
  members AS (SELECT cluster, shard, pod, c_custkey, created_at, fenced, pod_ready, has_status, rogue, target, claimants, n_candidates,
    CASE WHEN candidate AND nth = 1 THEN 'primary' WHEN target THEN 'unused' ELSE 'replica' END AS place,
    CASE WHEN has_status THEN said_ready AND {AS_OF} - at_us <= {STALE} AND pod_ready AND NOT fenced AND NOT rogue ELSE target END AS ready,
    CASE WHEN rogue THEN 'rogue-primary' WHEN has_status THEN coalesce(said_reason,
      CASE WHEN NOT pod_ready THEN 'pod-not-ready' WHEN fenced THEN 'fenced' END) END AS reason,
    CASE WHEN has_status THEN greatest(said_lag, 0) ELSE 0 END AS lag, greatest(coalesce(said_size, 0), 0) AS size,
    coalesce(said_endpoint, pod || ':5432') AS endpoint FROM m5)"""

SHARDS_SQL = f"""{MEMBERS_SQL},
  prim AS (SELECT * FROM members WHERE place = 'primary'),
  reps AS (SELECT * FROM members WHERE place = 'replica'),
  shards AS (SELECT DISTINCT cluster, shard FROM members)"""


@query("f01_latest_status", f"WITH {HEARTBEATS_SQL} SELECT pod, role, promoted, said_ready AS ready, lag, size, reason, at_us, seq FROM latest")
def f01(spark, sf_dir):
    return M.latest_status(heartbeats(spark, sf_dir)).drop("endpoint").withColumnRenamed("at", "at_us")


@query("f02_staleness", f"WITH {HEARTBEATS_SQL} SELECT pod, at_us, {AS_OF} - at_us > {STALE} AS stale FROM latest")
def f02(spark, sf_dir):
    latest = M.latest_status(heartbeats(spark, sf_dir).select("pod", "at", "seq"))
    return latest.select("pod", F.col("at").alias("at_us"), M.is_stale(F.col("at"), AS_OF, STALE).alias("stale"))


@query("f03_effective_readiness", f"WITH {MEMBERS_SQL} SELECT pod, ready, reason, lag FROM members WHERE has_status")
def f03(spark, sf_dir):
    return members(spark, sf_dir).filter("has_status").select("pod", "ready", "reason", "lag")


@query("f04_primary_per_shard", f"WITH {MEMBERS_SQL} SELECT shard, pod, ready, size FROM members WHERE place = 'primary'")
def f04(spark, sf_dir):
    return members(spark, sf_dir).filter("place = 'primary'").select("shard", "pod", "ready", "size")


@query("f05_rogue_primaries", f"WITH {MEMBERS_SQL} SELECT shard, pod, ready, reason FROM members WHERE rogue")
def f05(spark, sf_dir):
    return members(spark, sf_dir).filter("rogue").select("shard", "pod", "ready", "reason")


@query("f06_split_brain", f"WITH {MEMBERS_SQL} SELECT DISTINCT cluster, shard, claimants FROM members WHERE claimants > 1")
def f06(spark, sf_dir):
    return M.split_brain(members(spark, sf_dir))


@query("f07_members_without_status", f"WITH {MEMBERS_SQL} SELECT shard, pod, place, ready, endpoint FROM members WHERE NOT has_status")
def f07(spark, sf_dir):
    return members(spark, sf_dir).filter("NOT has_status").select("shard", "pod", "place", "ready", "endpoint")


@query(
    "f08_shard_status",
    f"WITH {SHARDS_SQL}, r AS (SELECT shard, string_agg(pod || ' ' || ready || ' ' || lag || ' ' || coalesce(reason, '-'), ';' ORDER BY pod) AS replicas "
    "FROM reps GROUP BY shard) SELECT s.cluster, s.shard, p.pod AS primary_pod, p.ready AS primary_ready, p.lag AS primary_lag, "
    "p.size, coalesce(replicas, '') AS replicas FROM shards s LEFT JOIN prim p USING (shard) LEFT JOIN r USING (shard)",
)
def f08(spark, sf_dir):
    text = F.transform(
        "replicas",
        lambda r: F.concat_ws(" ", r["pod"], r["ready"].cast("string"), r["lag"].cast("string"), F.coalesce(r["reason"], F.lit("-"))),
    )
    return shards(spark, sf_dir).select(
        "cluster", "shard", F.col("primary.pod").alias("primary_pod"), F.col("primary.ready").alias("primary_ready"),
        F.col("primary.lag").alias("primary_lag"), "size", F.array_join(text, ";").alias("replicas"),
    )


POSITIONS_SQL = """pos AS (SELECT o_custkey AS shard, o_orderkey AS pod, CASE WHEN o_orderkey % 5 = 0 THEN 'primary' ELSE 'replica' END AS role,
  o_orderkey * 4096 AS current, o_orderkey * 4000 AS flushed, o_orderkey * 4090 AS received,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey * 4080 END AS replayed, o_orderkey % 17 = 0 AS failed FROM orders)"""


@query(
    "f09_member_lag",
    f"WITH {POSITIONS_SQL}, slow AS (SELECT shard, min(flushed) AS f FROM pos WHERE role = 'replica' GROUP BY shard) "
    "SELECT shard, pod, role, CASE WHEN failed THEN -1 WHEN role = 'primary' THEN coalesce(greatest(current - f, 0), 0) "
    "ELSE coalesce(received - replayed, -1) END AS lag FROM pos LEFT JOIN slow USING (shard)",
)
def f09(spark, sf_dir):
    key = F.col("o_orderkey")
    positions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("shard"), key.alias("pod"),
        F.when(key % 5 == 0, "primary").otherwise("replica").alias("role"),
        (key * 4096).alias("current"), (key * 4000).alias("flushed"), (key * 4090).alias("received"),
        F.when(F.col("o_orderstatus") != "P", key * 4080).alias("replayed"), (key % 17 == 0).alias("failed"),
    )
    return M.member_lag(positions)


DECISIONS_SQL = f"""{SHARDS_SQL},
  best AS (SELECT shard, pod FROM reps WHERE ready QUALIFY row_number() OVER (PARTITION BY shard ORDER BY lag, pod) = 1),
  decisions AS (SELECT s.cluster, s.shard, NOT coalesce(p.ready, false) AS failed, CASE WHEN p.ready THEN 'None' WHEN b.pod IS NULL THEN 'NoEligibleReplica'
    WHEN p.pod IS NULL THEN 'NoPrimary' ELSE 'PrimaryNotReady' END AS reason, CASE WHEN coalesce(p.ready, false) THEN NULL ELSE b.pod END AS candidate
    FROM shards s LEFT JOIN prim p USING (shard) LEFT JOIN best b USING (shard))"""


@query("f10_failure_decision", f"WITH {DECISIONS_SQL} SELECT * FROM decisions")
def f10(spark, sf_dir):
    return M.failure_decision(shards(spark, sf_dir))


@query("f11_promotion_candidate", f"WITH {DECISIONS_SQL} SELECT s.shard, b.pod AS candidate FROM shards s LEFT JOIN best b USING (shard)")
def f11(spark, sf_dir):
    return shards(spark, sf_dir).select("shard", M.promotion_candidate()["pod"].alias("candidate"))


@query(
    "f12_first_failure",
    f"WITH {DECISIONS_SQL} SELECT cluster, shard, reason, candidate FROM decisions WHERE failed "
    "QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY substr(shard, 7)::BIGINT) = 1",
)
def f12(spark, sf_dir):
    return M.first_failure(M.failure_decision(shards(spark, sf_dir)), F.expr("CAST(substr(shard, 7) AS BIGINT)"))


def cluster_reports(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.expr("user_id div 25").alias("cluster"),
        micros("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.col("event_type").isin("error", "view", "click").alias("failed"),
        (F.col("value") > 50).alias("was_ready"),
    )


@query(
    "f13_debounced_failure",
    "WITH e AS (SELECT user_id // 25 AS cluster, epoch_us(ts) AS at_us, event_id AS seq, event_type IN ('error', 'view', 'click') AS failed, value > 50 AS was_ready FROM events), "
    "i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY cluster ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM e), "
    "s AS (SELECT *, CASE WHEN failed THEN min(at_us) FILTER (failed AND was_ready) OVER (PARTITION BY cluster, run ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) END AS since FROM i) "
    f"SELECT cluster, seq, failed, since, coalesce(at_us - since >= {8 * HOUR}, false) AS promote FROM s",
)
def f13(spark, sf_dir):
    rows = with_held_since(
        cluster_reports(spark, sf_dir), ["cluster"], "at", "seq", F.col("failed"), event_bucket(spark, sf_dir, "at"), F.col("was_ready")
    )
    return rows.select("cluster", "seq", "failed", "since", sustained(F.col("at"), F.col("since"), 8 * HOUR).alias("promote"))


@query(
    "f14_fenced_candidate_guard",
    f"WITH {DECISIONS_SQL}, d AS (SELECT cluster, shard, candidate FROM decisions WHERE failed AND candidate IS NOT NULL) "
    "SELECT cluster, shard, candidate, coalesce((SELECT bool_or(pod = candidate AND fenced) AND bool_or(NOT fenced) FROM members m WHERE m.shard = d.shard), false) AS skip FROM d",
)
def f14(spark, sf_dir):
    known = members(spark, sf_dir)
    decisions = M.failure_decision(M.shard_status(known)).filter("failed AND candidate IS NOT NULL")
    return M.guard_candidates(decisions.select("cluster", "shard", "candidate"), known)


@query(
    "f15_stuck_standbys",
    f"WITH {SHARDS_SQL} SELECT r.cluster, r.shard, r.pod FROM reps r JOIN prim p USING (shard) WHERE p.ready AND NOT r.ready "
    f"AND r.c_custkey % 20 >= 8 AND NOT (r.c_custkey % 3 = 0 AND r.c_custkey % 15 < 10)",
)
def f15(spark, sf_dir):
    reseeds = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("pod-"), "c_custkey").alias("pod"), (F.lit(AS_OF) - F.col("c_custkey") % 15 * MINUTE).alias("reseeded_at")
    )
    return M.stuck_standbys(shards(spark, sf_dir), pods(spark, sf_dir), reseeds, AS_OF)


@query(
    "f16_cluster_phase",
    f"WITH {DECISIONS_SQL}, g AS (SELECT cluster, count(*) AS n_shards, bool_and(NOT failed) AS all_ready, bool_or(failed) AS any_failed, "
    "substr(cluster, 2)::BIGINT AS n FROM decisions GROUP BY cluster) SELECT cluster, n_shards, CASE WHEN n % 11 = 0 THEN 'Hibernated' "
    "WHEN n % 2 = 0 AND any_failed THEN 'Degraded' WHEN all_ready AND (n % 5 = 0 OR n % 3 <> 0) THEN 'Ready' ELSE 'Provisioning' END AS phase FROM g",
)
def f16(spark, sf_dir):
    n = F.expr("CAST(substr(cluster, 2) AS BIGINT)")
    status = shards(spark, sf_dir)
    clusters = pods(spark, sf_dir).select("cluster").distinct().select(
        "cluster", (n % 11 == 0).alias("hibernated"), (n % 2 == 0).alias("was_ready"),
        (n % 5 != 0).alias("router_active"), (n % 3 != 0).alias("router_ready"),
    )
    return M.cluster_phase(clusters, status, M.failure_decision(status))


@query(
    "f17_managed_roles",
    "SELECT 'c' || c_nationkey AS cluster, 'u' || c_custkey AS role, CASE WHEN c_acctbal > 0 AND c_custkey % 4 <> 0 THEN 'reconciled' ELSE 'pending-reconciliation' END AS status, "
    "CASE WHEN c_acctbal <= 0 THEN nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'no grant for ' || c_custkey END, '') END AS error, "
    "CASE WHEN c_custkey % 7 <> 0 THEN 'v' || c_custkey % 7 END AS secret_version FROM customer "
    "UNION ALL SELECT DISTINCT 'c' || c_nationkey, r, 'reserved', NULL, NULL FROM customer, (VALUES ('postgres'), ('streaming_replica')) t(r)",
)
def f17(spark, sf_dir):
    users = table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_nationkey) AS cluster", "concat('u', c_custkey) AS role", "c_acctbal > 0 AS applied", "3 AS generation",
        "CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 3 END AS observed",
        "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('no grant for ', c_custkey) END AS message",
        "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('v', c_custkey % 7) END AS secret_version",
    )
    return M.managed_roles(users)


@query(
    "f18_lag_samples",
    f"WITH {MEMBERS_SQL} SELECT cluster, shard, pod, place AS role, lag FROM members WHERE place <> 'unused'",
)
def f18(spark, sf_dir):
    return M.lag_samples(shards(spark, sf_dir))


BURST = 6 * HOUR


@query(
    "f19_signal_coalescing",
    "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), "
    "w AS (SELECT user_id, min(us) AS start FROM e GROUP BY user_id UNION ALL "
    f"SELECT w.user_id, min(e.us) FROM w JOIN e ON e.user_id = w.user_id AND e.us >= w.start + {BURST} GROUP BY w.user_id, w.start) "
    f"SELECT user_id, start, start + {BURST} AS emit_at FROM w",
)
def f19(spark, sf_dir):
    signals = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"))
    return coalesce_signals(signals, "user_id", "us", BURST)


@query("f20_serving_endpoints", f"WITH {SHARDS_SQL} SELECT cluster, shard, endpoint FROM prim WHERE ready AND endpoint <> ''")
def f20(spark, sf_dir):
    return M.serving_endpoints(shards(spark, sf_dir))


@query(
    "f21_rogue_reseeds",
    f"WITH {SHARDS_SQL} SELECT r.cluster, r.shard, r.pod FROM reps r JOIN prim p USING (shard) WHERE p.ready AND r.reason = 'rogue-primary'",
)
def f21(spark, sf_dir):
    return M.rogue_reseeds(shards(spark, sf_dir))


@query(
    "f22_volume_fences",
    f"WITH v AS (SELECT o_custkey, 'pvc-' || o_custkey AS pvc, 'pod-' || o_orderkey AS pod, o_orderkey % 4 = 0 AND o_orderstatus <> 'F' AS claim, "
    "'pod-' || min(o_orderkey) OVER (PARTITION BY o_custkey) AS holder, o_custkey % 17 = 0 AS multi, "
    "o_custkey % 10 <> 0 AND o_custkey % 9 <> 0 AND o_custkey % 100 > 30 AS stale FROM orders), "
    "c AS (SELECT *, count(*) FILTER (claim) OVER (PARTITION BY pvc) AS claims, count(*) FILTER (claim AND pod <> holder) OVER (PARTITION BY pvc) AS foreign_claims FROM v), "
    "r AS (SELECT *, CASE WHEN multi THEN 'MultiAttach' WHEN claims >= 2 THEN 'SplitBrain' WHEN stale AND claims = 1 AND foreign_claims = 1 THEN 'StaleLease' ELSE '' END AS reason FROM c) "
    "SELECT pvc, pod, CASE reason WHEN 'MultiAttach' THEN true WHEN '' THEN false ELSE pod <> holder END AS fence, reason FROM r WHERE reason IN ('MultiAttach', '') OR claim",
)
def f22(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    holders = orders.groupBy("o_custkey").agg(F.concat(F.lit("pod-"), F.min("o_orderkey")).alias("holder"))
    volume = F.col("o_custkey")
    mounts = orders.join(holders, "o_custkey").select(
        F.concat(F.lit("pvc-"), volume).alias("pvc"),
        F.concat(F.lit("pod-"), "o_orderkey").alias("pod"),
        F.when(F.col("o_orderkey") % 4 == 0, "primary").otherwise("replica").alias("role"),
        (F.col("o_orderstatus") != "F").alias("ready"),
        "holder",
        F.when(volume % 10 != 0, F.lit(AS_OF) - volume % 100 * MINUTE).alias("renewed_at"),
        F.when(volume % 9 == 0, 0).otherwise(1800).alias("duration_s"),
        (volume % 17 == 0).alias("multi_attach"),
    )
    return M.fence_decisions(mounts, AS_OF)


@query(
    "f23_switchover_check",
    f"WITH {MEMBERS_SQL}, q AS (SELECT event_id, 'c' || (user_id // 25) AS cluster, 'pod-' || (user_id + CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END) AS target FROM events) "
    "SELECT event_id, q.cluster, q.target, CASE WHEN place = 'primary' THEN 'already primary' WHEN place = 'replica' AND ready THEN 'ok' ELSE 'not found or not ready' END AS verdict, "
    "CASE WHEN place = 'replica' AND ready THEN endpoint END AS endpoint FROM q LEFT JOIN members m ON m.pod = q.target AND m.cluster = q.cluster AND place <> 'unused'",
)
def f23(spark, sf_dir):
    shift = F.when(F.col("event_id") % 5 == 0, 40).otherwise(0)
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("c"), F.expr("user_id div 25")).alias("cluster"),
        F.concat(F.lit("pod-"), F.col("user_id") + shift).alias("target"),
    )
    return M.check_switchovers(requests, members(spark, sf_dir))
