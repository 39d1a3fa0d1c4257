"""Status of shard members from heartbeats, and the decisions that follow from it.

Times are LONG microseconds.  A shard has one primary and at most 15 replicas; everything
per shard is still computed with combining aggregates and joins, not with windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.scan import MICROS, MINUTE

STALE_AFTER = 30 * MICROS
STUCK_AFTER = 8 * MINUTE
RESEED_EVERY = 10 * MINUTE
FAILOVER_DEBOUNCE = 8 * MICROS
MAX_REPLICAS = 15

# Reasons of a member that is not ready.
POD_NOT_READY, FENCED, ROGUE = "pod-not-ready", "fenced", "rogue-primary"
# Reasons of a failure decision.
NO_FAILURE, NO_PRIMARY, NOT_READY, NO_REPLICA = "None", "NoPrimary", "PrimaryNotReady", "NoEligibleReplica"
# Phases of a cluster.
HIBERNATED, DEGRADED, READY, PROVISIONING = "Hibernated", "Degraded", "Ready", "Provisioning"
# Reasons to fence a volume.
MULTI_ATTACH, SPLIT_BRAIN, STALE_LEASE = "MultiAttach", "SplitBrain", "StaleLease"
# Status of a managed role, and the names that are never managed.
RESERVED, RECONCILED, PENDING = "reserved", "reconciled", "pending-reconciliation"
RESERVED_ROLES = ("postgres", "streaming_replica")


def latest_status(heartbeats: DataFrame, member: str = "pod", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The last heartbeat of every member; later ones win whatever their arrival order."""
    fields = [c for c in heartbeats.columns if c != member]
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return heartbeats.groupBy(member).agg(last.alias("__last")).select(member, "__last.*")


def is_stale(at: Column, as_of: int, limit: int = STALE_AFTER) -> Column:
    return F.lit(as_of) - at > F.lit(limit)


def member_status(pods: DataFrame, latest: DataFrame, fences: DataFrame, as_of: int, stale_after: int = STALE_AFTER) -> DataFrame:
    """Every member with its effective readiness, reason and place in its shard.

    ``pods``: pod, shard, cluster, pod_ready, is_job, is_target.  ``latest``: pod, role,
    promoted, ready, endpoint, lag, size, reason, at.  ``fences``: pod.
    ``place`` is primary, replica, or unused for a target that finds a primary in place.
    """
    fenced = fences.select("pod").distinct().withColumn("fenced", F.lit(True))
    members = (
        pods.filter(~F.col("is_job"))
        .join(latest.withColumn("has_status", F.lit(True)).withColumnRenamed("ready", "said_ready"), "pod", "left")
        .join(fenced, "pod", "left")
        .withColumns({"fenced": F.coalesce("fenced", F.lit(False)), "has_status": F.coalesce("has_status", F.lit(False))})
    )
    claims = F.col("has_status") & (F.col("role") == "primary") & ~F.col("fenced")
    proven = members.filter(claims & F.col("promoted")).select("cluster", "shard").distinct().withColumn("proven", F.lit(True))
    members = members.join(proven, ["cluster", "shard"], "left")
    rogue = claims & ~F.col("promoted") & F.coalesce("proven", F.lit(False))
    ready = F.col("said_ready") & ~is_stale(F.col("at"), as_of, stale_after) & F.col("pod_ready") & ~F.col("fenced") & ~rogue
    target = ~F.col("has_status") & F.col("is_target") & F.col("pod_ready")
    reason = F.when(rogue, ROGUE).when(
        F.col("has_status"),
        F.coalesce(
            F.nullif(F.col("reason"), F.lit("")),
            F.when(~F.col("pod_ready"), POD_NOT_READY),
            F.when(F.col("fenced"), FENCED),
        ),
    )
    members = members.withColumns(
        {
            "rogue": rogue,
            "target": target,
            "candidate": (claims & ~rogue) | target,
            "ready": F.when(F.col("has_status"), ready).otherwise(target),
            "reason": reason,
            "lag": F.when(F.col("has_status"), F.greatest("lag", F.lit(0))).otherwise(F.lit(0)),
            "size": F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)),
            "endpoint": F.coalesce("endpoint", F.concat("pod", F.lit(":5432"))),
        }
    )
    chosen = members.filter("candidate").groupBy("cluster", "shard").agg(
        F.min("pod").alias("__primary"), F.count_if(~F.col("target")).alias("claimants")
    )
    place = (
        F.when(F.col("pod") == F.col("__primary"), "primary")
        .when(F.col("target"), "unused")
        .otherwise("replica")
    )
    return members.join(chosen, ["cluster", "shard"], "left").select(
        "cluster", "shard", "pod", place.alias("place"), "ready", "reason", "lag", "size", "endpoint",
        "has_status", "fenced", "rogue", "target", "pod_ready",
        F.coalesce("claimants", F.lit(0)).alias("claimants"),
    )


def split_brain(members: DataFrame) -> DataFrame:
    """Shards with more than one surviving claim to be primary."""
    return members.filter(F.col("claimants") > 1).select("cluster", "shard", "claimants").distinct()


def shard_status(members: DataFrame) -> DataFrame:
    """One row per shard: primary as a struct, replicas as an array ordered by name, size of the primary.

    The array has at most ``MAX_REPLICAS`` entries besides surplus claimants.
    """
    one = F.struct("pod", "endpoint", "ready", "lag", "reason")
    # The array keeps its order by name through array_sort; there is at most one primary.
    return members.groupBy("cluster", "shard").agg(
        F.any_value(F.when(F.col("place") == "primary", one), ignoreNulls=True).alias("primary"),
        F.array_sort(F.collect_list(F.when(F.col("place") == "replica", one))).alias("replicas"),
        F.max(F.when(F.col("place") == "primary", F.col("size"))).alias("size"),
    )


def member_lag(positions: DataFrame) -> DataFrame:
    """Lag per member: a primary's is that of its slowest replica, a replica's is what it has not replayed.

    ``positions``: shard, pod, role, current, flushed, received, replayed, failed.  -1 when
    the position could not be read.
    """
    slowest = positions.filter("role = 'replica'").groupBy("shard").agg(F.min("flushed").alias("__flushed"))
    behind = F.when(
        F.col("role") == "primary", F.coalesce(F.greatest(F.col("current") - F.col("__flushed"), F.lit(0)), F.lit(0))
    ).otherwise(F.col("received") - F.col("replayed"))
    lag = F.when(F.col("failed"), F.lit(-1)).otherwise(F.coalesce(behind, F.lit(-1)))
    return positions.join(slowest, "shard", "left").select("shard", "pod", "role", lag.cast("long").alias("lag"))


# --- failure --------------------------------------------------------------------------


def promotion_candidate(replicas: str = "replicas") -> Column:
    """Ready replica with the least lag, ties by name, as a struct; NULL when there is none."""
    ready = F.filter(replicas, lambda r: r["ready"])
    ranked = F.transform(ready, lambda r: F.struct(r["lag"].alias("lag"), r["pod"].alias("pod"), r["endpoint"].alias("endpoint")))
    return F.array_min(ranked)


def failure_decision(shards: DataFrame) -> DataFrame:
    """(cluster, shard, failed, reason, candidate) for every shard status row."""
    judged = shards.withColumn("__best", promotion_candidate())
    healthy = F.coalesce(F.col("primary.ready"), F.lit(False))
    reason = (
        F.when(healthy, NO_FAILURE)
        .when(F.col("__best").isNull(), NO_REPLICA)
        .when(F.col("primary").isNull(), NO_PRIMARY)
        .otherwise(NOT_READY)
    )
    return judged.select(
        "cluster", "shard", (~healthy).alias("failed"), reason.alias("reason"),
        F.when(~healthy, F.col("__best.pod")).alias("candidate"),
    )


def first_failure(decisions: DataFrame, ordinal: Column) -> DataFrame:
    """The first failed shard of every cluster, by shard ordinal."""
    first = F.min_by(F.struct("shard", "reason", "candidate"), ordinal)
    return decisions.filter("failed").groupBy("cluster").agg(first.alias("f")).select("cluster", "f.*")


def guard_candidates(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """Append ``skip``: the candidate is fenced while an unfenced member of its shard exists."""
    open_shards = members.filter(~F.col("fenced")).select("cluster", "shard").distinct().withColumn("__open", F.lit(True))
    fenced = members.filter("fenced").select("cluster", F.col("pod").alias("candidate")).withColumn("__fenced", F.lit(True))
    judged = decisions.join(open_shards, ["cluster", "shard"], "left").join(fenced, ["cluster", "candidate"], "left")
    skip = F.col("__fenced").isNotNull() & F.col("__open").isNotNull()
    return judged.select(*decisions.columns, skip.alias("skip"))


def stuck_standbys(shards: DataFrame, pods: DataFrame, reseeds: DataFrame, as_of: int) -> DataFrame:
    """Replicas that stay not ready although their primary is, and were not reseeded lately."""
    waiting = shards.filter("primary.ready").select("cluster", "shard", F.explode("replicas").alias("r")).filter("NOT r.ready")
    old = pods.filter(F.lit(as_of) - F.col("created_at") >= F.lit(STUCK_AFTER)).select("pod")
    recent = reseeds.filter(F.lit(as_of) - F.col("reseeded_at") < F.lit(RESEED_EVERY)).select("pod")
    named = waiting.select("cluster", "shard", F.col("r.pod").alias("pod"))
    return named.join(old, "pod").join(recent, "pod", "left_anti")


def rogue_reseeds(shards: DataFrame) -> DataFrame:
    """Rogue members of shards whose primary is ready."""
    listed = shards.filter("primary.ready").select("cluster", "shard", "primary", F.explode("replicas").alias("r"))
    rogue = (F.col("r.reason") == ROGUE) & (F.col("r.pod") != F.col("primary.pod"))
    return listed.filter(rogue).select("cluster", "shard", F.col("r.pod").alias("pod"))


def cluster_phase(clusters: DataFrame, shards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Phase per cluster: Hibernated, Degraded, Ready or Provisioning.

    ``clusters``: cluster, hibernated, was_ready, router_active, router_ready.
    """
    ready = shards.groupBy("cluster").agg(
        F.bool_and(F.coalesce("primary.ready", F.lit(False))).alias("all_ready"), F.count(F.lit(1)).alias("n_shards")
    )
    failed = decisions.groupBy("cluster").agg(F.bool_or("failed").alias("any_failed"))
    joined = clusters.join(ready, "cluster", "left").join(failed, "cluster", "left")
    serving = F.coalesce("all_ready", F.lit(False)) & (~F.col("router_active") | F.col("router_ready"))
    phase = (
        F.when(F.col("hibernated"), HIBERNATED)
        .when(F.col("was_ready") & F.coalesce("any_failed", F.lit(False)), DEGRADED)
        .when(serving, READY)
        .otherwise(PROVISIONING)
    )
    return joined.select("cluster", F.coalesce("n_shards", F.lit(0)).alias("n_shards"), phase.alias("phase"))


def managed_roles(users: DataFrame) -> DataFrame:
    """One row per (cluster, role): status bucket, error and secret version; reserved names included.

    ``users``: cluster, role, applied, generation, observed, message, secret_version.
    """
    applied = F.col("applied") & (F.col("generation") == F.col("observed"))
    named = users.filter(F.col("role") != "").select(
        "cluster", "role",
        F.when(applied, RECONCILED).otherwise(PENDING).alias("status"),
        F.when(~F.col("applied"), F.nullif(F.col("message"), F.lit(""))).alias("error"),
        F.nullif(F.col("secret_version"), F.lit("")).alias("secret_version"),
    )
    reserved = F.explode(F.array(*[F.lit(r) for r in RESERVED_ROLES]))
    none = F.lit(None).cast("string")
    fixed = users.select("cluster").distinct().select(
        "cluster", reserved.alias("role"), F.lit(RESERVED).alias("status"), none.alias("error"), none.alias("secret_version")
    )
    return named.unionByName(fixed)


def lag_samples(shards: DataFrame) -> DataFrame:
    """One row (cluster, shard, pod, role, lag) per member of a shard status row."""
    primary = F.when(F.col("primary").isNotNull(), F.array(F.struct(F.lit("primary").alias("role"), F.col("primary.pod"), F.col("primary.lag"))))
    replicas = F.transform("replicas", lambda r: F.struct(F.lit("replica").alias("role"), r["pod"].alias("pod"), r["lag"].alias("lag")))
    members = F.concat(F.coalesce(primary, F.filter(replicas, lambda r: F.lit(False))), replicas)
    return shards.select("cluster", "shard", F.explode(members).alias("m")).select("cluster", "shard", "m.pod", "m.role", "m.lag")


def serving_endpoints(shards: DataFrame) -> DataFrame:
    """Endpoint of the ready primary of every shard that has one."""
    usable = F.col("primary.ready") & (F.col("primary.endpoint") != "")
    return shards.filter(usable).select("cluster", "shard", F.col("primary.endpoint").alias("endpoint"))


def fence_decisions(mounts: DataFrame, as_of: int) -> DataFrame:
    """Fence decision per volume and pod; the first rule that applies to a volume wins.

    ``mounts``: pvc, pod, role, ready, holder, renewed_at, duration_s, multi_attach; the
    last four are equal for all pods of a volume.
    """
    claims = (F.col("role") == "primary") & F.col("ready")
    per_volume = mounts.groupBy("pvc").agg(F.count_if(claims).alias("__claims"), F.bool_or("multi_attach").alias("__multi"))
    expiry = F.col("renewed_at") + F.col("duration_s") * F.lit(MICROS)
    stale = F.coalesce((F.col("duration_s") != 0) & (F.lit(as_of) > expiry), F.lit(False))
    foreign = F.col("pod") != F.col("holder")
    late = stale & (F.col("__claims") == 1)
    # Rule three looks at the one claimant: is it not the holder?
    foreign_claim = mounts.filter(claims & foreign).select("pvc").distinct().withColumn("__foreign", F.lit(True))
    joined = mounts.join(per_volume, "pvc").join(foreign_claim, "pvc", "left")
    rule = (
        F.when(F.col("__multi"), MULTI_ATTACH)
        .when(F.col("__claims") >= 2, SPLIT_BRAIN)
        .when(late & F.coalesce("__foreign", F.lit(False)), STALE_LEASE)
        .otherwise("")
    )
    fence = F.when(F.col("reason") == MULTI_ATTACH, True).when(F.col("reason") == "", False).otherwise(foreign)
    listed = joined.withColumn("reason", rule).filter(F.col("reason").isin(MULTI_ATTACH, "") | claims)
    return listed.select("pvc", "pod", fence.alias("fence"), "reason")


def check_switchovers(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Verdict per request to move the primary to a named pod of a cluster."""
    known = members.filter("place <> 'unused'").select(
        "cluster", F.col("pod").alias("target"), "place", "ready", F.col("endpoint").alias("__endpoint")
    )
    joined = requests.join(known, ["cluster", "target"], "left")
    usable = F.coalesce((F.col("place") == "replica") & F.col("ready"), F.lit(False))
    verdict = (
        F.when(F.col("place") == "primary", "already primary").when(usable, "ok").otherwise("not found or not ready")
    )
    return joined.select(
        *requests.columns, verdict.alias("verdict"), F.when(verdict == "ok", F.col("__endpoint")).alias("endpoint")
    )
