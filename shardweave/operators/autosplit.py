"""Deciding which shards to split from what was observed of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.held import sustained, with_held_since
from shardweave.operators.scan import MINUTE
from shardweave.operators.topologies import split_suffix, split_targets
from shardweave.sources.topology import bound_text

BYTES_PER_GB = 1_000_000_000
MAX_NAME = 63
# Phases of a split job that has ended.
FINISHED_PHASES = ("Completed", "Failed", "Aborted")
# Why a cluster does or does not split.
DISABLED, UNSUPPORTED, NO_METRICS = "Disabled", "UnsupportedVindex", "MetricsSourceMissing"
NO_CANDIDATE, IN_PROGRESS, CANDIDATE = "NoCandidate", "SplitInProgress", "SplitCandidate"


@dataclass(frozen=True)
class Triggers:
    """Thresholds; 0 switches a trigger off.  All enabled triggers must hold."""

    size_gb: int = 0
    cpu_percent: int = 0
    p99_ms: int = 0
    volume_percent: int = 0
    duration_minutes: int = 0


def cpu_percent(used: Column, request: Column) -> Column:
    """Whole percent of the requested CPU; NULL if either side is not positive."""
    return F.when((used > 0) & (request > 0), F.call_function("div", used * 100, request))


def observe_shards(status: DataFrame, cpu: DataFrame, capacity: DataFrame, on: Sequence[str], shard: str = "shard") -> DataFrame:
    """Observations per shard; 0 stands for "not observed"."""
    joined = status.join(cpu, list(on), "left").join(capacity, shard, "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("size", "cpu_percent", "capacity") if c in joined.columns}
    return joined.withColumns(filled)


def volume_breached(size: Column, capacity: Column, percent: int) -> Column:
    return (size > 0) & (capacity > 0) & (size * 100 >= capacity * percent)


def breached(triggers: Triggers, size: Column, cpu: Column, p99: Column, capacity: Column) -> Column:
    """All enabled triggers hold, and at least one is enabled."""
    tests = []
    if triggers.size_gb > 0:
        tests.append(size >= F.lit(triggers.size_gb * BYTES_PER_GB))
    if triggers.cpu_percent > 0:
        tests.append(cpu >= triggers.cpu_percent)
    if triggers.p99_ms > 0:
        tests.append(p99 >= triggers.p99_ms)
    if triggers.volume_percent > 0:
        tests.append(volume_breached(size, capacity, triggers.volume_percent))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def sustained_breach(
    observations: DataFrame, keys: Sequence[str], at: str, tie: str, triggers: Triggers, bucket: Column, p99: Column | None = None
) -> DataFrame:
    """Append ``breach`` and ``held``: the breach has lasted for the trigger duration."""
    test = breached(triggers, F.col("size"), F.col("cpu_percent"), F.lit(0) if p99 is None else p99, F.col("capacity"))
    flagged = observations.withColumn("breach", F.coalesce(test, F.lit(False)))
    since = with_held_since(flagged, keys, at, tie, F.col("breach"), bucket, out="__since")
    held = sustained(F.col(at), F.col("__since"), triggers.duration_minutes * MINUTE)
    return since.withColumn("held", held).drop("__since")


def p99_latency(samples: DataFrame, by: Sequence[str], latency: str, accuracy: int = 10000) -> DataFrame:
    """99th percentile per group, from one pass over the samples."""
    return samples.groupBy(*by).agg(F.percentile_approx(latency, 0.99, accuracy).alias("p99"))


def quantile_sketches(samples: DataFrame, by: Sequence[str], value: str, k: int = 800) -> DataFrame:
    """A quantile sketch per group, as a table that can be stored.  Its rank error is about ``2 / k`` at most."""
    known = samples.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Named quantiles and the number of samples per group, from stored sketches of shards, windows or both."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("__all"))
    found = [F.kll_sketch_get_quantile_double("__all", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return merged.select(*by, F.kll_sketch_get_n_double("__all").alias("n_samples"), *found)


# --- candidates and plans -------------------------------------------------------------


def splittable_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of hash keyspaces whose shard owns exactly one range and has a name."""
    usable = ranges.filter((F.col("vindex_type") == "hash") & (F.col("shard") != ""))
    single = usable.groupBy("cluster", "keyspace", "shard").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return usable.join(single, ["cluster", "keyspace", "shard"], "left_semi")


def active_splits(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("phase").isin(*FINISHED_PHASES)).select("cluster").distinct()


def choose_split(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """One candidate per cluster, first by keyspace and list position; none while a split runs."""
    fields = [c for c in candidates.columns if c != "cluster"]
    first = F.min_by(F.struct(*fields), F.struct("keyspace", "pos"))
    free = candidates.join(active_splits(jobs), "cluster", "left_anti")
    return free.groupBy("cluster").agg(first.alias("c")).select("cluster", "c.*")


def sanitize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]", "-"), F.lit("-"))


def split_job_name(keyspace: Column, shard: Column, lo: Column, hi: Column) -> Column:
    suffix = split_suffix(bound_text(lo), bound_text(hi))
    name = F.concat_ws("-", F.lit("autosplit"), sanitize(keyspace), sanitize(shard), suffix)
    return F.rtrim(F.substring(name, 1, MAX_NAME), F.lit("-"))


def emit_plans(chosen: DataFrame, jobs: DataFrame, approval: bool) -> DataFrame:
    """Two target rows per new split job; a job that exists already is not made again."""
    lo, hi = F.col("lo"), F.col("hi")
    named = chosen.filter(lo < hi).withColumns(
        {"job": split_job_name(F.col("keyspace"), F.col("shard"), lo, hi), "source": F.col("shard")}
    )
    fresh = named.join(jobs.select("job"), "job", "left_anti")
    approved = F.lit("required" if approval else "auto").alias("approval")
    return split_targets(fresh).select("cluster", "keyspace", "job", "source", "shard", "lo", "hi", approved)


def held_for_approval(jobs: DataFrame) -> DataFrame:
    """Automatic jobs that need an approval and do not have it."""
    return jobs.filter(F.col("automatic") & (F.col("approval") == "required") & ~F.coalesce("approved", F.lit(False)))


def split_reason(clusters: DataFrame, ranges: DataFrame, candidates: DataFrame, jobs: DataFrame, triggers: Triggers) -> DataFrame:
    """Why each cluster does or does not split.  ``clusters``: cluster, enabled."""
    foreign = ranges.filter("vindex_type <> 'hash'").select("cluster").distinct().withColumn("__foreign", F.lit(True))
    eligible = candidates.groupBy("cluster").agg(F.count(F.lit(1)).alias("eligible"))
    busy = active_splits(jobs).withColumn("__busy", F.lit(True))
    joined = clusters.join(foreign, "cluster", "left").join(eligible, "cluster", "left").join(busy, "cluster", "left")
    reason = (
        F.when(~F.col("enabled"), DISABLED)
        .when(F.col("eligible").isNull() & F.col("__foreign").isNotNull(), UNSUPPORTED)
        .when(F.col("eligible").isNull() & F.lit(triggers.p99_ms > 0), NO_METRICS)
        .when(F.col("eligible").isNull(), NO_CANDIDATE)
        .when(F.col("__busy").isNotNull(), IN_PROGRESS)
        .otherwise(CANDIDATE)
    )
    return joined.select("cluster", F.coalesce("eligible", F.lit(0)).cast("long").alias("eligible"), reason.alias("reason"))
