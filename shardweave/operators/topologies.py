"""Checks and changes of range tables, for all keyspaces at once.

Range tables have LONG columns ``lo`` and ``hi`` (closed interval) and a list position
``pos`` that is unique within a keyspace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.scan import bucket_of, even_width, ordered_scan, scan_done, scan_ready, scan_step, split_hot
from shardweave.sources.topology import bound_text

# Reasons of a placement drift.
MISSING, EXTRA, ZONE_MISMATCH, NODE_MISMATCH = "Missing", "Extra", "ZoneMismatch", "NodeMismatch"
NOT_READY, RANGE_UNCOVERED = "NotReady", "RangeUncovered"

KEYSPACE = ("cluster", "keyspace")
LO_BUCKET = 1 << 24


def _with_reach(ranges: DataFrame, by: Sequence[str], bucket: Column | None) -> DataFrame:
    """Append ``reach``: the largest hi of all earlier ranges of the keyspace."""
    cut = bucket_of("lo", LO_BUCKET) if bucket is None else bucket
    return ordered_scan(ranges, by, ["lo", "pos"], cut, maxes={"reach": F.col("hi")}, exclusive=True)


def hot_keyspaces(ranges: DataFrame, by: Sequence[str] = KEYSPACE, hot_rows: int = 1_000_000) -> Column:
    """Buckets that cut only the keyspaces with very many ranges."""
    return split_hot(ranges, by, bucket_of("lo", even_width(ranges, "lo", hot_rows, longest=LO_BUCKET)), hot_rows)


def find_overlaps(ranges: DataFrame, by: Sequence[str] = KEYSPACE, bucket: Column | None = None) -> DataFrame:
    """Ranges that are inverted or start inside an earlier range, with the problem named."""
    checked = _with_reach(ranges, by, bucket).withColumn(
        "problem",
        F.when(F.col("lo") > F.col("hi"), "inverted").when(F.col("lo") <= F.col("reach"), "overlap"),
    )
    return checked.filter(F.col("problem").isNotNull())


def find_gaps(ranges: DataFrame, by: Sequence[str] = KEYSPACE, bucket: Column | None = None) -> DataFrame:
    """Uncovered stretches between the first and the last range of each keyspace."""
    behind = _with_reach(ranges, by, bucket).filter(F.col("lo") > F.col("reach") + 1)
    return behind.select(*by, (F.col("reach") + 1).alias("gap_lo"), (F.col("lo") - 1).alias("gap_hi"))


def _plan_side(ranges: DataFrame, by: Sequence[str], side: str, bucket: Column | None) -> DataFrame:
    return _with_reach(ranges, by, bucket).groupBy(*by).agg(
        F.min("lo").alias(f"{side}_lo"),
        F.max("hi").alias(f"{side}_hi"),
        F.count_if(F.col("lo") > F.col("hi")).alias(f"{side}_inverted"),
        F.count_if(F.col("lo") <= F.col("reach")).alias(f"{side}_overlaps"),
        F.count_if(F.col("lo") > F.col("reach") + 1).alias(f"{side}_gaps"),
    )


def check_split_plans(
    sources: DataFrame,
    targets: DataFrame,
    by: Sequence[str] = KEYSPACE,
    source_bucket: Column | None = None,
    target_bucket: Column | None = None,
) -> DataFrame:
    """Per plan: both sides must be contiguous and span exactly the same keys."""
    left = _plan_side(sources, by, "source", source_bucket)
    both = left.join(_plan_side(targets, by, "target", target_bucket), list(by), "full_outer")
    defects = [f"{s}_{d}" for s in ("source", "target") for d in ("inverted", "overlaps", "gaps")]
    clean = sum((F.col(d) for d in defects), F.lit(0)) == 0
    covered = (F.col("source_lo") == F.col("target_lo")) & (F.col("source_hi") == F.col("target_hi"))
    return both.withColumn("covered", F.coalesce(covered, F.lit(False))).withColumn(
        "valid", F.coalesce(clean, F.lit(False)) & F.col("covered")
    )


def split_midpoint(ranges: DataFrame) -> DataFrame:
    """Append the two halves as fixed-width bounds, or the reason why there are none."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = lo + F.floor((hi - lo) / 2)
    error = F.when(lo > hi, "inverted").when(lo == hi, "single key")
    halves = {"lo0": lo, "hi0": mid, "lo1": mid + 1, "hi1": hi}
    return ranges.withColumns(
        {**{n: F.when(error.isNull(), bound_text(v)) for n, v in halves.items()}, "error": error}
    )


def split_suffix(lo_text: Column, hi_text: Column) -> Column:
    """Six hexadecimal digits that name a split of this range."""
    digest = F.crc32(F.encode(F.concat_ws("-", lo_text, hi_text), "UTF-8"))
    return F.lpad(F.lower(F.hex(digest.bitwiseAND(F.lit(0xFFFFFF).cast("long")))), 6, "0")


def split_targets(ranges: DataFrame) -> DataFrame:
    """Two target rows (shard, lo, hi as LONG) for every range that can be split."""
    suffix = split_suffix(bound_text(F.col("lo")), bound_text(F.col("hi")))
    mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
    halves = F.array(
        F.struct(F.concat(F.lit("as"), suffix, F.lit("a")).alias("shard"), F.col("lo").alias("lo"), mid.alias("hi")),
        F.struct(F.concat(F.lit("as"), suffix, F.lit("b")).alias("shard"), (mid + 1).alias("lo"), F.col("hi").alias("hi")),
    )
    kept = [c for c in ranges.columns if c not in ("shard", "lo", "hi")]
    split = ranges.filter(F.col("lo") < F.col("hi")).select(*kept, F.explode(halves).alias("half"))
    return split.select(*kept, "half.shard", "half.lo", "half.hi")


def apply_split(routing: DataFrame, sources: DataFrame, targets: DataFrame, by: Sequence[str] = KEYSPACE) -> DataFrame:
    """Drop the ranges of the source shards, append the targets, keep everything else."""
    kept = routing.join(sources.select(*by, "shard").distinct(), [*by, "shard"], "left_anti")
    return kept.unionByName(targets.select(*kept.columns))


def active_shards(ranges: DataFrame) -> DataFrame:
    return ranges.filter(F.col("shard") != "").select("cluster", "shard").distinct()


def dangling_ranges(ranges: DataFrame, shards: DataFrame) -> DataFrame:
    """Ranges that name a shard which does not exist."""
    return ranges.join(shards.select("shard").distinct(), "shard", "left_anti")


def placement_drift(spec: DataFrame, observed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Differences between wanted and observed placement as (shard_id, reason, detail) rows.

    ``spec``: shard_id, preferred_zone, preferred_node.  ``observed``: shard_id, zone, node,
    ready.  ``ranges``: shard.  Shard ids are unique in spec and observed.
    """
    wanted, seen = spec.withColumn("__spec", F.lit(True)), observed.withColumn("__seen", F.lit(True))
    both = wanted.join(seen, "shard_id", "full_outer")
    in_spec, in_seen = F.col("__spec").isNotNull(), F.col("__seen").isNotNull()

    def differs(want: str, have: str) -> Column:
        return in_spec & in_seen & (F.col(want) != "") & (F.col(have) != "") & (F.col(want) != F.col(have))

    def finding(condition: Column, reason: str, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(reason).alias("reason"), detail.alias("detail")))

    findings = F.array_compact(
        F.array(
            finding(in_spec & ~in_seen, MISSING, F.lit("wanted but not observed")),
            finding(~in_spec & in_seen, EXTRA, F.lit("observed but not wanted")),
            finding(
                differs("preferred_zone", "zone"), ZONE_MISMATCH,
                F.concat(F.lit("preferredZone="), "preferred_zone", F.lit(" observed="), "zone"),
            ),
            finding(
                differs("preferred_node", "node"), NODE_MISMATCH,
                F.concat(F.lit("preferredNode="), "preferred_node", F.lit(" observed="), "node"),
            ),
            finding(in_spec & in_seen & ~F.col("ready"), NOT_READY, F.lit("observed but not ready")),
        )
    )
    drift = both.select("shard_id", F.explode(findings).alias("f")).select("shard_id", "f.reason", "f.detail")
    named = ranges.select(F.col("shard").alias("shard_id")).distinct()
    uncovered = named.join(spec.select("shard_id"), "shard_id", "left_anti").select(
        "shard_id", F.lit(RANGE_UNCOVERED).alias("reason"), F.lit("a range names this shard").alias("detail")
    )
    return drift.unionByName(uncovered).orderBy("shard_id", "reason")


def placement_violations(spec: DataFrame) -> DataFrame:
    """Empty ids, repeated ids and negative weights as (shard_id, violation, n_rows) rows."""
    empty, negative = F.col("shard_id") == "", F.col("weight") < 0
    per_id = spec.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(negative).alias("n_negative"))
    found = F.array_compact(
        F.array(
            F.when(empty, F.struct(F.lit("empty id").alias("violation"), F.col("n").alias("n_rows"))),
            F.when(~empty & (F.col("n") > 1), F.struct(F.lit("duplicate id").alias("violation"), F.col("n").alias("n_rows"))),
            F.when(
                F.col("n_negative") > 0,
                F.struct(F.lit("negative weight").alias("violation"), F.col("n_negative").alias("n_rows")),
            ),
        )
    )
    return per_id.select("shard_id", F.explode(found).alias("v")).select("shard_id", "v.violation", "v.n_rows")


# --- range metadata -------------------------------------------------------------------

METADATA_KEY = ("cluster", "keyspace", "range_lo", "range_hi")


def metadata_upsert(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """New metadata snapshot: new ranges start at generation 1, known ones go up by one.

    ``incoming`` rows with an empty key field or shard are rejected; the rest must be
    unique on the key.
    """
    fields = [*METADATA_KEY, "shard_id", "vindex_type"]
    usable = incoming.filter(~F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in fields]), lambda x: x == ""))
    fresh = usable.select(
        *METADATA_KEY, F.col("shard_id").alias("__shard_id"), F.col("vindex_type").alias("__vindex_type")
    )
    merged = current.join(fresh, list(METADATA_KEY), "full_outer")
    changed = F.col("__shard_id").isNotNull()
    return merged.select(
        *METADATA_KEY,
        F.coalesce("__shard_id", "shard_id").alias("shard_id"),
        F.coalesce("__vindex_type", "vindex_type").alias("vindex_type"),
        (F.coalesce("generation", F.lit(0)) + changed.cast("long")).alias("generation"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def metadata_list(current: DataFrame, cluster: str | None = None, keyspace: str | None = None) -> DataFrame:
    if cluster is not None:
        current = current.filter(F.col("cluster") == cluster)
    if keyspace is not None:
        current = current.filter(F.col("keyspace") == keyspace)
    return current.orderBy("range_lo", F.desc("generation"))


def metadata_delete(current: DataFrame, doomed: DataFrame) -> DataFrame:
    return current.join(doomed.select(*METADATA_KEY).distinct(), list(METADATA_KEY), "left_anti")


def with_generation(
    versions: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, spec: Sequence[str]
) -> DataFrame:
    """Append ``generation``: 1 for the first version of an object, one more at every change of ``spec``."""
    row = F.struct(*spec)
    chained = scan_step(scan_ready(versions, keys, bucket), order, previous={"__before": row})
    changed = F.col("__before").isNull() | ~F.col("__before").eqNullSafe(row)
    return scan_done(scan_step(chained, order, sums={"generation": changed.cast("long")})).drop("__before")


def topology_rollup(ranges: DataFrame, by: Sequence[str] = KEYSPACE) -> DataFrame:
    """Ranges per keyspace, in total and per shard as a map."""
    per_shard = ranges.groupBy(*by, "shard").agg(F.count(F.lit(1)).alias("n"))
    return per_shard.groupBy(*by).agg(
        F.sum("n").alias("total_ranges"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("shard", "n")))).alias("ranges_by_shard"),
    )
