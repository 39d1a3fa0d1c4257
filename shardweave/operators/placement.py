"""Placing rows on shards."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardweave.functions.hashing import MASK32, hash_batch, hash_text, hash_value, hash_values, key_text, with_key_hash
from shardweave.operators.intervals import HASH_BIN_BITS, first_match, interval_case, interval_join
from shardweave.operators.scan import as_of_join, ordered_scan
from shardweave.sources.topology import Topology, TopologyError

SHARD = "__shard"
MAX_CASE_BRANCHES = 64
MAX_LOCAL_POINTS = 1 << 16


class ShardKeyError(KeyError):
    """The table has no such shard key column."""


def find_column(df: DataFrame, name: str) -> str:
    """Actual spelling of column ``name``, matched without regard to case."""
    for column in df.columns:
        if column.lower() == name.lower():
            return column
    raise ShardKeyError(f"no column {name!r} in {df.columns}")


# --- consistent hashing ---------------------------------------------------------------


def ring_points(shards: DataFrame, shard: str, vnodes: int, function: str = "murmur3", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by…, shard, vnode, hash) per virtual node of every distinct non-empty shard."""
    nodes = (
        shards.filter(F.col(shard) != "")
        .select(*by, shard)
        .distinct()
        .withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    )
    label = F.concat_ws(":", F.col(shard), F.col("vnode").cast("string"))
    return nodes.withColumn("hash", hash_text(function, label))


def ring_intervals(points: DataFrame, shard: str) -> DataFrame:
    """The ring as closed hash intervals (lo, hi, shard), the wrap-around included.

    A key belongs to the first point at or after its hash; equal hashes go to the
    smallest shard name.
    """
    owners = points.groupBy("hash").agg(F.min(shard).alias(shard))
    chained = ordered_scan(
        owners, [], ["hash"], F.shiftright("hash", HASH_BIN_BITS), previous={"__before": F.col("hash")}
    )
    arcs = chained.select((F.coalesce("__before", F.lit(-1)) + 1).alias("lo"), F.col("hash").alias("hi"), F.col(shard))
    ends = owners.agg(F.max("hash").alias("last"), F.min_by(shard, "hash").alias(shard))
    wrap = ends.filter(F.col("last") < MASK32).select(
        (F.col("last") + 1).alias("lo"), F.lit(MASK32).cast("long").alias("hi"), F.col(shard)
    )
    return arcs.unionByName(wrap)


@lru_cache(maxsize=16)
def _topology_points(topology: Topology) -> list[tuple[int, str]]:
    """Sorted (hash, shard) points of one keyspace, computed without a job."""
    owners = [s for s in topology.shards for _ in range(topology.vnodes)]
    labels = [f"{s}:{v}" for s in topology.shards for v in range(topology.vnodes)]
    return sorted(zip(hash_values(topology.function, labels), owners))


def _local_arcs(topology: Topology) -> list[tuple[int, int, str]]:
    """Ring intervals (lo, hi, shard) of one keyspace, computed without a job."""
    points: dict[int, str] = {}
    for h, s in _topology_points(topology):
        points.setdefault(h, s)
    ends = list(points)
    arcs = [(a + 1, b, points[b]) for a, b in zip([-1, *ends], ends)]
    if ends[-1] < MASK32:
        arcs.append((ends[-1] + 1, MASK32, points[ends[0]]))
    return arcs


def topology_ring(spark: SparkSession, topology: Topology) -> DataFrame:
    """Ring intervals (lo, hi, shard) of one keyspace; large rings are built as a job."""
    if len(topology.shards) * topology.vnodes <= MAX_LOCAL_POINTS:
        return spark.createDataFrame(_local_arcs(topology), "lo LONG, hi LONG, shard STRING")
    shards = spark.createDataFrame([(s,) for s in topology.shards], "shard STRING")
    return ring_intervals(ring_points(shards, "shard", topology.vnodes, topology.function), "shard")


def ring_lookup(df: DataFrame, key: str, points: DataFrame, shard: str, function: str = "murmur3", width: int = 1 << 20) -> DataFrame:
    """Owner of every key on a ring that may be as large as the data.

    The first point at or after a hash is the last one before it on the negated axis, so
    this is one as-of join over the hash order.  The owner of the smallest point is listed
    once more beyond the last point, where the ring wraps around.
    """
    owners = points.groupBy("hash").agg(F.min(shard).alias(shard)).select((-F.col("hash")).alias("__point"), shard)
    beyond = F.lit(-(MASK32 + 1)).cast("long").alias("__point")
    wrap = owners.agg(F.max_by(shard, "__point").alias(shard)).select(beyond, shard)
    hashed = with_key_hash(df, key, function).withColumn("__place", -F.col("__hash"))
    found = as_of_join(hashed, owners.unionByName(wrap), [], "__place", "__point", "__point", [shard], width)
    return found.select(*df.columns, shard)


# --- assignment -----------------------------------------------------------------------


def _range_case(key: Column, topology: Topology) -> Column:
    entries = [(r.lo, r.hi, r.shard) for r in topology.ranges]
    if len(entries) <= MAX_CASE_BRANCHES:
        return interval_case(key, entries)
    listed = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(s).alias("shard")) for a, b, s in entries])
    return F.get(F.filter(listed, lambda r: key.between(r["lo"], r["hi"])), 0)["shard"]


def assign_shard(
    df: DataFrame,
    topology: Topology,
    out: str = SHARD,
    strict: bool = False,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Append the shard of every row.

    Unplaced rows get NULL, or fail the job when ``strict``.  ``mapping`` is the
    (key, shard) table of a lookup vindex.  Narrow for all vindex types but lookup.
    """
    key = find_column(df, topology.column)
    if topology.vindex_type == "hash":
        intervals = first_match(topology.hash_intervals())
        hashed = with_key_hash(df, key, topology.function)
        if len(intervals) <= MAX_CASE_BRANCHES:
            placed = hashed.withColumn(out, interval_case(F.col("__hash"), intervals)).drop("__hash")
        else:
            table = df.sparkSession.createDataFrame(intervals, f"__lo LONG, __hi LONG, `{out}` STRING")
            placed = interval_join(hashed, "__hash", table, "__lo", "__hi", small=True).drop("__hash", "__lo", "__hi")
    elif topology.vindex_type == "consistent-hash":
        ring = topology_ring(df.sparkSession, topology).toDF("__lo", "__hi", out)
        bounded = len(topology.shards) * topology.vnodes <= MAX_LOCAL_POINTS
        hashed = with_key_hash(df, key, topology.function)
        placed = interval_join(hashed, "__hash", ring, "__lo", "__hi", small=bounded).drop("__hash", "__lo", "__hi")
    elif topology.vindex_type == "range":
        placed = df.withColumn(out, _range_case(key_text(df, key), topology))
    else:
        if mapping is None:
            raise TopologyError("a lookup vindex needs its mapping table")
        # a key may be listed more than once, but not for several shards
        two = F.concat(F.lit("several shards for key "), F.col("__key").cast("string"))
        listed = mapping.groupBy(F.col("key").alias("__key")).agg(F.min("shard").alias("__a"), F.max("shard").alias("__b"))
        named = listed.select("__key", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.raise_error(two)).alias(out))
        placed = df.join(named, F.col(f"`{key}`") == F.col("__key"), "left").drop("__key")
    if strict:
        message = F.concat(F.lit("no range for key "), key_text(placed, key))
        placed = placed.withColumn(out, F.coalesce(F.col(out), F.raise_error(message)))
    return placed


def shards_of(keys: Column, topology: Topology) -> Column:
    """Shard of every text of an array column, NULL where no range holds it.  Narrow: one Arrow call a batch."""
    kind, function = topology.vindex_type, topology.function
    if kind == "hash":
        arcs = first_match(topology.hash_intervals())
    elif kind == "consistent-hash":
        arcs = _local_arcs(topology)
    elif kind == "range":
        arcs = [(r.lo, r.hi, r.shard) for r in topology.ranges]
    else:
        raise TopologyError("a lookup key is resolved by joining its mapping table")

    @F.arrow_udf("array<string>")
    def placed(lists: pa.Array) -> pa.Array:
        texts = lists.flatten()
        if kind == "range":
            found = pa.nulls(len(texts), pa.string())
            for lo, hi, shard in reversed(arcs):
                inside = pc.and_(pc.greater_equal(texts, lo), pc.less_equal(texts, hi))
                found = pc.if_else(pc.fill_null(inside, False), shard, found)
        else:
            ordered = sorted(arcs)
            starts, ends = (np.array([a[k] for a in ordered], np.int64) for k in (0, 1))
            hashes = hash_batch(function, texts)
            at = np.searchsorted(starts, hashes, side="right") - 1
            inside = (at >= 0) & (hashes <= ends[np.maximum(at, 0)]) if len(starts) else np.zeros(len(texts), bool)
            names = pa.array([a[2] for a in ordered], pa.string())
            found = names.take(pa.array(np.where(inside, at, 0), mask=~inside))
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found)

    return placed(keys)


def resolve_key(topology: Topology, key: object) -> str:
    """Shard of one literal key, for pruning.  No Spark job."""
    text = "" if key is None else str(key)
    if topology.vindex_type == "range":
        found = next((r.shard for r in topology.ranges if r.lo <= text <= r.hi), None)
    else:
        h = hash_value(topology.function, text)
        if topology.vindex_type == "hash":
            found = next((s for lo, hi, s in topology.hash_intervals() if lo <= h <= hi), None)
        elif topology.vindex_type == "consistent-hash":
            points = _topology_points(topology)
            at = bisect_left(points, (h, ""))
            found = points[at % len(points)][1]
        else:
            raise TopologyError("a lookup key is resolved by joining its mapping table")
    if found is None:
        raise TopologyError(f"no range for key {text!r}")
    return found


def shard_distribution(placed: DataFrame, shard: str = SHARD) -> DataFrame:
    """Rows per shard and their ratio to the mean."""
    counts = placed.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy()
    return counts.withColumn("ratio", F.round(F.col("n_rows") / F.avg("n_rows").over(everything), 6))


def movement(df: DataFrame, before: Topology, after: Topology) -> DataFrame:
    """Rows per (from, to) shard pair under a topology change, with their share of all rows."""
    # one pass: both topologies look the key up in the same Arrow batch, without a join
    keys = {side: F.array(key_text(df, find_column(df, t.column))) for side, t in (("from", before), ("to", after))}
    shards = [F.get(shards_of(keys[side], t), F.lit(0)).alias(f"{side}_shard") for side, t in (("from", before), ("to", after))]
    both = df.select(*shards)
    pairs = both.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"))
    share = F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6)
    return pairs.withColumn("share", share).withColumn("moved", ~F.col("from_shard").eqNullSafe(F.col("to_shard")))
