"""Trees of content digests: find where two tables differ without comparing their rows.

Rows fall into buckets by a hash of their key; a leaf is the digest of a bucket and a node the sum of the digests
below it.  Two trees are compared from the root down, and only below nodes that differ; rows are read only of
buckets whose leaves differ.  Equal tables cost one aggregate each.  A tree is a table that can be stored
beside its data and compared with one of another system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.sources.deltas import content_digest

#: Buckets of a tree (2 ** BITS) and children of a node (2 ** STEP).
BITS, STEP = 16, 8
_DIGEST = ("n", "mixed", "total")


def bucket_of_key(key: str, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def hash_tree(df: DataFrame, key: str, columns: Sequence[str] | None = None, bits: int = BITS) -> DataFrame:
    """Leaves (bucket, n, mixed, total) of the buckets that have rows."""
    return df.groupBy(bucket_of_key(key, bits).alias("bucket")).agg(*content_digest(columns or sorted(df.columns)))


def level_above(leaves: DataFrame, steps: int, step: int = STEP) -> DataFrame:
    """Nodes (bucket, n, mixed, total) so many steps above the leaves."""
    sums = [F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").cast("decimal(38,0)").alias("total")]
    return leaves.groupBy(F.shiftright("bucket", step * steps).alias("bucket")).agg(*sums)


def differing_buckets(left: DataFrame, right: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """Buckets whose leaves differ, by descent from the root."""
    sides = [t.withColumn("side", F.lit(s)) for s, t in (("l", left), ("r", right))]

    def unequal(nodes: tuple[DataFrame, DataFrame]) -> DataFrame:
        digest = F.struct(*_DIGEST)
        both = nodes[0].unionByName(nodes[1]).groupBy("bucket").agg(
            F.max(F.when(F.col("side") == "l", digest)).alias("l"), F.max(F.when(F.col("side") == "r", digest)).alias("r")
        )
        return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")

    found = None
    for steps in range(-(-bits // step) - 1, -1, -1):
        nodes = tuple(level_above(t, steps, step).withColumn("side", F.lit(s)) if steps else d for (s, t), d in zip((("l", left), ("r", right)), sides))
        if found is not None:
            above = found.select(F.col("bucket").alias("__above"))
            nodes = tuple(n.join(above, F.shiftright("bucket", step) == F.col("__above"), "left_semi") for n in nodes)
        found = unequal(nodes)
    return found
