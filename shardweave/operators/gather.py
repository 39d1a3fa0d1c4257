"""Reading a sharded table as one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardweave.operators.placement import SHARD, find_column
from shardweave.operators.scan import ordered_scan


class NotMergeable(ValueError):
    """The aggregate cannot be rebuilt from per-shard partials."""


# --- order and limit ------------------------------------------------------------------


def order_column(df: DataFrame, by: str | int, descending: bool = False) -> Column:
    """Sort order of a column named without regard to case or by 1-based position; NULL is largest."""
    if isinstance(by, int) or by.isdigit():
        position = int(by)
        if not 1 <= position <= len(df.columns):
            raise IndexError(f"ORDER BY position {position} is not in 1..{len(df.columns)}")
        name = df.columns[position - 1]
    else:
        name = find_column(df, by)
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def merge_ordered(df: DataFrame, by: Sequence[str | int], descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Global order over all shards; ties keep shard order, then ``ties``."""
    return df.orderBy(*[order_column(df, b, descending) for b in by], SHARD, *ties)


def shard_top(df: DataFrame, order: Sequence[Column], n: int, shard: str = SHARD) -> DataFrame:
    """The first ``n`` rows of every shard.  Spark keeps at most n rows per shard and task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(shard).orderBy(*order))
    return df.withColumn("nth", nth).filter(F.col("nth") <= n)


# --- partial and final aggregates -----------------------------------------------------


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None


def _partial(name: str, agg: Aggregate) -> list[Column]:
    col = F.col(agg.column) if agg.column else F.lit(1)
    if agg.function == "count":
        return [F.count(col).alias(name)]
    if agg.function in ("sum", "min", "max"):
        return [getattr(F, agg.function)(col).alias(name)]
    if agg.function == "avg":
        return [F.sum(col).alias(f"{name}__sum"), F.count(col).alias(f"{name}__count")]
    if agg.function == "approx_distinct":
        return [F.hll_sketch_agg(col).alias(name)]
    raise NotMergeable(f"{agg.function} has no mergeable partial form")


def _final(name: str, agg: Aggregate) -> Column:
    if agg.function == "count":
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)
    if agg.function in ("sum", "min", "max"):
        return getattr(F, agg.function)(name).alias(name)
    if agg.function == "avg":
        n = F.nullif(F.sum(f"{name}__count"), F.lit(0))
        return (F.sum(f"{name}__sum").cast("double") / n).alias(name)
    if agg.function == "approx_distinct":
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).alias(name)
    raise NotMergeable(f"{agg.function} has no mergeable partial form")


def shard_partials(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Aggregate], shard: str = SHARD) -> DataFrame:
    """Per-shard partial rows, as a table that can be stored."""
    cols = [c for name, agg in aggregates.items() for c in _partial(name, agg)]
    return df.groupBy(shard, *keys).agg(*cols)


def merge_partials(partials: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """Global result of stored partial rows.  NULL group keys stay apart from any text."""
    return partials.groupBy(*keys).agg(*[_final(name, agg) for name, agg in aggregates.items()])


def distinct_partials(df: DataFrame, keys: Sequence[str], column: str, shard: str = SHARD) -> DataFrame:
    """What each shard stores to count different values exactly: bitmaps of whole numbers, the values themselves else.

    A bitmap is 4 KB for 32,768 neighbouring numbers, so it pays where values lie close; ``values`` of other types
    are one row each.  NULL is no value.
    """
    known = df.filter(F.col(column).isNotNull())
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return known.select(shard, *keys, F.col(column).alias("value")).distinct()
    value = F.col(column).cast("long")
    return known.groupBy(shard, *keys, F.shiftright(value, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(value.bitwiseAND(F.lit(32767))).alias("bits")
    )


def merge_distinct(partials: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact number of different values over stored partials of any shards; a group without a value has no row."""
    if "bits" not in partials.columns:
        return partials.select(*keys, "value").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    merged = partials.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("__n"))
    return merged.groupBy(*keys).agg(F.sum("__n").alias(name))


def item_merge_kind(item: Column) -> Column:
    """How one select item of a logged statement is merged: group key, count, sum, min, max or not mergeable."""
    # quoted text may hold parentheses; what counts is one call with nothing but an alias behind it
    text = F.regexp_replace(F.lower(F.trim(item)), r"'(?:''|[^'])*'", "''")
    inner = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*"
    call = F.regexp_extract(text, rf"^(count|sum|min|max)\s*\({inner}\)(?:\s+(?:as\s+)?(?!over\b|filter\b|within\b)[\p{{L}}_][\p{{L}}\p{{N}}_$]*)?$", 1)
    return (
        F.when(text.rlike(r"\(\s*distinct\b"), "not mergeable")
        .when(call != "", call)
        .when(text.rlike(r"\("), "not mergeable")
        .otherwise("group key")
    )


# --- endpoints ------------------------------------------------------------------------


def eligible_replicas(members: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Ready replicas with an endpoint and a bounded lag, numbered from 0 within their shard."""
    keep = (F.col("role") == "replica") & F.col("ready") & (F.coalesce("endpoint", F.lit("")) != "")
    if max_lag is not None:
        keep = keep & (F.col("lag") <= max_lag)
    ready = members.filter(keep).select("shard", "endpoint", "pod")
    slot = F.row_number().over(Window.partitionBy("shard").orderBy("pod")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("shard"))
    return ready.select("shard", "endpoint", slot.alias("slot"), size.alias("n"))


def choose_read_endpoint(
    requests: DataFrame, order: Sequence[str], bucket: Column, members: DataFrame, max_lag: int | None = None
) -> DataFrame:
    """Endpoint for every read request: replicas in turn, else the ready primary, else NULL.

    Requests are numbered per shard by ``order`` without gathering a shard in one task.
    """
    replicas = eligible_replicas(members, max_lag)
    primaries = members.filter((F.col("role") == "primary") & F.col("ready")).groupBy("shard").agg(
        F.min("endpoint").alias("__primary")
    )
    turn = ordered_scan(requests, ["shard"], order, bucket, sums={"__turn": F.lit(1).cast("long")})
    sizes = replicas.groupBy("shard").agg(F.max("n").alias("__n"))
    slotted = turn.join(sizes, "shard", "left").withColumn(
        "slot", F.when(F.col("__n") > 0, ((F.col("__turn") - 1) % F.col("__n")).cast("int"))
    )
    chosen = slotted.join(replicas.select("shard", "slot", "endpoint"), ["shard", "slot"], "left").join(
        primaries, "shard", "left"
    )
    return chosen.withColumn("endpoint", F.coalesce("endpoint", "__primary")).drop("__turn", "__n", "__primary", "slot")
