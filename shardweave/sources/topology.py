"""Topology: which key ranges of a keyspace live on which shard."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.functions.hashing import MASK32

VINDEX_TYPES = ("hash", "range", "consistent-hash", "lookup")
MAX_RANGES = 1024  # upper bound of ranges in one keyspace
DEFAULT_VIRTUAL_NODES = 128

TOPOLOGY_SCHEMA = (
    "cluster STRING, keyspace STRING, pos INT, lo STRING, hi STRING, shard STRING, "
    "vindex_type STRING, vindex_column STRING, vindex_function STRING, virtual_nodes INT, "
    "reference_tables ARRAY<STRING>, write_blocked BOOLEAN"
)


class TopologyError(ValueError):
    """The topology cannot be used as given."""


def parse_bound(text: str) -> int:
    """Hash bound from ``0x…`` hexadecimal or plain decimal text."""
    if re.fullmatch(r"0x[0-9a-fA-F]{1,8}", text):
        return int(text, 16)
    if re.fullmatch(r"0|[1-9][0-9]*", text) and int(text) <= MASK32:
        return int(text)
    raise TopologyError(f"hash bound {text!r} is neither 0x hexadecimal nor decimal below 2**32")


def bound_text(value: Column) -> Column:
    """Fixed-width text of a hash bound, such as ``0x0000ffff``."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 8, "0"))


def bound_value(text: Column) -> Column:
    """LONG of a bound column written as ``0x…`` hexadecimal or plain decimal; else NULL."""
    hexa = F.conv(F.substring(text, 3, 8), 16, 10).cast("long")
    plain = F.when(F.length(text) <= 10, text).cast("long")
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,8}$"), hexa).when(
        text.rlike("^(0|[1-9][0-9]{0,9})$") & (plain <= MASK32), plain
    )


@dataclass(frozen=True)
class Range:
    lo: str
    hi: str
    shard: str


@dataclass(frozen=True)
class Topology:
    """Placement rule of one keyspace.  Ranges are closed and searched in list order."""

    column: str
    ranges: tuple[Range, ...]
    cluster: str = "main"
    keyspace: str = "ks"
    vindex_type: str = "hash"
    function: str = "murmur3"
    virtual_nodes: int = 0
    reference_tables: tuple[str, ...] = ()
    write_blocked: bool = False

    def __post_init__(self) -> None:
        if self.vindex_type not in VINDEX_TYPES:
            raise TopologyError(f"unknown vindex type {self.vindex_type!r}")
        if not 1 <= len(self.ranges) <= MAX_RANGES:
            raise TopologyError(f"a keyspace has 1 to {MAX_RANGES} ranges, not {len(self.ranges)}")

    @property
    def shards(self) -> list[str]:
        """Distinct non-empty shards in order of first appearance."""
        return list(dict.fromkeys(r.shard for r in self.ranges if r.shard))

    @property
    def vnodes(self) -> int:
        return self.virtual_nodes or DEFAULT_VIRTUAL_NODES

    def hash_intervals(self) -> list[tuple[int, int, str]]:
        return [(parse_bound(r.lo), parse_bound(r.hi), r.shard) for r in self.ranges]

    def with_ranges(self, ranges: list[Range]) -> Topology:
        return replace(self, ranges=tuple(ranges))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                self.cluster, self.keyspace, i, r.lo, r.hi, r.shard, self.vindex_type, self.column,
                self.function, self.virtual_nodes, list(self.reference_tables), self.write_blocked,
            )
            for i, r in enumerate(self.ranges)
        ]
        return spark.createDataFrame(rows, TOPOLOGY_SCHEMA)


def equal_hash_topology(column: str, shards: int, **options) -> Topology:
    """``shards`` equal hash ranges named ``shard-0``, ``shard-1`` and so on."""
    edges = [(MASK32 + 1) * i // shards for i in range(shards + 1)]
    ranges = tuple(Range(f"0x{edges[i]:08x}", f"0x{edges[i + 1] - 1:08x}", f"shard-{i}") for i in range(shards))
    return Topology(column, ranges, **options)


def parse_range_list(df: DataFrame, text: str) -> DataFrame:
    """Explode ``shard:lo:hi,shard:lo:hi`` texts into rows (pos, shard, lo, hi)."""
    entries = df.select("*", F.posexplode(F.split(F.col(text), ",")).alias("pos", "__entry"))
    fields = F.split(F.trim(F.col("__entry")), ":")
    checked = F.when(F.size(fields) == 3, fields).otherwise(
        F.raise_error(F.concat(F.lit("range entry must be shard:lo:hi, got "), F.col("__entry")))
    )
    return (
        entries.withColumn("__fields", checked)
        .withColumn("shard", F.col("__fields")[0])
        .withColumn("lo", F.col("__fields")[1])
        .withColumn("hi", F.col("__fields")[2])
        .drop("__entry", "__fields")
    )


def read_topology(frame: DataFrame, cluster: str, keyspace: str) -> Topology:
    """The topology of one keyspace out of a table of topologies; absent is an error."""
    wanted = (F.col("cluster") == cluster) & (F.col("keyspace") == keyspace)
    # At most MAX_RANGES rows are valid; one more is enough to notice a broken table.
    rows = frame.filter(wanted).orderBy("pos").limit(MAX_RANGES + 1).collect()
    if not rows:
        raise TopologyError(f"no topology for {cluster}/{keyspace}")
    head = rows[0]
    return Topology(
        column=head.vindex_column,
        ranges=tuple(Range(r.lo, r.hi, r.shard) for r in rows),
        cluster=cluster,
        keyspace=keyspace,
        vindex_type=head.vindex_type,
        function=head.vindex_function,
        virtual_nodes=head.virtual_nodes or 0,
        reference_tables=tuple(head.reference_tables or ()),
        write_blocked=bool(head.write_blocked),
    )
