"""Backup chains: full copies, increments and log segments, of which a restore reads only what its target needs.

A chain is a folder.  ``backups`` holds one small file for every full copy and increment: the position of the change
log up to which it stands, and the latest commit time among the changes it holds (with those of its predecessors).
``log`` holds the archived changes by segment of positions and ``log-index`` the positions and commit times of each
segment.  A restore takes the newest full copy whose changes were all committed by the target, the increments behind
it while that holds, and of the log only segments behind their position that begin by the target.

A backup counts once its entry is written, so a run that is killed leaves nothing that a restore would read.  Pushing
a piece of the log again does no harm: the last change of a key wins.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.operators.changes import apply_changes, net_changes
from shardweave.sources.scratch import save_text

SEGMENT = "__segment"
_ENTRY = "kind string, since long, position long, at timestamp, path string"


class BrokenChain(RuntimeError):
    """The chain does not lead to the target."""


@dataclass(frozen=True)
class Backup:
    kind: str
    #: Position of the backup this one builds on; None for a full copy.
    since: int | None
    #: All changes up to this position are in it, and the latest commit time among them.
    position: int
    at: str
    path: str


def _enter(spark: SparkSession, chain: str, backup: Backup) -> Backup:
    save_text(spark, f"{chain}/backups/{backup.position:020d}-{backup.kind}.json", json.dumps(asdict(backup)))
    return backup


def add_full(chain: str, rows: DataFrame, position: int, at: str) -> Backup:
    """A full copy of the table as it stands after ``position``; ``at`` is its latest commit time."""
    path = f"{chain}/full-{position}"
    rows.write.mode("overwrite").parquet(path)
    return _enter(rows.sparkSession, chain, Backup("full", None, position, at, path))


def add_increment(chain: str, changes: DataFrame, key: str, order: str, since: int, position: int, at: str) -> Backup:
    """The last change of every key with ``since < order <= position``, deletes included."""
    path = f"{chain}/increment-{since}-{position}"
    payload = [c for c in changes.columns if c not in (key, order, "op")]
    span = changes.filter((F.col(order) > since) & (F.col(order) <= position))
    net_changes(span, key, [order], payload).write.mode("overwrite").parquet(path)
    return _enter(changes.sparkSession, chain, Backup("increment", since, position, at, path))


def archive_log(chain: str, changes: DataFrame, order: str, commit: str, width: int) -> None:
    """Append changes to the log by segments of ``width`` positions, and what the segments span to the index."""
    log = changes.withColumn(SEGMENT, F.floor(F.col(order) / F.lit(width)).cast("long"))
    log.repartition(SEGMENT).write.mode("append").partitionBy(SEGMENT).parquet(f"{chain}/log")
    spans = log.groupBy(SEGMENT).agg(
        F.min(commit).alias("first_at"), F.max(commit).alias("last_at"), F.min(order).alias("first_position"), F.max(order).alias("last_position")
    )
    spans.coalesce(1).write.mode("append").parquet(f"{chain}/log-index")


def backups_for(spark: SparkSession, chain: str, target: Column) -> list[Backup]:
    """The full copy and the increments behind it that a restore to ``target`` starts from."""
    entries = spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(f"{chain}/backups")
    usable = entries.filter(F.col("at") <= target.cast("timestamp")).withColumn("at", F.col("at").cast("string"))
    found = sorted((Backup(**r.asDict()) for r in usable.collect()), key=lambda b: b.position)  # one row a backup
    fulls = [b for b in found if b.kind == "full"]
    if not fulls:
        raise BrokenChain("no full copy was finished by the target")
    steps = [fulls[-1]]
    while following := [b for b in found if b.kind == "increment" and b.since == steps[-1].position]:
        steps.append(following[-1])
    return steps


def needed_log(spark: SparkSession, chain: str, position: int, order: str, commit: str, target: Column) -> DataFrame | None:
    """Archived changes after ``position`` committed by ``target``; segments outside are pruned.  None: no segment is needed."""
    index = spark.read.parquet(f"{chain}/log-index").filter((F.col("last_position") > position) & (F.col("first_at") <= target))
    lo, hi = index.agg(F.min(SEGMENT), F.max(SEGMENT)).first()
    if lo is None:
        return None
    log = spark.read.parquet(f"{chain}/log").filter(F.col(SEGMENT).between(lo, hi))
    return log.filter((F.col(order) > position) & (F.col(commit) <= target)).drop(SEGMENT)


def restore(spark: SparkSession, chain: str, key: str, order: str, commit: str, target: Column) -> DataFrame:
    """The table as of ``target``: every change committed by then and none after it."""
    full, *increments = backups_for(spark, chain, target)
    position = increments[-1].position if increments else full.position
    base = spark.read.parquet(full.path)
    columns = ["op", key, order, *[c for c in base.columns if c != key]]
    parts = [spark.read.parquet(b.path).select(*columns) for b in increments]
    log = needed_log(spark, chain, position, order, commit, target)
    if log is not None:
        parts.append(log.select(*columns))
    return apply_changes(base, reduce(DataFrame.unionByName, parts), key, [order]) if parts else base
