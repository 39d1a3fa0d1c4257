"""Following a change stream and keeping the latest status of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.operators.changes import apply_changes, net_changes
from shardweave.sources.scratch import fresh_path
from shardweave.streaming.run import drain_batches

BATCH = "batch"


def follow_changes(changes: DataFrame, key: str, order: Sequence[str], payload: Sequence[str], log: str, checkpoint: str | None = None) -> None:
    """Write the net changes of every micro-batch to its own partition of ``log``.

    Only changed keys are written, never the snapshot; a repeated batch replaces its own
    partition, so applying the log gives the same table however often it is retried.  With a
    ``checkpoint`` the next call follows on.
    """

    def write(batch: DataFrame, number: int) -> None:
        net_changes(batch, key, order, payload).write.mode("overwrite").parquet(f"{log}/{BATCH}={number}")

    drain_batches(changes, "follow", write, mode="append", checkpoint=checkpoint)


def caught_up(snapshot: DataFrame, log: str, key: str, order: Sequence[str]) -> DataFrame:
    """The snapshot with all logged changes applied."""
    changes = snapshot.sparkSession.read.option("basePath", log).parquet(log).drop(BATCH)
    return apply_changes(snapshot, changes, key, order)


def latest_status_stream(heartbeats: DataFrame, member: str = "pod", order: Sequence[str] = ("at", "seq")) -> DataFrame:
    """The last heartbeat of every member seen so far, kept as a streaming aggregate."""
    spark, out = heartbeats.sparkSession, fresh_path(heartbeats.sparkSession, "status")
    fields = [c for c in heartbeats.columns if c != member]
    latest = heartbeats.groupBy(member).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    drain_batches(latest, "status", write, mode="update")
    # Every batch holds the members it changed; the newest batch of a member is current.
    rows = spark.read.option("basePath", out).parquet(out)
    current = rows.groupBy(member).agg(F.max_by("last", BATCH).alias("last"))
    return current.select(member, "last.*")
