"""Backup schedules, retention and recovery points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.scan import DAY, MICROS, as_of_join, bucket_of, ordered_scan, split_hot

ACTIVE_PHASES = ("", "Pending", "Running")
MAX_NAME = 63
_NEVER = 1 << 62


def expired_backups(
    jobs: DataFrame, keep: Column, by: tuple[str, ...] = ("schedule",), width: int = DAY, hot_rows: int = 1_000_000
) -> DataFrame:
    """Succeeded jobs beyond the newest ``keep`` of their schedule; 0 keeps all.

    A missing end time sorts oldest.  Jobs are counted newest first by an ordered scan that
    cuts schedules of more than ``hot_rows`` jobs into buckets of ``width``.
    """
    done = jobs.filter("phase = 'Succeeded'").withColumn("__age", F.coalesce(-F.col("ended_at"), F.lit(_NEVER)))
    bucket = split_hot(done, by, bucket_of("__age", width), hot_rows)
    counted = ordered_scan(done, by, ["__age", "name"], bucket, sums={"__nth": F.lit(1).cast("long")})
    return counted.filter((keep > 0) & (F.col("__nth") > keep)).drop("__age", "__nth")


def next_runs(schedules: DataFrame, fires: DataFrame, now: int) -> DataFrame:
    """Append the next fire time of every schedule and whether it is due.

    ``schedules``: schedule, created_at, last_run, immediate.  A schedule that never ran and
    wants an immediate run is due at its creation.
    """
    anchor = F.coalesce("last_run", "created_at")
    anchored = schedules.withColumn("__anchor", anchor)
    later = fires.join(anchored.select("schedule", "__anchor"), "schedule").filter(F.col("fire_at") > F.col("__anchor"))
    following = later.groupBy("schedule").agg(F.min("fire_at").alias("__fire"))
    at_once = F.col("immediate") & F.col("last_run").isNull()
    next_at = F.when(at_once, F.col("created_at")).otherwise(F.col("__fire"))
    joined = anchored.join(following, "schedule", "left").withColumn("next_at", next_at)
    return joined.withColumn("due", F.coalesce(F.col("next_at") <= F.lit(now), F.lit(False))).drop("__anchor", "__fire")


def unblocked(due: DataFrame, jobs: DataFrame) -> DataFrame:
    """Schedules without a job that is still waiting or running."""
    active = jobs.filter(F.coalesce("phase", F.lit("")).isin(*ACTIVE_PHASES)).select("schedule").distinct()
    return due.join(active, "schedule", "left_anti")


def job_name(schedule: Column, fire_at: Column) -> Column:
    """``<schedule>-<unix seconds>``, the schedule cut so that the name fits."""
    seconds = F.floor(fire_at / F.lit(MICROS)).cast("long").cast("string")
    room = F.lit(MAX_NAME) - F.length(seconds) - 1
    return F.concat(F.substr(schedule, F.lit(1), room), F.lit("-"), seconds)


def base_backups(requests: DataFrame, jobs: DataFrame, key: str = "schedule", width: int = DAY) -> DataFrame:
    """The newest usable backup at or before the target time of every restore request.

    An explicit ``wanted`` backup id takes precedence.
    """
    usable = jobs.filter(F.col("ended_at").isNotNull() & (F.col("phase") == "Succeeded"))
    found = as_of_join(requests, usable, [key], "target_at", "ended_at", "name", ["backup_id"], width)
    return found.withColumn("backup_id", F.coalesce("wanted", "backup_id")).drop("wanted")


def backup_health(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("cluster", "phase").agg(F.count(F.lit(1)).alias("n_jobs"))
