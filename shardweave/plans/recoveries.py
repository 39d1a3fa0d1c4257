"""B queries: backup selection and point-in-time recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import changes as C
from shardweave.operators import recovery as B
from shardweave.operators.scan import DAY, HOUR, micros
from shardweave.plans.registry import event_width, query, table
from shardweave.plans.reshards import CHANGES_SQL, snapshot_and_changes, state_sql
from shardweave.sources import chain as K
from shardweave.sources.scratch import fresh_path

NOW = 1706140800 * 1_000_000  # 2024-01-25 00:00:00 UTC


def jobs(spark, sf_dir):
    """Every event is a backup job of the schedule of its user."""
    user, event = F.col("user_id"), F.col("event_id")
    pick = event % 6
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), user).alias("schedule"),
        F.concat(F.lit("job-"), event).alias("name"),
        F.concat(F.lit("c"), user % 20).alias("cluster"),
        F.when(pick == 3, "Failed").when((pick == 4) & (user % 3 == 0), "Running").otherwise("Succeeded").alias("phase"),
        F.concat(F.lit("b"), event).alias("backup_id"),
        F.when(event % 11 != 0, micros("ts")).alias("ended_at"),
        (user % 4).alias("keep"),
    )


JOBS_SQL = """jobs AS (SELECT 's' || user_id AS schedule, 'job-' || event_id AS name, 'c' || user_id % 20 AS cluster,
  CASE WHEN event_id % 6 = 3 THEN 'Failed' WHEN event_id % 6 = 4 AND user_id % 3 = 0 THEN 'Running' ELSE 'Succeeded' END AS phase,
  'b' || event_id AS backup_id, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) END AS ended_at, user_id % 4 AS keep FROM events)"""


@query(
    "b01_retention",
    f"WITH {JOBS_SQL} SELECT schedule, name, keep FROM (SELECT *, row_number() OVER (PARTITION BY schedule ORDER BY ended_at DESC NULLS LAST, name) AS nth "
    "FROM jobs WHERE phase = 'Succeeded') WHERE keep > 0 AND nth > keep",
)
def b01(spark, sf_dir):
    return B.expired_backups(jobs(spark, sf_dir), F.col("keep"), width=event_width(spark, sf_dir)).select("schedule", "name", "keep")


def schedules(spark, sf_dir):
    """Every customer has a schedule; the last run is known for some."""
    key = F.col("c_custkey")
    created = F.lit(NOW - 20 * DAY) + key % 48 * HOUR
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), key).alias("schedule"),
        created.alias("created_at"),
        F.when(key % 5 != 0, created + key % 400 * HOUR).alias("last_run"),
        (key % 10 < 5).alias("immediate"),
    )


def fires(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("schedule"), micros("ts").alias("fire_at"))


RUNS_SQL = f"""sched AS (SELECT 's' || c_custkey AS schedule, {NOW - 20 * DAY} + c_custkey % 48 * {HOUR} AS created_at,
    CASE WHEN c_custkey % 5 <> 0 THEN {NOW - 20 * DAY} + c_custkey % 48 * {HOUR} + c_custkey % 400 * {HOUR} END AS last_run, c_custkey % 10 < 5 AS immediate FROM customer),
  fires AS (SELECT 's' || user_id AS schedule, epoch_us(ts) AS fire_at FROM events),
  following AS (SELECT s.schedule, min(fire_at) AS fire FROM sched s JOIN fires f ON f.schedule = s.schedule AND fire_at > coalesce(last_run, created_at) GROUP BY 1),
  runs AS (SELECT s.*, CASE WHEN immediate AND last_run IS NULL THEN created_at ELSE fire END AS next_at FROM sched s LEFT JOIN following f ON f.schedule = s.schedule),
  due AS (SELECT *, coalesce(next_at <= {NOW}, false) AS due FROM runs)"""


@query("b02_next_run", f"WITH {RUNS_SQL} SELECT * FROM due")
def b02(spark, sf_dir):
    return B.next_runs(schedules(spark, sf_dir), fires(spark, sf_dir), NOW)


ACTIVE_SQL = "SELECT schedule FROM jobs WHERE phase = 'Running'"


@query("b03_concurrency_block", f"WITH {JOBS_SQL}, {RUNS_SQL} SELECT schedule, next_at FROM due WHERE due AND schedule NOT IN ({ACTIVE_SQL})")
def b03(spark, sf_dir):
    due = B.next_runs(schedules(spark, sf_dir), fires(spark, sf_dir), NOW).filter("due")
    return B.unblocked(due, jobs(spark, sf_dir)).select("schedule", "next_at")


@query(
    "b04_job_name",
    "SELECT o_orderkey, left(repeat('nightly-', 1 + o_custkey % 9) || o_custkey, 63 - 1 - length((epoch_us(o_orderdate) // 1000000)::VARCHAR)) "
    "|| '-' || (epoch_us(o_orderdate) // 1000000) AS name FROM orders",
)
def b04(spark, sf_dir):
    schedule = F.concat(F.repeat(F.lit("nightly-"), (F.col("o_custkey") % 9 + 1).cast("int")), "o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", B.job_name(schedule, micros("o_orderdate")).alias("name"))


@query(
    "b05_base_backup",
    f"WITH {JOBS_SQL}, q AS (SELECT event_id, 's' || user_id AS schedule, epoch_us(ts) - {12 * HOUR} AS target_at, "
    "CASE WHEN event_id % 40 = 0 THEN 'pinned-' || event_id END AS wanted FROM events WHERE event_type = 'error'), "
    "u AS (SELECT * FROM jobs WHERE phase = 'Succeeded' AND ended_at IS NOT NULL) "
    "SELECT q.event_id, q.schedule, target_at, coalesce(wanted, u.backup_id) AS backup_id FROM q ASOF LEFT JOIN u ON u.schedule = q.schedule AND u.ended_at <= q.target_at",
)
def b05(spark, sf_dir):
    event = F.col("event_id")
    requests = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        event,
        F.concat(F.lit("s"), "user_id").alias("schedule"),
        (micros("ts") - F.lit(12 * HOUR)).alias("target_at"),
        F.when(event % 40 == 0, F.concat(F.lit("pinned-"), event)).alias("wanted"),
    )
    return B.base_backups(requests, jobs(spark, sf_dir), width=event_width(spark, sf_dir))


@query("b06_point_in_time", f"WITH {CHANGES_SQL}, {state_sql('commit_ts <= TIMESTAMP ' + chr(39) + '2024-01-15 12:00:00' + chr(39))}")
def b06(spark, sf_dir):
    snapshot, changes = snapshot_and_changes(spark, sf_dir)
    target = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return C.state_at(snapshot, changes, "id", ["lsn"], "commit_ts", target)


SEGMENTS = 64


@query("b06_restore_chain", f"WITH {CHANGES_SQL}, {state_sql('commit_ts <= TIMESTAMP ' + chr(39) + '2024-01-15 12:00:00' + chr(39))}")
def b06_chain(spark, sf_dir):
    """A full copy, two increments and the archived log; the restore takes the first of them and a part of the log."""
    snapshot, changes = snapshot_and_changes(spark, sf_dir)
    target = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    marks = [F.max(F.when(F.col("commit_ts") <= F.lit(t).cast("timestamp_ntz"), F.col("lsn"))) for t in ("2024-01-08", "2024-01-20")]
    before = F.coalesce(F.min("lsn") - 1, F.lit(0))
    start, last, first, second = changes.agg(before, F.coalesce(F.max("lsn"), F.lit(0)), *[F.coalesce(m, before) for m in marks]).first()
    # the latest commit time among the changes up to each position, which need not follow it
    spans = [F.coalesce(F.max(F.when(F.col("lsn") <= p, F.col("commit_ts"))).cast("string"), F.lit("1970-01-01 00:00:00")) for p in (first, second)]
    at = changes.agg(*spans).first()
    chain = fresh_path(spark, "chain")
    K.add_full(chain, snapshot, start, "1970-01-01 00:00:00")
    K.add_increment(chain, changes, "id", "lsn", start, first, at[0])
    K.add_increment(chain, changes, "id", "lsn", first, second, at[1])
    K.archive_log(chain, changes, "lsn", "commit_ts", max(last // SEGMENTS, 1))
    return K.restore(spark, chain, "id", "lsn", "commit_ts", target)


@query("b07_backup_health", f"WITH {JOBS_SQL} SELECT cluster, phase, count(*) AS n_jobs FROM jobs GROUP BY ALL")
def b07(spark, sf_dir):
    return B.backup_health(jobs(spark, sf_dir))
