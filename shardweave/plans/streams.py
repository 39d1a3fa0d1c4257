"""Streaming queries: the event files read as a stream, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators.scan import HOUR, micros
from shardweave.plans import alerting, fleets  # noqa: F401  (their oracles are shared)
from shardweave.plans.fleets import BURST, HEARTBEATS_SQL
from shardweave.plans.registry import ORACLE, event_width, query, table
from shardweave.plans.reshards import CHANGES_SQL, state_sql
from shardweave.sources.changelog import read_change_log
from shardweave.sources.events import stream_table
from shardweave.sources.scratch import fresh_path
from shardweave.streaming.catchup import caught_up, follow_changes, latest_status_stream
from shardweave.streaming.stateful import Bursts, Held, Silent, Watch
from shardweave.streaming.watch import watch_averages, watch_held

SILENCE = 30 * HOUR
#: The watches read the events as a log in order of time, in so many runs that each start from the checkpoint of the one before.
RUNS = 3


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return stream_table(spark, sf_dir, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(spark, sf_dir, *columns):
    """The events in order of time, as one stream for each run: it ends where that run finds the end of the log."""
    events = table(spark, sf_dir, "events")
    first, last = events.select(micros("ts").alias("at")).agg(F.min("at"), F.max("at")).first()
    schema = events.select(*columns, "ts").schema
    for run in range(1, RUNS + 1):
        # a run ends on a full millisecond, the unit of watermarks
        upto = None if run == RUNS or last is None else (first + (last - first) * run // RUNS) // 1000 * 1000
        log = read_change_log(spark, f"{sf_dir}/events.parquet", schema, "ts", upto)
        yield log.withColumn("at", micros(F.col("ts").cast("timestamp"))).drop("ts")


def watched(spark, sf_dir, processor, key, kind, streams):
    watch = Watch(processor, key, fresh_path(spark, "watch"))
    for stream in streams:
        watch.run(stream)
    return watch.rows(spark, kind)


@query("f01_stream_latest_status", f"WITH {HEARTBEATS_SQL} SELECT pod, role, lag, at_us, seq FROM latest")
def f01_stream(spark, sf_dir):
    user, event = F.col("user_id"), F.col("event_id")
    beats = event_stream(spark, sf_dir).select(
        F.concat(F.lit("pod-"), user).alias("pod"),
        F.when((user + event) % 4 == 0, "primary").otherwise("replica").alias("role"),
        (F.floor(F.col("value") * 1000) - 5000).alias("lag"),
        micros("ts").alias("at_us"),
        event.alias("seq"),
    )
    return latest_status_stream(beats, "pod", ("at_us", "seq"))


@query(
    "f02_stream_staleness",
    "WITH b AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events) "
    f"SELECT user_id, us AS last_at, us + {SILENCE} AS stale_at FROM b WHERE following - us > {SILENCE} "
    f"OR following IS NULL AND us + {SILENCE} < (SELECT max(epoch_us(ts)) FROM events)",
)
def f02_stream(spark, sf_dir):
    return watched(spark, sf_dir, Silent(SILENCE), "user_id", "long", replayed(spark, sf_dir, "user_id"))


@query(
    "f13_stream_debounced_failure",
    ORACLE["f13_debounced_failure"].replace("SELECT cluster, seq, failed, since, ", "SELECT cluster, seq, coalesce(since, -1) AS since, "),
)
def f13_stream(spark, sf_dir):
    reports = [
        log.select(
            F.expr("user_id div 25").alias("cluster"), "at", F.col("event_id").alias("seq"),
            F.col("event_type").isin("error", "view", "click").alias("holds"), (F.col("value") > 50).alias("may_start"),
        )
        for log in replayed(spark, sf_dir, "user_id", "event_id", "event_type", "value")
    ]
    held = watched(spark, sf_dir, Held(8 * HOUR), "cluster", "long", reports)
    return held.select("cluster", "seq", "since", F.col("held").alias("promote"))


@query("p05_stream_hold_time", ORACLE["p05_hold_time"])
def p05_stream(spark, sf_dir):
    # a kind may have any share of the rows: this watch cuts hot keys into buckets
    gauges = [
        log.select(F.col("event_type").alias("kind"), "at", F.col("event_id").alias("seq"), (F.col("value") > 20).alias("holds"), F.lit(True).alias("may_start"))
        for log in replayed(spark, sf_dir, "event_id", "event_type", "value")
    ]
    watched = watch_held(gauges, "kind", 2 * HOUR, 0, event_width(spark, sf_dir)).rows
    state = F.when(F.col("since") < 0, "inactive").when(F.col("held"), "firing").otherwise("pending")
    return watched.select("kind", "seq", state.alias("state"))


@query("f19_stream_signal_coalescing", ORACLE["f19_signal_coalescing"])
def f19_stream(spark, sf_dir):
    return watched(spark, sf_dir, Bursts(BURST), "user_id", "long", replayed(spark, sf_dir, "user_id"))


@query("m05_stream_catch_up", f"WITH {CHANGES_SQL}, {state_sql('true')}")
def m05_stream(spark, sf_dir):
    kind, log = F.col("event_type"), fresh_path(spark, "change-log")
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    # three runs from one checkpoint: each reads the positions after the last one of the run before
    for upto in (last // 3, 2 * last // 3, None):
        read = read_change_log(spark, f"{sf_dir}/events.parquet", events.select("event_id", "event_type", "user_id", "value").schema, "event_id", upto)
        changes = read.select(
            F.col("event_id").alias("lsn"),
            F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op"),
            (F.col("user_id") * 100 + F.col("event_id") % 50).alias("id"),
            F.floor("value").cast("long").alias("val"),
        )
        follow_changes(changes, "id", ["lsn"], ["val"], log, f"{log}-checkpoint")
    snapshot = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("val")
    )
    return caught_up(snapshot, log, "id", ["lsn"])


@query(
    "p12_stream_sliding_average",
    "WITH w AS (SELECT event_type AS kind, value, unnest([epoch_us(ts) // 3600000000 * 3600000000 - i * 3600000000 for i in range(4)]) AS start FROM events) "
    "SELECT kind, start, round(sum(value::DECIMAL(18, 2))::DOUBLE / count(*), 6) AS mean FROM w "
    "GROUP BY kind, start",
)
def p12_stream(spark, sf_dir):
    gauges = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("kind"), micros("ts").alias("at"), F.col("value").cast("decimal(18,2)").alias("value")
    )
    sums = watch_averages(gauges, ["kind"], "at", "value", 4 * HOUR, HOUR)
    return sums.select("kind", "start", F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"))
