"""Event-shaped sources: heartbeats, change events and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardweave.operators.scan import micros

HEARTBEAT_SCHEMA = (
    "role STRING, promoted BOOLEAN, ready BOOLEAN, endpoint STRING, lagBytes BIGINT, sizeBytes BIGINT, "
    "reason STRING, message STRING, lastUpdate TIMESTAMP"
)


def parse_heartbeats(df: DataFrame, text: str) -> DataFrame:
    """Replace the JSON column by struct ``status``; absent or broken JSON is no status (NULL)."""
    parsed = F.from_json(F.col(text), HEARTBEAT_SCHEMA + ", __broken STRING", {"columnNameOfCorruptRecord": "__broken"})
    usable = F.col("__parsed").isNotNull() & F.col("__parsed.__broken").isNull()
    return (
        df.withColumn("__parsed", parsed)
        .withColumn("status", F.when(usable, F.col("__parsed").dropFields("__broken")))
        .drop("__parsed", text)
    )


def events_as_changes(events: DataFrame) -> DataFrame:
    """Events as a change log: signup inserts the user, error deletes it, others update it.

    Views belong to another table, ``view``, so that a publication has something to leave out.
    """
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("lsn"),
        F.col("ts").alias("commit_ts"),
        F.when(kind == "view", "view").otherwise("user").alias("tbl"),
        F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.col("value"),
    )


def changes_of(changes: DataFrame, tables: list[str]) -> DataFrame:
    """Changes of the published tables; an empty list publishes all."""
    return changes.filter(F.col("tbl").isin(tables)) if tables else changes


def events_as_samples(events: DataFrame, name: str = "gauge") -> DataFrame:
    """Events as metric samples (id, at, name, labels, value)."""
    return events.select(
        F.col("event_id").alias("id"),
        micros("ts").alias("at"),
        F.lit(name).alias("name"),
        F.create_map(
            F.lit("kind"), F.col("event_type"), F.lit("zone"), (F.col("user_id") % 3).cast("string")
        ).alias("labels"),
        F.col("value"),
    )


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files that arrive in ``folder`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
