"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from shardweave.operators.scan import bucket_of, even_width, micros

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.  Times are compared as UTC everywhere.

    The schema is read from the files once, not by a job in front of every query.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan with at least one partition per core, for work that is heavy per row.

    Tables of many files have more splits than cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_widths: dict[tuple[str, str], int] = {}


def event_width(spark: SparkSession, sf_dir: str) -> int:
    """Bucket width for times of event-shaped rows, sized once from the events table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _widths:
        _widths[key] = even_width(table(spark, sf_dir, "events").select(micros("ts").alias("at")), "at")
    return _widths[key]


def event_bucket(spark: SparkSession, sf_dir: str, at: str) -> Column:
    return bucket_of(at, event_width(spark, sf_dir))
