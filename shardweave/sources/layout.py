"""Sharded tables on disk: a Parquet dataset with one partition per shard."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardweave.operators.placement import SHARD, find_column, resolve_key
from shardweave.sources.scratch import folder_of, fresh_path
from shardweave.sources.topology import Topology, read_topology

#: Shards that are tried at the same time.
PARALLEL_SHARDS = 8
# Fixed value: names that may become part of a path.
NAME_PATTERN = r"[a-z_][a-z0-9_]*"


def check_name(name: str) -> str:
    """Only plain lower-case names may become part of a path."""
    if not re.fullmatch(NAME_PATTERN, name):
        raise ValueError(f"table name {name!r} does not match {NAME_PATTERN}")
    return name


# --- writing --------------------------------------------------------------------------


def write_sharded(placed: DataFrame, path: str, whole: bool = False) -> None:
    """Replace the shards present in ``placed``; other shards of the dataset stay as they are.

    ``whole`` is a full load: shards without rows in ``placed`` become empty.

    Running it again with the same rows gives the same dataset.  The rebalance hint lets
    adaptive execution merge small shards into few files and split a large shard over
    several tasks, so one shard never has to fit one writer.
    """
    (
        placed.hint("rebalance", SHARD)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(SHARD)
        .parquet(path)
    )


def drop_shards(spark: SparkSession, path: str, shards: list[str]) -> None:
    """Remove shards from a dataset; shards that are not there are no error."""
    for shard in shards:
        found, system = folder_of(spark, f"{path}/{SHARD}={shard}")
        system.delete(found, True)


def switch_topology(spark: SparkSession, path: str, topology: Topology) -> None:
    """Make ``topology`` the one that readers of the dataset take.  Every switch is a new version."""
    version = max(_versions(spark, path), default=-1) + 1
    topology.frame(spark).write.parquet(f"{path}.topology/version={version}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    found, system = folder_of(spark, f"{path}.topology")
    if not system.exists(found):
        return []
    folders = [e.getPath() for e in system.listStatus(found)]
    # a version counts once its job has committed
    done = [f for f in folders if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return [int(f.getName().removeprefix("version=")) for f in done]


def current_topology(spark: SparkSession, path: str, first: Topology) -> Topology:
    """The topology last switched to; ``first`` if the dataset was never moved."""
    versions = _versions(spark, path)
    if not versions:
        return first
    return read_topology(spark.read.parquet(f"{path}.topology/version={max(versions)}"), first.cluster, first.keyspace)


def create_target(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """An empty dataset with the columns of the source."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> None:
    """A table bucketed by its shard key, so joins on that key need no exchange.

    A bucket is read by one task: use it where no key holds more rows than a task can take.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).option("path", path).saveAsTable(check_name(name))


# --- reading --------------------------------------------------------------------------


def read_sharded(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All shards, each row with its shard in ``__shard``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn(SHARD, F.col(SHARD).cast("string"))


def read_placed(spark: SparkSession, path: str, first: Topology) -> DataFrame:
    """All rows once: the shards of the current topology, whether or not a move is under way.

    Shards that a move has brought in and not folded into the dataset yet are their base files with the
    changes since, merged here.
    """
    from shardweave.sources.deltas import moved_tables

    shards = current_topology(spark, path, first).shards
    rows, apart = read_sharded(spark, path), moved_tables(spark, path)
    beside = {s for _, commit in apart for s in commit.shards}
    placed = rows.filter(F.col(SHARD).isin([s for s in shards if s not in beside]))
    for moved, commit in apart:
        if set(commit.shards) & set(shards):
            placed = placed.unionByName(moved.read().filter(F.col(SHARD).isin(shards)).select(*rows.columns))
    return placed


def read_shard(spark: SparkSession, path: str, shard: str) -> DataFrame:
    return read_sharded(spark, path).filter(F.col(SHARD) == shard)


def read_jdbc_shard(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """One shard's table in a live database, read in parallel by ranges of ``column``."""
    return spark.read.jdbc(
        url, check_name(name), column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def read_best_effort(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the shards that can be read, failed shards with their error).

    Every shard is read once, a few at a time, into a table of its own in the shared folder, because
    only at its end is it known that it did not fail.  The rows are those of the tables that were
    finished, so a shard that breaks later changes nothing.  A shard whose columns differ from the
    first good one's has failed too.  All failed is an error.
    """
    kept = fresh_path(spark, "best-effort")

    def attempt(shard: str) -> tuple[DataFrame | None, str | None]:
        try:
            rows = spark.read.parquet(paths[shard])
            own = f"{kept}/{list(paths).index(shard)}"
            rows.write.parquet(own)
            rows = spark.read.schema(rows.schema).parquet(own)
        except AnalysisException as error:
            return None, error.getCondition() or "UNREADABLE"
        except PySparkException as error:
            return None, error.getCondition() or "FAILED_READ"
        except Py4JJavaError:
            return None, "FAILED_READ"
        return rows, None

    with ThreadPoolExecutor(PARALLEL_SHARDS) as pool:
        tried = dict(zip(paths, pool.map(attempt, paths), strict=True))
    rows, failed = None, []
    for shard, (found, error) in tried.items():
        if found is not None and rows is not None and dict(found.dtypes) != {k: v for k, v in rows.dtypes if k != SHARD}:
            error = "SCHEMA_MISMATCH"
        if error is not None:
            failed.append((shard, error))
            continue
        named = found.withColumn(SHARD, F.lit(shard))
        rows = named if rows is None else rows.unionByName(named)
    if rows is None:
        raise RuntimeError(f"no shard could be read: {failed}")
    return rows, spark.createDataFrame(failed, "shard STRING, error STRING")


# --- pruned reads ---------------------------------------------------------------------


def point_read(sharded: DataFrame, topology: Topology, keys: list[object]) -> DataFrame:
    """Rows with one of the given shard keys; only the shards of these keys are scanned."""
    column = find_column(sharded, topology.column)
    shards = sorted({resolve_key(topology, k) for k in keys})
    wanted = F.col(column).isin([k for k in keys if k is not None])
    if any(k is None for k in keys):
        wanted = wanted | F.col(column).isNull()
    return sharded.filter(F.col(SHARD).isin(shards) & wanted)


def key_range_read(sharded: DataFrame, topology: Topology, lo: str, hi: str) -> DataFrame:
    """Rows with ``lo <= key <= hi`` of a range-placed table; only overlapping shards are scanned."""
    if topology.vindex_type != "range":
        raise ValueError("only range placement keeps key ranges together")
    column = find_column(sharded, topology.column)
    shards = sorted({r.shard for r in topology.ranges if r.lo <= hi and lo <= r.hi})
    return sharded.filter(F.col(SHARD).isin(shards) & F.col(column).between(lo, hi))


# --- discovery and constraints --------------------------------------------------------


def folder_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the Parquet tables in a folder of any file system that Spark reads, sorted."""
    path, system = folder_of(spark, folder)
    names = sorted(e.getPath().getName() for e in system.listStatus(path))
    found = [(n.removesuffix(".parquet"),) for n in names if n.endswith(".parquet")]
    return spark.createDataFrame(found, "name STRING")


def exclude_tables(tables: DataFrame, excluded: list[str]) -> DataFrame:
    """Tables whose name is not excluded, without regard to case."""
    spark = tables.sparkSession
    out = spark.createDataFrame([(n.lower(),) for n in excluded], "__low STRING")
    return tables.join(out, F.lower("name") == F.col("__low"), "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break a uniqueness constraint, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows that break a check constraint; a NULL result passes, as in SQL."""
    return df.filter(~F.coalesce(check, F.lit(True)))


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row on any shard."""
    keyed = child.filter(F.col(child_key).isNotNull())
    return keyed.join(parent.select(F.col(parent_key).alias("__parent")).distinct(), F.col(child_key) == F.col("__parent"), "left_anti")


