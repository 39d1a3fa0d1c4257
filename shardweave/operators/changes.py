"""Applying a change log to a snapshot.

Changes have columns ``op`` (I, U, D), the key, an order column and the payload columns
of the snapshot.  An insert or update replaces the row of its key, a delete removes it;
the last change of a key wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Types whose aggregation buffers Spark updates in place, so that it can hash instead of sort.
_FIXED_WIDTH = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType,
)


def last_rows(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The last row of every key by ``order``, combined before the shuffle.

    With one order column and fixed-width fields every field is its own ``max_by``, which
    Spark hashes.  All of them follow the same row, ties included.  Otherwise the row is one
    struct and Spark sorts each task's rows by key.
    """
    fixed = all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in (*order, *fields))
    if len(order) == 1 and fixed:
        return df.groupBy(key).agg(*[F.max_by(f, order[0]).alias(f) for f in fields])
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(key).agg(last.alias("__last")).select(key, "__last.*")


def net_changes(changes: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last change of every key, as an update or a delete.  A hot key is one row per task."""
    flagged = changes.withColumn("__gone", F.col("op") == "D")
    last = last_rows(flagged, key, order, ["__gone", *order, *payload])
    return last.withColumn("op", F.when(F.col("__gone"), "D").otherwise("U")).drop("__gone")


def apply_net_changes(snapshot: DataFrame, net: DataFrame, key: str) -> DataFrame:
    """Snapshot after the net changes; works without a primary key on the snapshot."""
    kept = snapshot.join(net.select(key), key, "left_anti")
    return kept.unionByName(net.filter(F.col("op") != "D").select(*snapshot.columns))


def apply_changes(
    snapshot: DataFrame, changes: DataFrame, key: str, order: Sequence[str], until: Column | None = None
) -> DataFrame:
    """Snapshot after all changes, or after those for which ``until`` holds."""
    wanted = changes if until is None else changes.filter(until)
    payload = [c for c in snapshot.columns if c != key]
    return apply_net_changes(snapshot, net_changes(wanted, key, order, payload), key)


def state_at(snapshot: DataFrame, changes: DataFrame, key: str, order: Sequence[str], commit: str, target: Column) -> DataFrame:
    """Table state at a point in time: the base snapshot and the changes committed up to it."""
    return apply_changes(snapshot, changes, key, order, F.col(commit) <= target)


# --- catch-up -------------------------------------------------------------------------


def pending_tables(states: DataFrame, by: str, state: str, want: Column) -> DataFrame:
    """Tables per target that have not finished their initial load, unregistered ones included."""
    loading = F.count_if(~F.col(state).isin("r", "s"))
    missing = F.greatest(F.max(want) - F.count(F.lit(1)), F.lit(0))
    return states.groupBy(by).agg((loading + missing).cast("long").alias("pending"))


def lag_bytes(produced: DataFrame, applied: DataFrame, by: str) -> DataFrame:
    """Source position minus confirmed position per target; -1 when nothing was confirmed."""
    source = produced.groupBy(by).agg(F.max("lsn").alias("__source"))
    confirmed = applied.groupBy(by).agg(F.max("lsn").alias("__applied"))
    lag = F.coalesce(F.col("__source") - F.col("__applied"), F.lit(-1))
    return source.join(confirmed, by, "left").select(by, lag.alias("lag"))


def catch_up_gate(pending: DataFrame, lag: DataFrame, by: str, max_lag: int = 16 << 20) -> DataFrame:
    """``ready``: initial load complete and lag known and small; ``drained``: lag is 0 as well."""
    both = pending.join(lag, by, "full_outer")
    loaded = F.coalesce(F.col("pending") == 0, F.lit(False))
    known = F.coalesce(F.col("lag"), F.lit(-1))
    return both.select(
        by, "pending", known.alias("lag"),
        (loaded & known.between(0, max_lag)).alias("ready"),
        (loaded & (known == 0)).alias("drained"),
    )
