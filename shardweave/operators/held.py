"""Conditions that must hold for a while before they count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.scan import scan_done, scan_ready, scan_step


def with_held_since(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    condition: Column,
    bucket: Column,
    may_start: Column | None = None,
    out: str = "since",
) -> DataFrame:
    """Append the time since which ``condition`` holds without a break, else NULL.

    The clock starts at the first row of an unbroken run on which ``may_start`` is true
    (by default the first row), and a row on which the condition is false resets it.
    ``at`` is LONG, (at, tie) is unique per key.
    """
    here = F.struct(at, tie)
    holds = F.coalesce(condition, F.lit(False))
    marked = df.withColumns({"__holds": holds, "__begins": holds & (F.lit(True) if may_start is None else may_start)})
    scanned = scan_step(
        scan_ready(marked, keys, bucket),
        [at, tie],
        maxes={"__cleared": F.when(~F.col("__holds"), here), "__began": F.when(F.col("__begins"), here)},
        exclusive=True,
    )
    # A beginning is the first of its run when no other lies between it and the last break.
    first = F.col("__begins") & (F.col("__began").isNull() | (F.col("__began") < F.col("__cleared")))
    first = F.coalesce(first, F.lit(False))
    scanned = scan_done(scan_step(scanned, [at, tie], maxes={"__start": F.when(first, here)}))
    alive = F.col("__holds") & (F.col("__cleared").isNull() | (F.col("__start") > F.col("__cleared")))
    return scanned.withColumn(out, F.when(alive, F.col("__start")[at])).select(*df.columns, out)


def sustained(at: Column, since: Column, hold: int) -> Column:
    """The condition has held for at least ``hold`` units of time; at once when ``hold`` is 0."""
    return F.coalesce(at - since >= F.lit(hold), F.lit(False))


def alert_state(at: Column, since: Column, hold: int) -> Column:
    return F.when(since.isNull(), "inactive").when(sustained(at, since, hold), "firing").otherwise("pending")
