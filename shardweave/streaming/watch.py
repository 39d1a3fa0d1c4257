"""Watches over event streams: held conditions, silent members, signal bursts, window averages.

Files of a stream come in any order.  Every micro-batch is put aside until the watermark, the newest time
seen less the allowed lateness, has passed its rows; settled rows then go through the batch operator
together with a carry of a few values per key, so a hot key is cut into buckets as in a batch.  Rows behind
the watermark are not lost: they are kept in a table of late rows beside the result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardweave.operators.coalesce import coalesce_signals
from shardweave.operators.held import sustained, with_held_since
from shardweave.operators.scan import DAY, bucket_of, scan_done, scan_ready, scan_step
from shardweave.sources.scratch import folder_of, fresh_path, last_text, save_text
from shardweave.streaming.run import drain_batches

NONE = int(np.iinfo(np.int64).min)
#: The tables of the end of the data have a number so far beyond the last batch.
END = 1_000_000_000
Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Watched:
    """What a watch found: its rows, the rows that came too late, the carry and the watermark at the end."""

    rows: DataFrame
    late: DataFrame
    carry: DataFrame
    newest: int


def _drain(streams: DataFrame | Sequence[DataFrame], at: str, lateness: int, label: str, step: Step, folder: str | None = None) -> Watched:
    """Run a stream to the end of its data through ``step(settled rows, carry)``.

    Each batch has its own folders and starts from those of the one before, so a batch that is
    delivered again replaces what it left.  The watermark of every batch is kept in a file beside them: with a
    ``folder`` of its own a watch that is called again goes on from the last batch.  Several streams are read
    one after the other, as one that stops and starts again.  At the end of the data the rows still put aside
    are settled too.
    """
    streams = [streams] if isinstance(streams, DataFrame) else list(streams)
    spark, schema = streams[0].sparkSession, streams[0].schema
    base = folder or fresh_path(spark, label)
    text = last_text(spark, f"{base}/marks", ".json")
    # batch number -> (watermark, newest time); tables lie under the number
    marks: dict[int, tuple[int, int]] = {-1: (NONE, NONE)}
    schemas = {"waiting": schema, "late": schema}
    if text is not None:
        kept = json.loads(text)
        marks[kept["number"]] = (kept["mark"], kept["newest"])
        schemas |= {n: StructType.fromJson(s) for n, s in kept["schemas"].items()}

    def read(name: str, number: int) -> DataFrame | None:
        return spark.read.schema(schemas[name]).parquet(f"{base}/{name}/batch={number}") if number in marks and number >= 0 else None

    def save(name: str, number: int, rows: DataFrame) -> None:
        schemas[name] = rows.schema
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    def before(number: int) -> int:
        """The batch to go on from: the one before, unless this one is delivered again or batches without rows lay between."""
        return max(n for n in marks if n < number)

    def settle(fresh: DataFrame, number: int, last: bool) -> None:
        mark, newest = marks[before(number)]
        top = fresh.agg(F.max(at)).first()[0]
        newest = max(newest, NONE if top is None else top)
        reached = newest if last else max(mark, newest - lateness if newest > NONE else NONE)
        # a row without a time can never settle
        save("late", number, fresh.where((F.col(at) <= mark) | F.col(at).isNull()))
        waiting = read("waiting", before(number))
        rows = fresh.where(F.col(at) > mark)
        rows = rows if waiting is None else rows.unionByName(waiting)
        save("waiting", number, rows.where(F.col(at) > reached))
        found, carry = step(rows.where(F.col(at) <= reached), read("carry", before(number)))
        save("rows", number, found)
        save("carry", number, carry)
        marks[number] = (reached, newest)
        if not last:
            kept = {"number": number, "mark": reached, "newest": newest, "schemas": {n: s.jsonValue() for n, s in schemas.items()}}
            save_text(spark, f"{base}/marks/{number:012d}.json", json.dumps(kept))

    def write(batch: DataFrame, number: int) -> None:
        if number <= max(marks):  # done before the driver was lost, and delivered again
            return
        held = batch.persist()
        settle(held, number, False)
        held.unpersist()

    for stream in streams:
        drain_batches(stream, label, write, mode="append", checkpoint=f"{base}/checkpoint")
    # the end of the data is no batch of the stream: its tables lie apart, and a later call goes on without it
    ends = max(marks)
    number = ends + END
    settle(spark.createDataFrame([], schema), number, True)

    def whole(name: str) -> DataFrame:
        path, system = folder_of(spark, f"{base}/{name}")
        numbers = sorted(int(e.getPath().getName().removeprefix("batch=")) for e in system.listStatus(path))
        return spark.read.schema(schemas[name]).parquet(*[f"{base}/{name}/batch={n}" for n in numbers if n <= ends or n == number])

    return Watched(whole("rows"), whole("late"), read("carry", number), marks[number][1])


def watch_held(stream: DataFrame | Sequence[DataFrame], key: str, hold: int, lateness: int, width: int = DAY, folder: str | None = None) -> Watched:
    """Rows (key, at, seq, since, held) for every observation.

    ``stream`` has the key, LONG ``at`` and ``seq``, and booleans ``holds`` and ``may_start``.
    ``since`` is -1 while no clock runs.  The carry is the running clock of a key.
    """

    def step(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = rows.select(key, "at", "seq", "holds", "may_start")
        if carry is not None:
            # a clock that runs on is one more row, at its beginning
            rows = rows.unionByName(carry.select(key, F.col("since").alias("at"), F.lit(NONE).alias("seq"), F.lit(True).alias("holds"), F.lit(True).alias("may_start")))
        scanned = with_held_since(rows, [key], "at", "seq", F.col("holds"), bucket_of("at", width), F.col("may_start"))
        last = scanned.groupBy(key).agg(F.max_by("since", F.struct("at", "seq")).alias("since")).where("since IS NOT NULL")
        own = scanned.where(F.col("seq") != NONE)
        return own.select(
            key, "at", "seq", F.coalesce("since", F.lit(-1).cast("long")).alias("since"), sustained(F.col("at"), F.col("since"), hold).alias("held")
        ), last

    return _drain(stream, "at", lateness, "held", step, folder)


def watch_silence(stream: DataFrame, key: str, limit: int, lateness: int, width: int = DAY) -> Watched:
    """Rows (key, last_at, stale_at) for every heartbeat not followed by another in time.

    ``stream`` has the key and LONG ``at``.  The carry is the last heartbeat of a member; the
    last one of all counts once the newest time of the stream is beyond its limit.
    """

    def step(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        beats = rows.select(key, "at").distinct()
        if carry is not None:
            beats = beats.unionByName(carry)
        scanned = scan_step(scan_ready(beats, [key], bucket_of("at", width)), ["at"], maxes={"last_at": F.col("at")}, exclusive=True)
        gaps = scan_done(scanned).where(F.col("at") - F.col("last_at") > limit)
        found = gaps.select(key, "last_at", (F.col("last_at") + limit).alias("stale_at"))
        return found, beats.groupBy(key).agg(F.max("at").alias("at"))

    seen = _drain(stream, "at", lateness, "silence", step)
    still = seen.carry.where(F.col("at") + limit < seen.newest).select(key, F.col("at").alias("last_at"), (F.col("at") + limit).alias("stale_at"))
    return Watched(seen.rows.unionByName(still), seen.late, seen.carry, seen.newest)


def watch_bursts(stream: DataFrame, key: str, width: int, lateness: int) -> Watched:
    """Rows (key, start, emit_at) for every fixed window opened by a first signal.

    ``stream`` has the key and LONG ``at``.  The carry is the last window of a key.
    """

    def step(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        signals = rows.select(key, "at")
        if carry is not None:
            signals = signals.unionByName(carry.select(key, F.col("start").alias("at")))
        if signals.isEmpty():
            found = signals.select(key, F.col("at").alias("start"), F.col("at").alias("emit_at"))
        else:
            found = coalesce_signals(signals, key, "at", width)
        last = found.groupBy(key).agg(F.max("start").alias("start"))
        if carry is not None:
            known = carry.select(F.col(key).alias("__key"), F.col("start").alias("__start"))
            found = found.join(known, found[key].eqNullSafe(known["__key"]) & (found["start"] == known["__start"]), "left_anti")
        return found, last

    return _drain(stream, "at", lateness, "bursts", step)


def watch_averages(stream: DataFrame, keys: list[str], at: str, value: str, length: int, slide: int) -> DataFrame:
    """(keys…, start, total, n) of every sliding window with a row, open ones included.

    Sums and counts merge in any order, so no row is late: each batch leaves its partial sums.
    """
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "averages")
    latest = F.floor(F.col(at) / slide).cast("long") * slide
    starts = F.explode(F.array(*[latest - i * slide for i in range(length // slide)])).alias("start")
    partial = lambda rows: rows.select(*keys, starts, F.col(value).alias("value")).groupBy(*keys, "start").agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    empty = partial(spark.createDataFrame([], stream.schema))
    empty.write.parquet(f"{out}/batch=-1")
    drain_batches(stream, "averages", write, mode="append")
    rows = spark.read.schema(empty.schema).parquet(out)
    return rows.groupBy(*keys, "start").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
