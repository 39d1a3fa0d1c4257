"""Watches that keep their state in the stream: ordered by event time, emitted as the watermark passes.

Every key buffers its rows until the watermark has passed them, then goes through them in order of time and keeps
a value or two.  Timers wake a key when its next row is due, or when its silence has lasted too long, so rows come
out as soon as they are certain and not at the end of the data.  Buffers, values and timers are in the state store
(RocksDB, so they need not fit into memory); a query that starts again from its checkpoint goes on as if it had
not stopped.

A key is one group of a task: use these watches where the rows of a key within the lateness are bounded, as the
reports of a member or a cluster are, and those of ``streaming.watch`` where one key may hold a large share of all
rows.  Rows behind the watermark are left out and counted by the query's progress; ``streaming.watch`` keeps them.
Rows without a time are never due and are left out as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from shardweave.streaming.run import drain_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "due"


def due_ms(at: int) -> int:
    """The millisecond, the unit of timers and watermarks, by which a time in microseconds has passed."""
    return -(-at // 1000)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``settled`` in order of (at, seq), once the watermark has passed them."""

    #: Columns that are buffered beside ``at`` and ``seq``; columns of the carry; columns of the result beside the key.
    fields: tuple[str, ...] = ()
    field_types = "at long, seq long"
    carry_types = "since long"
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.field_types)
        self.carry = handle.getValueState("carry", self.carry_types)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[["at", "seq", *self.fields]]
            self.waiting.appendList([tuple(r) for r in part.astype(object).itertuples(index=False)])
            least = int(part["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(due_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(tuple(r) for r in waiting if due_ms(r[0]) <= mark)
        if ready:
            left = [tuple(r) for r in waiting if due_ms(r[0]) > mark]
            self.waiting.put(left) if left else self.waiting.clear()
            if left:
                self.handle.registerTimer(due_ms(min(r[0] for r in left)))
        found = list(self.settled(ready, mark))
        if found:
            table = pd.DataFrame(found, columns=list(self.out))
            table.insert(0, "key", [key[0]] * len(found))
            yield table

    def settled(self, rows: list[tuple], mark: int) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Held(InOrder):
    """Since when a condition holds without a break; the carry is the running clock."""

    fields = ("holds", "may_start")
    field_types = "at long, seq long, holds boolean, may_start boolean"
    out = ("at", "seq", "since", "held")
    out_types = "at long, seq long, since long, held boolean"

    def __init__(self, hold: int):
        self.hold = hold

    def settled(self, rows, mark):
        since = self.carry.get()[0] if self.carry.exists() else None
        for at, seq, holds, may_start in rows:
            if not holds:
                since = None
            elif since is None and may_start:
                since = at
            yield at, seq, -1 if since is None else since, since is not None and at - since >= self.hold
        if rows:
            self.carry.clear() if since is None else self.carry.update((since,))


class Silent(InOrder):
    """Heartbeats not followed by another in time, told as soon as the limit has passed.

    The carry is the last heartbeat and whether its silence has been told.
    """

    carry_types = "last long, told boolean"
    out = ("last_at", "stale_at")
    out_types = "last_at long, stale_at long"

    def __init__(self, limit: int):
        self.limit = limit

    def settled(self, rows, mark):
        last, told = self.carry.get() if self.carry.exists() else (None, False)
        for at, _ in rows:
            if last is not None and at - last > self.limit and not told:
                yield last, last + self.limit
            if at != last:
                last, told = at, False
        if last is not None and not told and last + self.limit < mark * 1000:
            yield last, last + self.limit
            told = True
        if last is not None:
            self.carry.update((last, told))
            if not told:
                # the limit has passed once the watermark is beyond it
                self.handle.registerTimer((last + self.limit) // 1000 + 1)


class Bursts(InOrder):
    """Fixed windows opened by a first signal; the carry is the end of the last one."""

    carry_types = "until long"
    out = ("start", "emit_at")
    out_types = "start long, emit_at long"

    def __init__(self, width: int):
        self.width = width

    def settled(self, rows, mark):
        until = self.carry.get()[0] if self.carry.exists() else None
        for at, _ in rows:
            if until is None or at >= until:
                until = at + self.width
                yield at, until
        if until is not None:
            self.carry.update((until,))


@dataclass(frozen=True)
class Watch:
    """A watch and the folder that holds its results and its checkpoint."""

    processor: InOrder
    key: str
    folder: str
    lateness: str = "0 seconds"

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Process what the stream has now, going on from the folder's checkpoint.

        ``stream`` has the key, LONG ``at`` in microseconds, and the processor's columns; ``seq`` orders rows of
        the same time and is 0 where it is missing.
        """
        spark = stream.sparkSession
        kind = stream.schema[self.key].dataType.simpleString()
        seq: Column = F.col("seq") if "seq" in stream.columns else F.lit(0).cast("long")
        rows = stream.select(F.col(self.key).alias("key"), "at", seq.alias("seq"), *self.processor.fields)
        # the event time is the millisecond by which a row is due, as timers are
        timed = rows.withColumn(DUE, F.timestamp_millis(F.expr("at div 1000 + if(at % 1000 > 0, 1, 0)"))).withWatermark(DUE, self.lateness)
        found = timed.where("at IS NOT NULL").groupBy("key").transformWithStateInPandas(
            self.processor, f"key {kind}, {self.processor.out_types}", "append", "eventTime"
        )
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            return drain_batches(found, "watch", self._write, mode="append", checkpoint=f"{self.folder}/checkpoint", settle=True)
        finally:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)

    def _write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")

    def rows(self, spark, kind: str) -> DataFrame:
        """What has been found so far; ``kind`` is the type of the key."""
        schema = StructType.fromDDL(f"key {kind}, {self.processor.out_types}")
        return spark.read.schema(schema).parquet(f"{self.folder}/rows").select(F.col("key").alias(self.key), *schema.names[1:])
