"""Running a stream to the end of the data that is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shardweave.sources.scratch import fresh_path


def drain_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None, settle: bool = False) -> StreamingQuery:
    """Process everything available, handing every micro-batch and its number to ``write``.

    A batch can be delivered again after a failure, so ``write`` has to replace what an
    earlier delivery of the same number left behind.  With a ``checkpoint`` the next call goes on from there.
    ``settle`` runs batches without rows as well, so that the watermark of the last rows takes effect.
    """
    writer = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{label}-state"))
    )
    if settle:
        query = writer.start()
        query.processAllAvailable()
        query.stop()
    else:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query
