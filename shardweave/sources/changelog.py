"""A change log as a stream whose offsets are positions in the log.

``spark.readStream.format("changelog").schema(…).options(path=…, position=…)`` reads Parquet files in order of a
position column, an integer or a time (then in microseconds).  An offset is the last position that was read, so a
query that starts again from its checkpoint reads exactly what comes after it, and a batch that is planned again
reads the same rows.  A batch is read in ranges of positions, each one task that reads only the row groups of its
range.  ``upto`` ends the log at a position; ``ranges`` is the number of tasks of a batch; rows without a position
are not in the log.  The path has to be one that Arrow reads: a folder that all executors share, hdfs:// or s3://.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGES = 8


@dataclass
class Span(InputPartition):
    """Positions above ``low`` up to ``high``."""

    low: int
    high: int


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
        return ds.dataset(path, filesystem=system, format="parquet")
    return ds.dataset(path, format="parquet")


def _as_position(value) -> int:
    """An integer as it is, a time in microseconds since 1970 (UTC)."""
    import datetime

    if isinstance(value, datetime.datetime):
        zero = datetime.datetime(1970, 1, 1, tzinfo=value.tzinfo)
        return (value - zero) // datetime.timedelta(microseconds=1)
    return int(value)


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.position = schema, options["path"], options["position"]
        self.upto = int(options["upto"]) if options.get("upto") is not None else None
        self.ranges = int(options.get("ranges", RANGES))

    def _ends(self) -> tuple[int, int] | None:
        """Least and greatest position, from the files' statistics where they have them."""
        import pyarrow.compute as pc

        found = []
        for fragment in _dataset(self.path).get_fragments():
            for group in fragment.row_groups:
                statistics = (group.statistics or {}).get(self.position)
                if statistics is not None:
                    found += [statistics["min"], statistics["max"]]
                    continue
                column = fragment.subset(row_group_ids=[group.id]).to_table(columns=[self.position]).column(0)
                ends = pc.min_max(column).as_py()
                found += [v for v in ends.values() if v is not None]
        return (min(map(_as_position, found)), max(map(_as_position, found))) if found else None

    def initialOffset(self) -> dict:
        ends = self._ends()
        return {"position": ends[0] - 1 if ends else 0}

    def latestOffset(self) -> dict:
        ends = self._ends()
        if ends is None:
            return {"position": 0}
        last = ends[1] if self.upto is None else min(ends[1], self.upto)
        return {"position": max(last, ends[0] - 1)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = start["position"], end["position"]
        n = max(1, min(self.ranges, high - low))
        cuts = [low + (high - low) * k // n for k in range(n + 1)]
        return [Span(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        data = _dataset(self.path)
        kind = data.schema.field(self.position).type
        bound = lambda v: pa.scalar(v, pa.int64()).cast(pa.timestamp("us")).cast(kind, safe=False) if pa.types.is_timestamp(kind) else pa.scalar(v, kind)
        # a time finer than microseconds belongs to the microsecond it lies in
        inside = (ds.field(self.position) >= bound(partition.low + 1)) & (ds.field(self.position) < bound(partition.high + 1))
        target = to_arrow_schema(self.schema)
        for batch in data.scanner(columns=self.schema.names, filter=inside).to_batches():
            if batch.num_rows:
                columns = [pc.cast(batch.column(f.name), f.type, safe=False) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the offsets are in the query's checkpoint."""


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def streamReader(self, schema: T.StructType) -> ChangeLogReader:
        return ChangeLogReader(schema, dict(self.options))


def read_change_log(
    spark: SparkSession, path: str, schema: T.StructType, position: str, upto: int | None = None, ranges: int = RANGES
) -> DataFrame:
    """The log at ``path`` as a stream, in order of ``position``."""
    spark.dataSource.register(ChangeLog)
    reader = spark.readStream.format("changelog").schema(schema).option("path", path).option("position", position).option("ranges", ranges)
    return (reader if upto is None else reader.option("upto", upto)).load()
