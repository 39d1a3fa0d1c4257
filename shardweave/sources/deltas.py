"""Tables of base files, delta files and a committed position, merged when they are read.

A round of a catch-up writes only the keys that changed since the committed position: one row for each, a delete as
a tombstone.  A commit file then names the base, the rounds and the position; a round counts once it is named, so a
run that is killed goes on from the last committed position and writes over what it left behind.  Reading puts the
last change of a key in the place of its base row.  Compaction writes a new base beside the old one and names it in
the next commit; readers see either.  There is one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardweave.operators.changes import apply_net_changes, net_changes
from shardweave.operators.placement import SHARD
from shardweave.sources.layout import write_sharded
from shardweave.sources.scratch import folder_of, last_text, save_text


class ContentLost(RuntimeError):
    """What was read back is not what was written."""


def content_digest(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell the rows of a table but not their order: count, xor and sum of row hashes.

    They add up over parts of a table.  Nulls count by their column, so a value that moves to a neighbouring
    null column is seen.
    """
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(row), F.lit(0).cast("long")).alias("mixed"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
    ]


def digest_of(df: DataFrame, columns: Sequence[str]) -> dict:
    return df.agg(*content_digest(columns)).first().asDict()


def observed(seen: Observation) -> dict | None:
    """What was observed; None where the plan turned out empty and its observation was dropped."""
    try:
        return seen.get
    except Py4JJavaError:
        return None


def write_proven(rows: DataFrame, path: str, columns: Sequence[str]) -> dict:
    """Write placed rows as a new dataset and read them back; both must have the same content digest."""
    seen = Observation()
    write_sharded(rows.observe(seen, *content_digest(columns)), path, whole=True)
    found = digest_of(rows.sparkSession.read.schema(rows.schema).parquet(path), columns)
    # a task that ran twice, because an executor was lost, counts twice in an observation
    if observed(seen) != found and (wrote := digest_of(rows, columns)) != found:
        raise ContentLost(f"wrote {wrote}, found {found} in {path}")
    return found


@dataclass(frozen=True)
class Commit:
    version: int
    #: Where in the change log the table stands; None before its beginning.
    position: int | None
    base: str
    rounds: tuple[str, ...] = ()
    shards: tuple[str, ...] = ()
    key: str = ""
    order: str = ""
    base_schema: str = ""
    round_schema: str = ""
    folded: bool = False


class DeltaTable:
    """A sharded table below ``root``; its rows have the shard in ``__shard``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # --- commits ----------------------------------------------------------------------

    def commit(self) -> Commit | None:
        """The last commit; None if there is none."""
        text = last_text(self.spark, f"{self.root}/commits", ".json")
        if text is None:
            return None
        fields = json.loads(text)
        return Commit(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})

    def _publish(self, commit: Commit) -> Commit:
        if not save_text(self.spark, f"{self.root}/commits/{commit.version:012d}.json", json.dumps(asdict(commit)), replace=False):
            raise RuntimeError(f"version {commit.version} of {self.root} was committed by another writer")
        return commit

    # --- writing ----------------------------------------------------------------------

    def create(self, rows: DataFrame, shards: Sequence[str], key: str, order: str, position: int | None = None) -> dict:
        """The first base, read back and proven; returns its content digest."""
        columns = [c for c in rows.columns if c != SHARD]
        rows = rows.select(*columns, SHARD)
        self.clean()
        last = self.commit()
        version = 0 if last is None else last.version + 1
        proof = write_proven(rows, f"{self.root}/base-{version}", columns)
        self._publish(Commit(version, position, f"base-{version}", (), tuple(shards), key, order, rows.schema.json()))
        return proof

    def append(self, changes: DataFrame, upto: int) -> int:
        """One round: the last change of each key among ``changes`` after the committed position, up to ``upto``.

        ``changes`` have op, key, order, ``__shard`` and the columns of the base.  Returns the keys written.
        """
        last = self.commit()
        after = F.lit(True) if last.position is None else F.col(last.order) > last.position
        fresh = changes.filter(after & (F.col(last.order) <= upto))
        payload = [c for c in self._base_schema(last).names if c not in (last.key, SHARD)]
        rows = net_changes(fresh, last.key, [last.order], [*payload, SHARD])
        rows = rows.select("op", last.order, last.key, *payload, SHARD)
        name = f"round-{last.version + 1}"
        proof = write_proven(rows, f"{self.root}/{name}", rows.columns[:-1])
        rounds = (*last.rounds, name) if proof["n"] else last.rounds
        self._publish(replace(last, version=last.version + 1, position=upto, rounds=rounds, round_schema=rows.schema.json()))
        return proof["n"]

    def compact(self) -> None:
        """Fold the rounds into a new base."""
        last = self.commit()
        if last.rounds:
            name = f"base-{last.version + 1}"
            rows = self.read()
            write_proven(rows, f"{self.root}/{name}", [c for c in rows.columns if c != SHARD])
            self._publish(replace(last, version=last.version + 1, base=name, rounds=()))

    def fold_into(self, path: str) -> None:
        """Write the merged rows as shards of the dataset at ``path`` and retire this table."""
        last = self.commit()
        if not last.folded:
            write_sharded(self.read(), path)
            self._publish(replace(last, version=last.version + 1, folded=True))

    def clean(self) -> None:
        """Remove files that the last commit does not name; readers of earlier commits must have ended."""
        folder, system = folder_of(self.spark, self.root)
        last = self.commit()
        named = {"commits"} if last is None or last.folded else {"commits", last.base, *last.rounds}
        for entry in system.listStatus(folder) if system.exists(folder) else []:
            if entry.getPath().getName() not in named:
                system.delete(entry.getPath(), True)

    # --- reading ----------------------------------------------------------------------

    @staticmethod
    def _base_schema(commit: Commit) -> StructType:
        return StructType.fromJson(json.loads(commit.base_schema))

    def changes(self) -> DataFrame | None:
        """The last change of every key that changed since the base; None without rounds."""
        last = self.commit()
        if not last.rounds:
            return None
        schema = StructType.fromJson(json.loads(last.round_schema))
        # every round is a dataset of its own, so that its shard folders are partitions
        rounds = [self.spark.read.schema(schema).parquet(f"{self.root}/{r}") for r in last.rounds]
        rows = rounds[0]
        for more in rounds[1:]:
            rows = rows.unionByName(more)
        if len(rounds) == 1:
            return rows
        return net_changes(rows, last.key, [last.order], [c for c in schema.names if c not in ("op", last.key, last.order)])

    def read(self) -> DataFrame:
        """All rows as of the committed position."""
        last = self.commit()
        base = self.spark.read.schema(self._base_schema(last)).parquet(f"{self.root}/{last.base}")
        net = self.changes()
        return base if net is None else apply_net_changes(base, net, last.key)


def moved_tables(spark: SparkSession, path: str) -> list[tuple[DeltaTable, Commit]]:
    """Tables that a move keeps beside the dataset at ``path`` and that are not folded into it yet."""
    folder, system = folder_of(spark, f"{path}.moving")
    if not system.exists(folder):
        return []
    found = [DeltaTable(spark, f"{path}.moving/{e.getPath().getName()}") for e in system.listStatus(folder)]
    held = [(t, t.commit()) for t in found]
    return [(t, c) for t, c in held if c is not None and not c.folded]
