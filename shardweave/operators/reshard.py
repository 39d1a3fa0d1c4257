"""Moving the rows of a sharded table to new shards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shardweave.operators.changes import apply_changes
from shardweave.operators.hashtree import BITS, bucket_of_key, differing_buckets, hash_tree
from shardweave.operators.placement import SHARD, assign_shard
from shardweave.sources.deltas import ContentLost, DeltaTable, content_digest, digest_of, observed
from shardweave.sources.layout import current_topology, drop_shards, read_placed, read_sharded, switch_topology, write_sharded
from shardweave.sources.scratch import fresh_path
from shardweave.sources.topology import Range, Topology, parse_bound


class SplitRefused(ValueError):
    """The split plan does not conserve keys or is not supported."""


# --- single steps ---------------------------------------------------------------------


def copy_table(source: DataFrame, path: str) -> int:
    """Copy all rows; returns their number, counted while writing."""
    seen = Observation()
    source.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def rows_moving(source: DataFrame, topology: Topology, targets: Sequence[str]) -> DataFrame:
    """Rows of ``source`` that the topology places on one of the targets, with their new shard."""
    plain = source.drop(SHARD)
    return assign_shard(plain, topology, strict=True).filter(F.col(SHARD).isin(list(targets)))


def copy_ranges(source: DataFrame, topology: Topology, targets: Sequence[str], path: str) -> dict[str, int]:
    """Copy the rows of all targets in one job; returns rows copied and rows scanned."""
    scanned, copied = Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    moving = rows_moving(source.observe(scanned, n), topology, targets).observe(copied, n)
    write_sharded(moving, path)
    return {"copied": copied.get["n"], "scanned": scanned.get["n"]}


def delete_moved(source: DataFrame, topology: Topology, moved: Sequence[str]) -> DataFrame:
    """Source without the rows that now belong to the moved shards."""
    placed = assign_shard(source, topology, "__now", strict=True)
    return placed.filter(~F.col("__now").isin(list(moved))).drop("__now")


def delete_foreign(target: DataFrame, topology: Topology, keep: str) -> DataFrame:
    """Target without the rows that belong to another shard."""
    placed = assign_shard(target, topology, "__now", strict=True)
    return placed.filter(F.col("__now") == keep).drop("__now")


def conservation(source: DataFrame, kept: DataFrame, moved: DataFrame, topology: Topology) -> DataFrame:
    """One row: totals before and after, and rows that are not on the shard of their key."""
    after = assign_shard(kept.unionByName(moved), topology, "__now", strict=True)
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    misplaced = (F.col("__now") != F.col(SHARD)).cast("long")
    # Both sides as counts to add up, so that one aggregate compares them.
    counts = source.select(one.alias("n_before"), none.alias("n_after"), none.alias("n_misplaced")).unionByName(
        after.select(none.alias("n_before"), one.alias("n_after"), misplaced.alias("n_misplaced"))
    )
    names = ("n_before", "n_after", "n_misplaced")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return sums.withColumn("conserved", (F.col("n_before") == F.col("n_after")) & (F.col("n_misplaced") == 0))


def content_conservation(source: DataFrame, copies: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """One row per shard: rows of the source and of every copy, and whether a copy has the source's rows.

    ``n_source``, and ``n_<name>`` and ``same_<name>`` for each copy.  Each side is one aggregate that combines
    before the shuffle; a row that is lost, repeated or changed in any column changes its digest.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        digest = df.groupBy(SHARD).agg(*content_digest(columns))
        return digest.select(SHARD, F.col("n").alias(f"n_{name}"), F.struct("n", "mixed", "total").alias(f"__{name}"))

    both = side(source, "source")
    for name, copy in copies.items():
        both = both.join(side(copy, name), SHARD, "full_outer")
    counts = [F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in ("source", *copies)]
    same = [F.col("__source").eqNullSafe(F.col(f"__{n}")).alias(f"same_{n}") for n in copies]
    return both.select(SHARD, *counts, *same)


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of the given columns of a row."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_diff(left: DataFrame, right: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys that exist on one side only or whose rows differ, among a share of all keys.

    The sample is chosen by a hash of the key, so both sides pick the same keys; a share of 1
    compares everything.  Keys are unique on each side.
    """
    if not 0.001 <= share <= 1:
        raise ValueError("share must lie between 0.001 and 1")
    columns = sorted(left.columns)
    if sorted(right.columns) != columns:
        raise ValueError("both sides must have the same columns")

    def side(df: DataFrame, name: str) -> DataFrame:
        picked = df if share == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
        return picked.select(key, row_digest(columns).alias(name))

    both = side(left, "__left").join(side(right, "__right"), key, "full_outer")
    problem = (
        F.when(F.col("__right").isNull(), "missing in target")
        .when(F.col("__left").isNull(), "only in target")
        .when(F.col("__left") != F.col("__right"), "different")
    )
    return both.select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def tree_diff(left: DataFrame, right: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Keys that exist on one side only or whose rows differ, found through the sides' hash trees.

    The trees are stored, compared from the root down, and rows are compared only of buckets that differ; none
    are read if no bucket does.  Keys are unique on each side; the result is that of ``table_diff`` over all keys.
    """
    spark, columns = left.sparkSession, sorted(left.columns)
    if sorted(right.columns) != columns:
        raise ValueError("both sides must have the same columns")
    trees = []
    for name, side in (("left", left), ("right", right)):
        path = fresh_path(spark, f"hash-tree-{name}")
        hash_tree(side, key, columns, bits).write.parquet(path)
        trees.append(spark.read.parquet(path))
    path = fresh_path(spark, "hash-tree-differences")
    differing_buckets(*trees, bits).write.parquet(path)
    buckets = spark.read.schema("bucket INT").parquet(path)
    wanted = [s.join(buckets, bucket_of_key(key, bits) == F.col("bucket"), "left_semi") for s in (left, right)]
    if buckets.isEmpty():
        wanted = [s.limit(0) for s in (left, right)]
    return table_diff(*wanted, key, share=1)


def split_progress(report: DataFrame, by: str) -> DataFrame:
    """Rows done, rows in total and their share per target, from a run report."""
    sums = report.groupBy(by).agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    return sums.withColumn("share", F.round(F.col("done") / F.nullif(F.col("total"), F.lit(0)), 6))


# --- the whole move -------------------------------------------------------------------


@dataclass(frozen=True)
class Move:
    """Replace the ranges of the source shards by the target ranges."""

    sources: tuple[str, ...]
    targets: tuple[Range, ...]

    @property
    def target_shards(self) -> list[str]:
        return list(dict.fromkeys(r.shard for r in self.targets))


def split_move(topology: Topology, shard: str, names: tuple[str, str]) -> Move:
    """Split the only range of a shard at its midpoint."""
    owned = [r for r in topology.ranges if r.shard == shard]
    if len(owned) != 1:
        raise SplitRefused(f"shard {shard!r} owns {len(owned)} ranges; exactly one can be split")
    lo, hi = parse_bound(owned[0].lo), parse_bound(owned[0].hi)
    if lo >= hi:
        raise SplitRefused(f"range {owned[0]} holds a single key")
    mid = lo + (hi - lo) // 2
    halves = ((lo, mid), (mid + 1, hi))
    return Move((shard,), tuple(Range(f"0x{a:08x}", f"0x{b:08x}", n) for (a, b), n in zip(halves, names)))


def check_move(sources: Sequence[Range], targets: Sequence[Range]) -> None:
    """Refuse a move whose sources or targets are not contiguous, or do not span the same keys."""
    spans = []
    for side, ranges in (("source", sources), ("target", targets)):
        bounds = sorted((parse_bound(r.lo), parse_bound(r.hi)) for r in ranges)
        for lo, hi in bounds:
            if lo > hi:
                raise SplitRefused(f"{side} range 0x{lo:08x}..0x{hi:08x} is inverted")
        for (_, end), (start, _) in zip(bounds, bounds[1:]):
            if start != end + 1:
                problem = "overlap" if start <= end else "leave a gap"
                raise SplitRefused(f"{side} ranges {problem} at 0x{start:08x}")
        spans.append((bounds[0][0], bounds[-1][1]))
    if spans[0] != spans[1]:
        raise SplitRefused(f"targets do not span the sources: {spans}")


def moved_topology(topology: Topology, move: Move) -> Topology:
    """Topology after the move, once the plan is known to conserve keys."""
    if topology.vindex_type != "hash":
        raise SplitRefused(f"ranges of a {topology.vindex_type} placement cannot be moved by hash bounds")
    sources = [r for r in topology.ranges if r.shard in move.sources]
    if not sources or not move.targets:
        raise SplitRefused("a move needs source and target ranges")
    taken = set(topology.shards) & set(move.target_shards)
    if taken:
        raise SplitRefused(f"target shards {sorted(taken)} already own ranges")
    check_move(sources, move.targets)
    kept = [r for r in topology.ranges if r.shard not in move.sources]
    return topology.with_ranges([*kept, *move.targets])


def active_rows(sharded: DataFrame, topology: Topology) -> DataFrame:
    """Rows of the shards that own ranges; shards left over from a move are not scanned."""
    return sharded.filter(F.col(SHARD).isin(topology.shards))


def run_move(spark: SparkSession, path: str, topology: Topology, move: Move) -> tuple[Topology, dict[str, int]]:
    """Check the plan, copy the moving rows to their new shards, prove conservation, return the new topology.

    Only the source shards are read and only the target shards are written, into the same
    dataset.  The source shards stay until they are dropped, and readers that go through
    ``active_rows`` switch when they take the new topology, so the step can be run again
    after a failure.  Splits, merges and moves of several shards are the same job.
    """
    after = moved_topology(topology, move)
    sources = read_sharded(spark, path).filter(F.col(SHARD).isin(list(move.sources)))
    report = copy_ranges(sources, after, move.target_shards, path)
    written = read_sharded(spark, path).filter(F.col(SHARD).isin(move.target_shards)).count()
    if not report["scanned"] == report["copied"] == written:
        raise RuntimeError(f"rows were not conserved: {report}, found {written}")
    return after, report


class Moved(tuple):
    """(topology, report) of an online move, and ``position``: where in the change log the targets stand.

    The position is None where an earlier run had switched already.
    """

    position: int | None

    def __new__(cls, topology: Topology, report: DataFrame, position: int | None):
        made = super().__new__(cls, (topology, report))
        made.position = position
        return made


def run_online_move(
    spark: SparkSession,
    path: str,
    topology: Topology,
    move: Move,
    key: str,
    changes: Callable[[], DataFrame],
    order: str = "lsn",
    max_lag: int = 0,
    tries: int = 5,
    stop_writes: Callable[[], None] | None = None,
    fold: bool = True,
) -> Moved:
    """Move ranges of a table that is written meanwhile; returns the new topology and a report per target.

    The moving rows are copied beside the dataset as the base of a delta table.  A round then reads the changes
    (``changes()``) after the table's committed position and writes the last one of each key; rounds follow until
    what has come in since is within ``max_lag``.  Then ``stop_writes`` is called, after which the log must not grow;
    its rest is applied, content and rows are checked, and readers switch to the new topology: they merge base and
    rounds.  Without ``stop_writes`` the log has to be found at rest after the check, and what comes in from then on
    is the caller's to apply, from the ``position`` of the result.  At last the source shards go and, unless ``fold``
    is false, the targets become shards of the dataset.  Until the switch readers see the sources, from then on the
    targets.  Run again after a failure at any step, it goes on from the committed position or, if the switch is
    done, from there; the caller lets writes go on in either case.

    The copy must have the content digest of the sources, and what a round or the copy has written must have it
    when it is read back; the rows of each target must be as many as the keys of the sources and the whole log say.
    """
    upto = None
    after = moved_topology(topology, move)
    staged = DeltaTable(spark, f"{path}.moving/{'-'.join(move.target_shards)}")
    report = None
    if current_topology(spark, path, topology).ranges != after.ranges:
        sources = read_sharded(spark, path).filter(F.col(SHARD).isin(list(move.sources)))
        columns = [c for c in sources.columns if c != SHARD]
        held = staged.commit()
        if held is None or held.folded:
            scanned = Observation()
            moving = rows_moving(sources.observe(scanned, *content_digest(columns)), after, move.target_shards)
            copied = staged.create(moving, move.target_shards, key, order)
            if observed(scanned) != copied and (held := digest_of(sources, columns)) != copied:
                raise ContentLost(f"the sources have {held}, the copy {copied}")

        def position() -> int:
            return changes().agg(F.max(order)).first()[0] or 0

        def catch_up() -> int:
            upto, done = position(), staged.commit().position
            if done is None or upto > done:
                fresh = changes() if done is None else changes().filter(F.col(order) > done)
                staged.append(rows_moving(fresh.filter(F.col(order) <= upto), after, move.target_shards), upto)
            return upto

        for _ in range(tries):
            upto = catch_up()
            if position() - upto <= max_lag:
                break
        else:
            raise RuntimeError(f"the move did not catch up within {tries} rounds")
        if stop_writes is not None:
            stop_writes()
        for _ in range(tries):
            upto = catch_up()
            log = changes().filter(F.col(order) <= upto)
            keys = apply_changes(sources.select(key), log, key, [order])
            expected = rows_moving(keys, after, move.target_shards)
            report = _written(spark, staged.read(), move, _per_target(expected)).collect()
            if any(r.done != r.total for r in report):
                raise RuntimeError(f"rows were not conserved: {report}")
            if position() == upto:
                break
        else:
            raise RuntimeError(f"the change log did not come to rest within {tries} rounds")
        switch_topology(spark, path, after)
    drop_shards(spark, path, list(move.sources))
    if fold and staged.commit() is not None:
        staged.fold_into(path)
    if report is None:
        rows = active_rows(read_placed(spark, path, topology), after)
        return Moved(after, _written(spark, rows, move, _per_target(rows)), upto)
    return Moved(after, spark.createDataFrame(report, "target STRING, done LONG, total LONG"), upto)


def _per_target(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col(SHARD).alias("target")).agg(F.count(F.lit(1)).alias("total"))


def _written(spark: SparkSession, rows: DataFrame, move: Move, expected: DataFrame) -> DataFrame:
    """(target, done, total): rows of each target shard beside the rows it should have."""
    targets = spark.createDataFrame([(t,) for t in move.target_shards], "target STRING")
    found = _per_target(rows).withColumnRenamed("total", "done")
    both = targets.join(found, "target", "left").join(expected, "target", "left")
    return both.select("target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("done", "total")])


def move_tables(
    spark: SparkSession, tables: Mapping[str, tuple[str, str]], topology: Topology, move: Move
) -> tuple[Topology, DataFrame]:
    """Run the same move for several tables, given as name -> (path, key column); one job each."""
    rows, after = [], topology
    for name, (path, key) in sorted(tables.items()):
        moved, report = run_move(spark, path, replace(topology, column=key), move)
        after = topology.with_ranges(list(moved.ranges))
        rows.append((name, report["copied"], report["scanned"]))
    return after, spark.createDataFrame(rows, "name STRING, copied LONG, scanned LONG")
