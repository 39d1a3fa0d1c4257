"""Helpers of the training-data operators: stored tables, components, words as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.sources.scratch import folder_of, fresh_path

#: Bytes that end a word: space and the controls from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here and lost executors cost no rerun."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are deleted once nothing reads them, written by jobs whose shuffles go when they end.

    Spark keeps the shuffle files of a job until the driver happens to collect its garbage; a loop of jobs over large
    tables would fill the disks with files that no later job reads.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Jobs in here leave no shuffle files behind."""
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        with self.tidy():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.paths if any(t is x for x in tables)]:
            found, system = folder_of(self.spark, path)
            system.delete(found, True)
        self.paths = [(t, p) for t, p in self.paths if not any(t is x for x in tables)]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """Identifies a row by content, so rows that share an id stay apart and equal rows share one result."""
    return F.xxhash64(*[F.col(n) for n in names])


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: decides the fold of a row.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def share_filter(df: DataFrame, bound: int, *names: str) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of the named columns; every row where there are no more than that."""
    rows = df.count()
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(*names, F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * bound / rows))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds, each a group-by and a join on tables written to the
    shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        small = stored(small.where("a <> b").distinct(), "small-star")
        if small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty():
            roots = small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        edges = small


class Batch:
    """The texts of one Arrow batch as a single byte array with the offsets of each text."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        raw = column.buffers()
        self.offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        self.data = data[self.offsets[0] : self.offsets[-1]] if len(column) else data[:0]
        self.offsets = self.offsets - self.offsets[0] if len(column) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece holds about ``size`` bytes of text: bounded memory whatever the lengths."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0)).astype(np.int64)
        start, held = 0, 0
        for k, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9FB21C651E98DF25)


def words(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the batch, A-Z lower-cased, and the row it belongs to, in text order."""
    data = _LOWER[batch.data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = batch.offsets[:-1][batch.offsets[:-1] < batch.offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)), axis=0) if starts[0] == 0 else None
    if at is None:
        at = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))])
    power = np.full(int(at.max()) + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = _BYTE[data] * power[at]
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(batch.offsets, starts, side="right") - 1


def shingles(batch: Batch, width: int, weight: Callable[[np.ndarray], np.ndarray] | None = None):
    """Hashes of all word shingles and their rows; a text with fewer words is one shingle.

    With ``weight`` (word hash to number) also the sum of the weights of a shingle's words.
    """
    h, row = words(batch)
    if not len(h):
        return h, row, np.zeros(0, np.float32)
    w = weight(h) if weight else np.zeros(len(h), np.float32)
    count = np.bincount(row, minlength=len(batch))
    m = max(len(h) - width + 1, 0)
    acc, wsum = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for k in range(width):
        acc = acc * _STEP + h[k : k + m]
        wsum = wsum + w[k : k + m]
    whole = row[:m] == row[width - 1 : width - 1 + m]
    out, rows, weights = mixed(acc[whole]), row[:m][whole], wsum[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        extra, heavy = np.empty(len(short), np.uint64), np.empty(len(short), np.float32)
        for i, r in enumerate(short):
            a = np.full(1, count[r], np.uint64)
            for k in range(begin[r], begin[r + 1]):
                a = mixed(a * _STEP + h[k : k + 1])
            extra[i], heavy[i] = a[0], w[begin[r] : begin[r + 1]].sum()
        out, rows, weights = np.append(out, extra), np.append(rows, short), np.append(weights, heavy)
        order = np.argsort(rows, kind="stable")
        out, rows, weights = out[order], rows[order], weights[order]
    return out, rows, weights
