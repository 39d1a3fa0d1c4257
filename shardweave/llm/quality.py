"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every text becomes a short vector of statistics.  Random Fourier features approximate a Gaussian kernel over
the standardised vectors; each partition adds up its part of the normal equations, the sums (a fixed number
of rows, whatever the corpus) give the ridge weights, and pool-adjacent-violators over a histogram of the
training scores turns raw scores into probabilities.

Null and empty texts have a vector of zeros and get a score like any other.  Rows with the same id are scored
one by one; labels that disagree for one id count as their mean.  Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import Batch, crc_mod, pieces, shingles, stored, words

FEATURES = 256
RIDGE = 1e-3
BINS = 1000
LOW, HIGH = -1.0, 2.0
FOLDS, HELD_OUT = 3, 1
#: Bytes of text whose statistics are held at once: a byte takes some 40 bytes of numbers while it is counted.
PIECE = 1 << 18

_LETTER, _UPPER, _DIGIT, _BREAK, _STOP, _LOUD, _SIGN, _WIDE = range(8)
_CLASS = np.full(256, 8, np.uint8)
_CLASS[97:123] = _LETTER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[10] = _BREAK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[ord("!")] = _LOUD
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SIGN
_CLASS[128:] = _WIDE
WIDTH = 15


def statistics(batch: Batch) -> np.ndarray:
    """One row of WIDTH numbers per text: lengths, shares of byte classes, repetition of words and shingles."""
    n = len(batch)
    size = np.diff(batch.offsets).astype(np.float64)
    out = np.zeros((n, WIDTH))
    if not len(batch.data):
        return out
    kind = _CLASS[batch.data]
    live = np.flatnonzero(size > 0)
    shares = np.zeros((n, 8))
    for k in range(8):
        shares[live, k] = np.add.reduceat((kind == k).astype(np.int32), batch.offsets[:-1][live])
    plain = np.maximum(shares[:, _LETTER] + shares[:, _UPPER], 1)
    full = np.maximum(size, 1)
    h, row = words(batch)
    count = np.bincount(row, minlength=n).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    grams, gram_row, _ = shingles(batch, 3)
    gram_count = np.bincount(gram_row, minlength=n)
    gram_begin = np.concatenate([[0], np.cumsum(gram_count)])
    variety, top, fresh = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(count):
        _, times = np.unique(h[begin[i] : begin[i + 1]], return_counts=True)
        variety[i], top[i] = len(times) / count[i], times.max() / count[i]
        mine = np.sort(grams[gram_begin[i] : gram_begin[i + 1]])
        fresh[i] = (1 + np.count_nonzero(mine[1:] != mine[:-1])) / len(mine)
    some = np.maximum(count, 1)
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(count)
    out[:, 2] = np.log1p(size / some)
    out[:, 3] = shares[:, _UPPER] / plain
    out[:, 4] = shares[:, _DIGIT] / full
    out[:, 5] = np.minimum(shares[:, _STOP] / some, 3)
    out[:, 6] = np.minimum(shares[:, _LOUD] / some, 3)
    out[:, 7] = np.minimum(shares[:, _SIGN] / some, 3)
    out[:, 8] = shares[:, _WIDE] / full
    out[:, 9] = np.log1p(shares[:, _BREAK]) / np.maximum(np.log1p(count), 1)
    out[:, 10] = variety
    out[:, 11] = top
    out[:, 12] = fresh
    out[:, 13] = np.bincount(row, again, minlength=n) / some
    out[:, 14] = variety * np.log1p(count)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            rows = statistics(Batch(batch.column("text"))).astype(np.float32)
            flat = pa.array(rows.ravel(), pa.float32())
            at = pa.array(np.arange(0, rows.size + 1, WIDTH, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, flat)], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<float>")


@dataclass
class Model:
    """Standardisation, random projection, ridge weights and calibration knots; all of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray
    features: int = FEATURES
    seed: int = 10

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        self.project = draw.normal(size=(WIDTH, self.features)) / np.sqrt(WIDTH)
        self.phase = draw.uniform(0, 2 * np.pi, self.features)

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.project + self.phase) * np.sqrt(2 / self.features)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.lifted(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.knots, self.levels)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(-1, WIDTH).astype(np.float64)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to ``value`` by weighted squares."""
    level: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level.pop()
            level.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in level]) if level else np.zeros(0)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Learns from (stats, y) rows, all of them; only sums of fixed size reach the driver."""
    moments = rows.select(
        *[F.struct(F.avg(F.col("stats")[i]).alias("m"), F.stddev_pop(F.col("stats")[i]).alias("s")).alias(f"f{i}") for i in range(WIDTH)],
        F.count("*").alias("n"),
    ).first()
    if not moments["n"]:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), None, np.zeros(1), np.zeros(1), features)
    mean = np.array([moments[f"f{i}"]["m"] for i in range(WIDTH)])
    scale = np.array([max(moments[f"f{i}"]["s"], 1e-6) for i in range(WIDTH)])
    model = Model(mean, scale, None, np.zeros(1), np.zeros(1), features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.lifted(_matrix(batch))
            y = np.asarray(batch.column("y")).astype(np.float64)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["line", "part"]
        )

    def added(group):
        total = np.sum([np.frombuffer(part) for part in group.column("part").to_pylist()], axis=0)
        return pa.table({"line": group.column("line").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "y").mapInArrow(sums, "line int, part binary")
    lines = parts.groupBy("line").applyInArrow(added, "line int, part binary").collect()
    system = np.array([np.frombuffer(r["part"]) for r in sorted(lines, key=lambda r: r["line"])])
    count = system[-1, -2]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * count * np.eye(features + 1) / features, system[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            at = np.minimum((model.raw(_matrix(batch)) - LOW) * (BINS / (HIGH - LOW)), BINS - 1).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            total += np.bincount(at, np.asarray(batch.column("y")).astype(np.float64), minlength=BINS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some])], ["bin", "n", "y"])

    bins = rows.select("stats", "y").mapInArrow(binned, "bin int, n long, y double")
    table = sorted(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect(), key=lambda r: r["bin"])
    n = np.array([r["n"] for r in table], float)
    model.knots = LOW + (np.array([r["bin"] for r in table]) + 0.5) * (HIGH - LOW) / BINS
    model.levels = np.clip(isotonic(np.array([r["y"] for r in table]) / n, n), 0, 1)
    return model


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(stats, y) of the labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(crc_mod("doc_id", folds) != held_out)
        .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    )
    return stored(stats.join(known, "doc_id").select("stats", "y"), "quality-rows")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = stored(with_statistics(docs), "quality-stats")
    model = fit(training_rows(stats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with their columns as they were."""
    model = fit(training_rows(with_statistics(docs), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            good = model.score(statistics(Batch(batch.column("text"))).astype(np.float32).astype(np.float64)) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
