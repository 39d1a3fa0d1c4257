"""Vectors as rows of a matrix: which take part, unit rows, spherical k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(name: str = "embedding") -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()).cast(kind))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def sample_of(rows: DataFrame, bound: int, name: str = "embedding") -> np.ndarray:
    """Unit vectors of about ``bound`` rows chosen by a hash of the vector; all of them where there are fewer."""
    total = rows.count()
    if total > bound:
        rows = rows.where(F.pmod(F.xxhash64(name, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * bound / total))
    found = np.array([r[0] for r in rows.select(name).collect()], np.float64)
    return unit(found) if len(found) else found


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from points drawn at random; empty ones are drawn anew."""
    draw = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        some = count > 0
        centres[some] = total[some] / count[some, None]
        if not some.all():
            centres[~some] = points[draw.choice(len(points), int((~some).sum()))]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = np.einsum("ij,ij->i", centres, centres) / 2
    for a in range(0, len(points), 4096):
        out[a : a + 4096] = (points[a : a + 4096] @ centres.T - half).argmax(1)
    return out
