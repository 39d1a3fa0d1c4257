"""Near-duplicate embeddings by product quantisation with exact reranking.

Unit vectors are dealt to the inverted list of their nearest coarse centroid, and the residual is stored as
one code word per subspace.  A vector is looked up in every list whose Voronoi cell may hold a partner: its
signed distance from the bisector of the two centroids is a linear function, so a partner at distance r can
lie beyond it by r at most.  In a list, distances are sums of table entries, one table of (query residual,
code word) distances per subspace; a member stays a candidate while that sum, less the member's own
quantisation error, is within r.  Both tests are bounds, so no link is lost, and candidates are reranked by
the exact cosine.

How many lists a label is dealt to follows its own size, in powers of two: labels of about one size share centroids
and code books.  Equal vectors of one label are one class.  Lists are cut into chunks of bounded size, every chunk of queries
meeting every chunk of members, so a dense group is many tasks; links are counted there and only the edges
that join components leave a task.  Centroids and code books are fitted on a bounded sample.

A vector that is null, empty or zero, or has a null or non-finite component, or no label, links with nothing;
vectors of different length do not link.  Rows that share an id stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import components, stored
from shardweave.llm.vectors import k_means, lists, matrix, nearest, sample_of, unit, usable

#: Bound of the sample that centroids and code books are fitted on.
SAMPLE = 10_000
LIST_SIZE, MOST_LISTS = 400, 1024
SUBSPACES, CODES = 8, 64
MEMBERS, QUERIES = 2048, 4096


@dataclass
class Codebook:
    """Coarse centroids and, per subspace, the code words of residuals."""

    centres: np.ndarray
    cuts: list[np.ndarray]
    books: list[np.ndarray]

    @classmethod
    def of(cls, sample: np.ndarray, rows: int) -> Codebook:
        centres = k_means(sample, min(MOST_LISTS, max(1, rows // LIST_SIZE)))
        rest = sample - centres[nearest(sample, centres)]
        cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        return cls(centres, cuts, [k_means(rest[:, c], CODES) for c in cuts])

    def codes(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def error(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.sqrt(sum(((rest[:, c] - b[codes[:, j]]) ** 2).sum(1) for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of query residuals to coded members, by table look-up."""
        total = np.zeros((len(rest), len(codes)))
        for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((rest[:, c][:, None, :] - b[None]) ** 2).sum(2)
            total += table[:, codes[:, j]]
        return total


def _lists(classes: DataFrame) -> DataFrame:
    """The classes with the number of lists of their label."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    power = F.floor(F.log2(F.greatest(F.col("size") / LIST_SIZE, F.lit(1.0))))
    lists = F.least(F.pow(F.lit(2.0), power), F.lit(float(MOST_LISTS))).cast("int").alias("lists")
    return classes.join(sizes.select("label", "dim", lists), ["label", "dim"])


def _deal(rows: DataFrame, books: dict[tuple[int, int], Codebook], radius: float) -> DataFrame:
    """A row for each list that a class is a member of or is looked up in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([np.asarray(batch.column(c)) for c in ("dim", "lists")], 1)
            for dim, n in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == (dim, n)).all(1)))
                book = books[dim, n]
                x = unit(matrix(part.column("embedding"), dim))
                own = nearest(x, book.centres)
                square = np.einsum("ij,ij->i", book.centres, book.centres)
                far = square[None] - 2 * x @ book.centres.T
                beyond = far - far[np.arange(len(x)), own][:, None]
                apart = np.sqrt(np.maximum(square[None] + square[own][:, None] - 2 * book.centres[own] @ book.centres.T, 0))
                asks = beyond <= 2 * apart * radius + 1e-9
                asks[np.arange(len(x)), own] = True
                i, where = np.nonzero(asks)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in ("label", "cls", "n", "embedding", "dim", "lists")]
                    + [pa.array(where.astype(np.int32)), pa.array(own[i] == where)],
                    ["label", "cls", "n", "embedding", "dim", "lists", "list", "member"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"label {label}, cls long, n long, embedding {kind}, dim int, lists int, list int, member boolean")


def _links(tasks: DataFrame, books: dict[tuple[int, int], Codebook], least: float, radius: float) -> DataFrame:
    """(a, n, b): links counted for class a, and edges a - b that join components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        members, queries = group[group["side"] == 1], group[group["side"] == 0]
        if not len(members) or not len(queries):
            return none
        book = books[int(group["dim"].iloc[0]), int(group["lists"].iloc[0])]
        centre = book.centres[int(group["list"].iloc[0])]
        y, x = (np.stack(p["embedding"].to_numpy()).astype(np.float64) for p in (members, queries))
        y_norm, x_norm = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (y, x))
        rest = y / y_norm[:, None] - centre
        codes = book.codes(rest)
        within = (radius + book.error(rest, codes) + 1e-9) ** 2
        ask = x / x_norm[:, None] - centre
        y_cls, x_cls, weight = members["cls"].to_numpy(), queries["cls"].to_numpy(), members["n"].to_numpy()
        comp = {c: i for i, c in enumerate(np.unique(np.concatenate([y_cls, x_cls])))}
        y_at = np.array([comp[c] for c in y_cls])
        x_at = np.array([comp[c] for c in x_cls])
        label = np.arange(len(comp))
        a, n, b = [], [], []
        for s in range(0, len(x), 256):
            near = book.distances(ask[s : s + 256], codes) <= within[None]
            some = np.flatnonzero(near.any(0))
            if not len(some):
                continue
            cosine = (x[s : s + 256] @ y[some].T) / (x_norm[s : s + 256, None] * y_norm[some][None])
            linked = near[:, some] & (cosine >= least) & (x_cls[s : s + 256, None] != y_cls[some][None])
            for i in np.flatnonzero(linked.any(1)):
                mine = some[linked[i]]
                a.append(x_cls[s + i])
                n.append(int(weight[mine].sum()))
                b.append(x_cls[s + i])
                here = label[x_at[s + i]]
                found, first = np.unique(label[y_at[mine]], return_index=True)
                for other, k in zip(found, first, strict=True):
                    if other != here:
                        label[label == other] = here
                        a.append(x_cls[s + i])
                        n.append(0)
                        b.append(y_cls[mine[k]])
        return pd.DataFrame({"a": np.array(a, np.int64), "n": np.array(n, np.int64), "b": np.array(b, np.int64)})

    return tasks.groupBy("label", "dim", "list", "q", "m").applyInPandas(run, "a long, n long, b long")


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    rows = vectors.select(
        "vec_id", "embedding", "label", (usable() & F.col("label").isNotNull()).alias("ok")
    ).withColumn("cls", F.when(F.col("ok"), F.xxhash64("label", "embedding")))
    classes = rows.where("ok").groupBy("label", "embedding", "cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    radius = float(np.sqrt(max(2 - 2 * least, 0.0)))
    placed = stored(_lists(classes), "listed-vectors")
    kinds = [(r["dim"], r["lists"]) for r in placed.select("dim", "lists").distinct().collect()]
    samples = {d: sample_of(classes.where(F.col("dim") == d), SAMPLE) for d in {d for d, _ in kinds}}
    books = {(d, n): Codebook.of(samples[d], n * LIST_SIZE) for d, n in kinds}
    if books:
        dealt = stored(_deal(placed.select("label", "cls", "n", "embedding", "dim", "lists"), books, radius), "dealt-vectors")
        sizes = dealt.groupBy("label", "dim", "list").agg(
            F.ceil(F.count_if("member") / MEMBERS).cast("int").alias("ms"), F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")
        )
        # a list without members has nobody to find
        dealt = dealt.join(sizes.where("ms > 0"), ["label", "dim", "list"])
        own = F.xxhash64("cls", "list")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = ["label", "dim", "lists", "list", "cls", "n", "embedding"]
        asked = dealt.withColumn("q", F.pmod(own, "qs").cast("int")).withColumn("m", every("ms")).withColumn("side", F.lit(0))
        held = dealt.where("member").withColumn("m", F.pmod(own, "ms").cast("int")).withColumn("q", every("qs")).withColumn("side", F.lit(1))
        tasks = asked.select(*cols, "q", "m", "side").union(held.select(*cols, "q", "m", "side"))
        found = stored(_links(tasks, books, least, radius), "vector-links")
        counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
        comps = components(found.where("a <> b").select("a", "b"))
    else:
        counts = classes.select("cls", F.lit(0).cast("long").alias("others")).limit(0)
        comps = classes.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0)
    nodes = classes.select("cls", "n", "least").join(counts, "cls", "left").join(comps, F.col("cls") == F.col("node"), "left")
    nodes = stored(nodes.select("cls", "n", "least", "others", F.coalesce("component", "cls").alias("comp")), "vector-nodes")
    smallest = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    facts = nodes.join(smallest, "comp").select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(facts, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
