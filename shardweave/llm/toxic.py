"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels.

A sentence is a bag of words and word beginnings; its probability is a logistic score, and a document is
toxic unless every one of its sentences is clean: ``p = 1 - prod(1 - p_s)``.  Only documents carry labels, so
the likelihood of the documents trains the sentence scores, which then also say where the offence is.

The model is fitted on at most about ``SAMPLE`` labelled documents, chosen by a hash of their ids; texts that
occur several times there count once, with the label most of them have (1 if even).  Features are at most
``FEATURES``, those most associated with the label.  Every document is scored on its whole text.  Null and empty
texts have no sentence and score 0.  Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import crc_mod, pieces, share_filter, stored

#: Bound of the labelled documents that the model is fitted on.
SAMPLE = 20_000
#: Bound of the vocabulary, and the association with the label (chi squared) a feature needs among many texts.
#: Among n texts it needs CHI2 * n / (n + CHI2), since chi squared is at most n.
FEATURES = 3000
CHI2 = 30.0
FOLDS, HELD_OUT = 5, 0
ROUNDS, RATE, PENALTY = 400, 0.1, 0.02
BEGINNINGS = (4, 5, 6)

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case letter by letter: places stay; a letter whose lower case is longer stays as it is."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each sentence: up to and with a run of full stops, marks or line ends."""
    for m in _SENTENCE.finditer(text):
        if m.end() > m.start():
            yield m.span()


def features(words: list[str]) -> set[str]:
    """The words, and the beginnings of longer ones marked with a bar."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "|" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """Weights by feature and the bias of every sentence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf

    def __post_init__(self):
        self.heads = {f.rstrip("|")[:4] for f in self.weights}

    def hazards(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """-log of the chance that the text is clean, and (begin, end, score) of sentences with a known feature."""
        total, marked = 0.0, []
        whole = lowered(text)
        quiet = float(np.logaddexp(0, self.bias))
        heads = self.heads
        count = 0
        for a, b in sentences(whole):
            count += 1
            hits = [w for w in _WORD.findall(whole, a, b) if w[:4] in heads]
            if not hits:
                continue
            z = self.bias + sum(self.weights.get(f, 0.0) for f in features(hits))
            h = float(np.logaddexp(0, z))
            total += h - quiet
            marked.append((a, b, -float(np.expm1(-h))))
        return total + count * quiet, marked


def _fit(bags: list[tuple[int, int, list[list[int]]]], n_features: int) -> tuple[np.ndarray, float]:
    """Maximum penalised likelihood by Adam.  bags: (label, sentences, features of the sentences that have some)."""
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] - len(b[2]) for b in bags], float)
    owner = np.array([d for d, b in enumerate(bags) for _ in b[2]], np.int64)
    row = np.array([s for s, fs in enumerate(f for b in bags for f in b[2]) for _ in fs], np.int64)
    column = np.array([f for b in bags for fs in b[2] for f in fs], np.int64)
    w, bias = np.zeros(n_features), -4.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, w[column], minlength=len(owner))
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-bias))
        hazard = np.bincount(owner, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, bias)
        slope = np.where(y > 0, -1 / np.expm1(np.maximum(hazard, 1e-9)), 1.0)
        by_sentence = slope[owner] * p
        grad = np.append(np.bincount(column, by_sentence[row], minlength=n_features) + PENALTY * w, by_sentence.sum() + (slope * plain).sum() * p0)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Learns from the labelled documents outside the held-out fold; disagreeing labels count as 1 from a half on."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    known = share_filter(stored(known, "toxic-labels"), SAMPLE, "doc_id")
    # about SAMPLE narrow rows: bounded whatever the corpus
    rows = docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(known), "doc_id")
    rows = stored(rows.groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y")), "toxic-sample")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        return Model()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for f in features(_WORD.findall(lowered(text))):
                    counts.setdefault(f, [0, 0])[y] += 1
            names = [pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(names, ["feature", "clean", "toxic"])

    counts = rows.mapInArrow(present, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n, a, b = positive + negative, F.col("t"), F.col("c")
    chi2 = n * (a * negative - b * positive) ** 2 / ((a + b) * (n - a - b) * float(positive) * negative)
    chosen = counts.where(a + b >= 3).where(a + b < n).withColumn("chi2", chi2).where(F.col("chi2") > CHI2 * n / (n + CHI2))
    names = [r["feature"] for r in chosen.orderBy(F.desc("chi2"), "feature").limit(FEATURES).collect()]
    if not names:
        return Model()
    number = {f: i for i, f in enumerate(names)}
    heads = {f.rstrip("|")[:4] for f in names}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                lower, count, known = lowered(text), 0, []
                for s, e in sentences(lower):
                    count += 1
                    hits = [w for w in _WORD.findall(lower, s, e) if w[:4] in heads]
                    own = sorted(number[f] for f in features(hits) if f in number) if hits else []
                    if own:
                        known.append(own)
                out.append({"y": y, "count": count, "known": known})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("y", pa.int32()), ("count", pa.int32()), ("known", pa.list_(pa.list_(pa.int32())))]))

    bags = [(r["y"], r["count"], r["known"]) for r in rows.mapInArrow(bag, "y int, count int, known array<array<int>>").toLocalIterator()]
    # sums in another order of rows differ in the last digits
    weights, bias = _fit(sorted(bags), len(names))
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (begin, end and score, from 0.5) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in pieces(batches):
            found = [model.hazards(t or "") for t in batch.column("text").to_pylist()]
            score = pa.array([min(max(-float(np.expm1(-h)), 0.0), 1.0) for h, _ in found], pa.float64())
            where = [[dict(zip(("begin", "end", "score"), s, strict=True)) for s in marked if s[2] >= 0.5] for _, marked in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score, pa.array(where, kind)], ["doc_id", "score", "sentences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, sentences array<struct<begin:int,end:int,score:double>>")
    return scored.select(
        "doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences",
    )
