"""Language identification by bit-sliced Bloom filters of byte n-grams.

All languages share one Bloom filter whose slots are bit masks: bit l of a slot says that the filter of
language l has that slot set.  The masks at an n-gram's slots, combined with AND, are all languages that
contain the n-gram.  A text's score for a language is the number of its n-grams with that bit, less the
number that chance alone would set (the filter's fill to the power of the slots per n-gram).

Learning takes about ``LEARN`` documents per language, chosen by a hash of their ids, outside the held-out
fold and with a language; an n-gram belongs to a language where it is not much rarer than in the language
that uses it most.  Every text is judged whole.  Null texts and texts without a letter are ``und`` with score
0, and so is all text if nothing was learned; texts without a known n-gram get the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import Batch, crc_mod, mixed, pieces, stored

#: Bound of the documents learned from, and of the n-grams kept, per language.
LEARN = 3000
GRAMS = 60_000
SIZES = (3, 5)
SLOTS, HASHES = 1 << 20, 3
#: An n-gram is kept where its rate is at least this share of its highest rate in any language.
SHARE = 0.1
FOLDS, HELD_OUT = 5, 0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts and the row of each.  Inside an n-gram all bytes are letters."""
    texts = Batch(pc.utf8_lower(column.cast(pa.large_string())))
    data = _FOLD[texts.data]
    letter = data != 32
    n = len(data)
    out, rows = [], []
    row = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        good = row[:m] == row[size - 1 :]
        for k in range(1, size - 1):
            good &= letter[k : k + m]
        at = np.flatnonzero(good)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h << np.uint64(8) | data[at + k]
        out.append(mixed(h))
        rows.append(row[at])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    """Languages by bit, the slots' masks and each language's chance of a false hit."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, languages: list[str], members: list[np.ndarray]) -> Model:
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        fill = []
        for bit, own in enumerate(members):
            slots = np.unique(np.concatenate(cls.slots(own))) if len(own) else np.zeros(0, np.int64)
            masks[slots, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
            fill.append(len(slots) / SLOTS)
        return cls(languages, masks, np.array(fill) ** HASHES)

    @staticmethod
    def slots(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def hits(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Corrected number of n-grams of every row in every language."""
        slots = self.slots(h)
        found = self.masks[slots[0]]
        for s in slots[1:]:
            found &= self.masks[s]
        total = np.bincount(row, minlength=rows)[:, None]
        count = np.zeros((rows, len(self.languages)))
        for bit in range(len(self.languages)):
            has = (found[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            count[:, bit] = np.bincount(row[has.astype(bool)], minlength=rows)
        return np.maximum((count - total * self.chance) / (1 - np.minimum(self.chance, 0.99)), 0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        hits = self.hits(*grams(column), len(column))
        best = hits.argmax(1)
        top = hits.max(1)
        rest = hits.copy()
        rest[np.arange(len(rest)), best] = 0
        score = np.where(top > 0, top / np.maximum(top + rest.max(1), 1e-9), 1 / len(self.languages))
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(crc_mod("doc_id", folds) != held_out)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(1_000_000 * min(1, LEARN / sizes[lang])) + 1))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()])
            h, row = grams(batch.column("text"))
            for bit in np.unique(langs):
                g, n = np.unique(h[langs[row] == bit], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), bit, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], ["bit", "gram", "n"])

    counts = rows.where(chosen).select("lang", "text").mapInArrow(count, "bit int, gram long, n long")
    counts = stored(counts.groupBy("bit", "gram").agg(F.sum("n").alias("n")).where("n > 1"), "language-grams")
    totals = {r["bit"]: r["n"] for r in counts.groupBy("bit").agg(F.sum("n").alias("n")).collect()}
    rate = F.lit(0.0)
    for bit, n in totals.items():
        rate = F.when(F.col("bit") == bit, F.col("n") / float(n)).otherwise(rate)
    rated = counts.withColumn("rate", rate)
    peak = rated.groupBy("gram").agg(F.max("rate").alias("peak"))
    kept = stored(rated.join(peak, "gram").where(F.col("rate") >= SHARE * F.col("peak")).select("bit", "gram", "n"), "language-kept")
    # the least count per language that keeps no more than GRAMS: from a table of counts, not a sort by language
    least: dict[int, int] = {}
    held = dict.fromkeys(totals, 0)
    for r in sorted(kept.groupBy("bit", F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("grams")).collect(), key=lambda r: -r["n"]):
        held[r["bit"]] += r["grams"]
        if held[r["bit"]] <= GRAMS or r["bit"] not in least:
            least[r["bit"]] = r["n"]
    enough = F.lit(False)
    for bit, n in least.items():
        enough = enough | ((F.col("bit") == bit) & (F.col("n") >= n))
    table = kept.where(enough).select("bit", "gram").toPandas()
    members = [table.loc[table["bit"] == bit, "gram"].to_numpy(np.int64).view(np.uint64) for bit in range(len(languages))]
    return Model.of(languages, members)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            lang, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
