"""Best-fit packing of token sequences with large-item matching.

Documents are cut into pieces of at most ``CAPACITY`` tokens.  How many pieces there are of each length is a
table of at most ``CAPACITY`` rows, so the packing itself is planned on that table: pieces above a third of
the capacity, of which no sequence holds more than two, are matched greedily, the longest with the longest
that still fits; smaller pieces, longest first, go where they leave the least room, and open a new sequence
where none has room.  The plan is a list of runs "pieces x to x + m of length L lie at one offset of the
sequences s to s + m".  The pieces of a length are numbered across all tasks by counting, and each finds its
sequence by binary search in the runs.  Nothing but the length table and the plan passes the driver.

Null and empty texts are one piece that holds the closing id alone.  Equal rows are packed one by one.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardweave.llm.shared import pieces, stored

CAPACITY = 2048
END = 0
#: Strings between white space whose ids a worker remembers, and those it remembers to have met.
REMEMBERED = 300_000
#: Bytes of ids of whole texts that a worker remembers.
TEXT_BYTES = 64 << 20

# Texts of these characters are cut here by the tokenizer's own rules (letters, single digits, runs of signs,
# after lower-casing) and each word is encoded once; other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r -~\\u00a1-\\u012f\\u0131-\\u017f]*")
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a tokenizer file of the words-with-ends kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a text that spells a special token goes to the tokenizer whole
        self.special = re.compile("|".join(special) or "(?!)", re.IGNORECASE)
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        # encodes words cut here, without the rules that cut them again
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # ids of strings met in several calls, and the strings met in one: most are never met again
        self.chunks: dict[str, bytes] = {}
        self.once: set[str] = set()
        # ids of whole texts, by 128-bit hash: copies are encoded once by a worker
        self.texts: dict[bytes, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, chunks: list[str]) -> list[bytes]:
        """Ids of strings between white space, some at once; a word's ids end with the one that closes words."""
        out: list[bytes] = []
        for start in range(0, len(chunks), 50):
            some = chunks[start : start + 50]
            words = [_WORD.findall(c) for c in some]
            text = " ".join(chain.from_iterable(words))
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut, last = np.flatnonzero(self.ends[ids]) * 4 + 4, np.cumsum([len(w) for w in words])
            if len(cut) == last[-1] and cut[-1] == len(ids) * 4:
                raw, at = ids.tobytes(), cut[last - 1].tolist()
                out += [raw[a:b] for a, b in zip([0, *at], at)]
            else:
                out += map(self._whole, some)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > TEXT_BYTES:
            self.texts.clear()
            self.held = 0
        names = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        fresh = {n: t for n, t in zip(names, texts, strict=True) if n not in self.texts}
        for name, ids in zip(fresh, self._encoded(list(fresh.values())), strict=True):
            self.texts[name] = ids
            self.held += len(ids)
        return [self.texts[n] for n in names]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        split = [t.lower().split() if _PLAIN.fullmatch(t) and not self.special.search(t) else None for t in texts]
        flat = list(chain.from_iterable(w for w in split if w is not None))
        ids = list(map(self.chunks.get, flat))
        gaps = [i for i, known in enumerate(ids) if known is None]
        new = list(dict.fromkeys([flat[i] for i in gaps]))
        found = dict(zip(new, self._cut(new), strict=True))
        for i in gaps:
            ids[i] = found[flat[i]]
        self._remember(found)
        out, at = [], 0
        for text, w in zip(texts, split, strict=True):
            if w is None:
                out.append(self._whole(text))
            else:
                out.append(b"".join(ids[at : at + len(w)]))
                at += len(w)
        return out

    def _remember(self, found: dict[str, bytes]) -> None:
        again = self.once.intersection(found)
        if len(self.chunks) + len(again) > REMEMBERED:
            self.chunks.clear()
        self.chunks.update((c, found[c]) for c in again)
        self.once -= again
        if len(self.once) > REMEMBERED:
            self.once.clear()
        self.once.update(found.keys() - again)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that they share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with its task and its number there among pieces as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in pieces(batches, 1 << 20):
            rows, texts = [], [t or "" for t in batch.column("text").to_pylist()]
            for i, raw in enumerate(ids_of.encode(texts)):
                raw += END.to_bytes(4, "little")
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    n = len(part) // 4
                    rows.append((i, k, a // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6)]
            columns[0] = columns[0].cast(pa.int32())
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *columns, pa.array(np.full(len(rows), task, np.int32))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "number", "task"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long, task int"
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, pieces, first sequence, offset) that place all pieces.

    Work and result are bounded by the number of lengths, whatever the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    bins: list[tuple[tuple[int, ...], int]] = []  # lengths in one sequence, how many sequences
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    ascending = sorted(large)
    for n in large:
        while left.get(n, 0):
            k = bisect_left(ascending, capacity - n + 1) - 1
            while k >= 0 and not left[ascending[k]]:
                ascending.pop(k)
                k -= 1
            if k < 0 or (ascending[k] == n and left[n] == 1):
                # alone, or the next shorter partner where n itself was the longest that fits
                other = next((m for m in reversed(ascending[:k]) if left[m]), None) if k >= 0 else None
                if other is None:
                    bins.append(((n,), left[n]))
                    left[n] = 0
                    break
            else:
                other = ascending[k]
            m = left[n] // 2 if other == n else min(left[n], left[other])
            bins.append(((n, other), m))
            left[n] -= m
            left[other] -= m
    # bins by the room they have
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for items, m in bins:
        room.setdefault(capacity - sum(items), []).append((items, m))
    gaps = sorted(room)

    def add(gap: int, items: tuple[int, ...], m: int) -> None:
        if gap not in room:
            insort(gaps, gap)
            room[gap] = []
        room[gap].append((items, m))

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                add(capacity, (), todo)
                continue
            gap = gaps[k]
            items, m = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(k)
            fit = gap // n  # the same sequence stays the one with least room while n fits
            full = min(m, todo // fit)
            if full:
                add(gap - fit * n, items + (n,) * fit, full)
                todo -= full * fit
            if full < m:
                if todo and todo < fit:
                    add(gap - todo * n, items + (n,) * todo, 1)
                    full, todo = full + 1, 0
                if full < m:
                    add(gap, items, m - full)
    runs, numbers, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in sorted(room):
        for items, m in room[gap]:
            offset = 0
            if not items:
                continue
            for n in items:
                runs.append((n, numbers[n], m, sequence, offset))
                numbers[n] += m
                offset += n
            sequence += m
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the sequence and offset where they lie."""
    cut = cut_pieces(docs, path, capacity)
    per_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan_packing(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            sequence = runs[at, 3] + number - runs[at, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(runs[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = cut.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number")
    )
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(run, schema)
