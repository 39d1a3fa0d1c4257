"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else is removed.

Dealing the work out.  The starts of such strings ("windows") are dealt by content: each window belongs to
the least hash of its ``GRAM``-byte strings, leftmost first, so equal windows meet at the same key wherever
they are.  Neighbouring windows with one anchor form a fragment.  A fragment that occurs twice in one text
repeats whole, so the text that repeats itself gives one row of it and the byte ranges that its places cover.
A key with one row has no other repeats; a key whose fragments are all equal repeats whole; only keys with
different fragments go on, one copy of each.
Where one key keeps too many different fragments, its windows are dealt anew by a longer string around the
anchor, half the free bytes at a time, until a key has few fragments or the whole window is the key.

Finding the repeats.  Fragments are read as strings over blocks of ``BLOCK`` bytes, one string per phase.
Each shard of fragments has a Burrows-Wheeler transform of its own.  The transforms are merged by refining
their interleave: one stable pass by preceding symbol sorts all suffixes by one more symbol, and the round
in which a border between neighbours first shows gives their longest common prefix.  After
LENGTH / BLOCK rounds the intervals without a border are the windows that repeat; no suffix is sorted again.

Null and empty texts have nothing to remove.  Rows that share an id stay apart; equal rows are copies of
each other like any two documents.  Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import Batch, mixed, pieces, row_key, stored

LENGTH = 400
GRAM = 96
BLOCK = 50
#: Different fragments one key may keep before it is dealt anew: 16 MB of text at most in one group.
FRAGMENTS = 20_000
#: Places of one key that one task marks.
KEY_ROWS = 5_000
#: Bytes of fragments merged at once, of a long text hashed at once, and shards of one merge.
MERGE_BYTES = 1 << 20
SEGMENT = 1 << 20
SHARDS = 4

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_STEP = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
#: times: places of the fragment in its text.  A row without key is a range covered by fragments with several places.
_FRAGMENT = "rk long, start long, size int, lo int, hi int, key long, content long, times int"
_COLUMNS = pa.schema(
    [("rk", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]
    + [("key", pa.int64()), ("content", pa.int64()), ("times", pa.int32())]
)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width``-byte string of ``data``."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    power = np.full(n, _STEP, np.uint64)
    power[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * np.cumprod(power), out=total[1:])
    power = np.full(n - width + 1, _BACK, np.uint64)
    power[0] = 1
    return mixed((total[width:] - total[:-width]) * np.cumprod(power))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``: prefix and suffix minima of fixed blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _content(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


def fragments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of windows with one anchor: rows of (rk, start, size, lo, hi, key, content, times) as in the module text.

    lo and hi are where the string behind the key begins and ends in the fragment.  Of equal fragments of one
    text (of a segment, where it is long) only the first is a row; what all of them cover follows without key.
    """
    width = length - gram + 1

    def cut(data: np.ndarray, edges: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        # edges: (begin in data, end, row key, where data begins in its text)
        hashes = gram_hashes(data, gram)
        keys = hashes.view(np.int64)
        marks = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_least(marks, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(least)) + 1
        for begin, end, rk, origin in edges:
            last = end - length
            if last < begin:
                continue
            a, b = np.searchsorted(new, [begin + 1, last + 1])
            starts = np.concatenate([[begin], new[a:b]])
            ends = np.append(starts[1:] - 1, last) + length
            raw = data[begin:end].tobytes()
            anchors = least[starts]
            places = list(zip(starts.tolist(), ends.tolist(), anchors.tolist(), keys[anchors].tolist(), strict=True))
            contents = [_content(raw[s - begin : e - begin]) for s, e, _, _ in places]
            times = Counter(contents)
            covered: list[dict] = []
            for (s, e, p, key), content in zip(places, contents, strict=True):
                if n := times[content]:
                    yield rk, origin + s - begin, e - s, p - s, p - s + gram, key, content, n
                if n != 1:
                    times[content] = 0
                    covered.append({"a": origin + s - begin, "b": origin + e - begin})
            for s, e in _merged(covered):
                yield rk, s, e - s, None, None, None, None, None

    def table_of(data: np.ndarray, edges: list) -> pa.RecordBatch | None:
        rows = list(cut(data, edges))
        if not rows:
            return None
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COLUMNS, strict=True)], schema=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SEGMENT):
            texts, keys = Batch(batch.column("text")), batch.column("rk").to_pylist()
            short = []
            for i, rk in enumerate(keys):
                begin, end = int(texts.offsets[i]), int(texts.offsets[i + 1])
                if end - begin <= 2 * SEGMENT:
                    short.append((begin, end, rk, 0))
                    continue
                for s in range(begin, end - length + 1, SEGMENT):
                    e = min(s + SEGMENT + length - 1, end)
                    if (out := table_of(texts.data[s:e], [(0, e - s, rk, s - begin)])) is not None:
                        yield out
            if short:
                a, b = short[0][0], max(x[1] for x in short)
                if b - a <= 4 * SEGMENT:
                    groups = [short]
                else:
                    groups = [[x] for x in short]
                for group in groups:
                    a, b = group[0][0], group[-1][1]
                    if (out := table_of(texts.data[a:b], [(x - a, y - a, rk, o) for x, y, rk, o in group])) is not None:
                        yield out

    rows = docs.select(row_key("doc_id", "text").alias("rk"), "text").where(F.octet_length("text") >= length)
    return rows.mapInArrow(run, _FRAGMENT)


def repeated(rows: DataFrame) -> DataFrame:
    """Fragments whose key occurs again, with whether all of the key are equal and the parts a hot key is dealt to."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
    # a row with several places in its text is known to repeat, so a key needs a second row to be worth a look
    # a table of its own, so that the join is between two plain shuffles and a hot key can be split
    parts = F.expr(f"1 + n div {KEY_ROWS}").alias("parts")
    keys = stored(keys.where("n > 1").select("key", (F.col("a") == F.col("b")).alias("equal"), parts), "repeated-keys")
    return stored(rows.join(keys, "key"), "repeated")


def _split(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Windows of hot keys dealt anew by a longer string around the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = ("rk", "start", "size", "lo", "hi", "key", "times", "raw")
            for rk, start, size, lo, hi, key, times, raw in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                free = length - (hi - lo)
                left, right = -(-free // 2), free // 2 + 1
                last = size - length
                for side, s, e, a, b in (("l", 0, min(lo - left, last), lo - left, hi), ("r", max(lo - left + 1, 0), last, lo, hi + right)):
                    if s > e:
                        continue
                    own = raw[s : e + length]
                    new = _content(f"{key} {side} ".encode() + raw[a:b])
                    out.append((rk, start + s, len(own), a - s, b - s, new, _content(own), times))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS.names, r, strict=True)) for r in out], schema=_COLUMNS)

    return with_bytes(rows, docs).mapInArrow(run, _FRAGMENT)


def with_bytes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    texts = docs.select(row_key("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("raw"))
    joined = texts.join(rows, "rk")
    return joined.withColumn("raw", F.substring("raw", F.col("start").cast("int") + 1, F.col("size")))


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of sorted suffixes of several shards, and the common prefix of neighbours up to ``rounds``.

    A transform lists, in the shard's suffix order, the symbol before each suffix; 0 stands before a whole
    string.  The empty suffix of each string is part of the order.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(source), np.int64)
    prefix = np.full(len(source), rounds, np.int64)
    symbol = np.empty(len(source), np.int64)
    for depth in range(rounds):
        for s, t in enumerate(transforms):
            symbol[source == s] = t
        order = np.argsort(symbol, kind="stable")
        source, before, sorted_symbol = source[order], block[order], symbol[order]
        before[sorted_symbol == 0] = 0
        border = np.ones(len(source), bool)
        border[1:] = (sorted_symbol[1:] != sorted_symbol[:-1]) | (before[1:] != before[:-1])
        prefix[border & (prefix == rounds)] = depth
        block = np.cumsum(border)
    return source, prefix


def shard_transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order (-1 for the empty suffixes) and transform of strings laid end to end; ``ends`` marks last symbols."""
    n = len(symbols)
    rank, step = symbols + 1, 1
    chain = np.concatenate([[0], np.cumsum(ends[:-1])])
    left = np.append(np.flatnonzero(ends), n)[chain] - np.arange(n) + 1
    while step < left.max(initial=1):
        far = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        far[inside] = rank[inside + step]
        _, rank = np.unique(rank * np.int64(n + int(rank.max()) + 2) + far, return_inverse=True)
        rank += 1
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = np.concatenate([[0], symbols[:-1] + 1])
    before[np.flatnonzero(np.concatenate([[True], ends[:-1]]))] = 0
    strings = np.flatnonzero(ends)
    return np.concatenate([np.full(len(strings), -1), order]), np.concatenate([symbols[strings] + 1, before[order]])


def repeated_windows(raws: list[bytes], length: int = LENGTH, block: int = BLOCK) -> list[np.ndarray]:
    """For each byte string, the starts of its windows that occur again in these strings."""
    rounds = length // block
    if length % block:
        raise ValueError("the length must be a multiple of the block")
    sizes = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    none = [np.zeros(0, np.int64) for _ in raws]
    h = gram_hashes(data, block)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(raws)), sizes)[: len(h)]
    offset = np.arange(len(h)) - begin[owner]
    live = offset + block <= sizes[owner]
    _, name, times = np.unique(h, return_inverse=True, return_counts=True)
    again = live & (np.bincount(name[live], minlength=len(times))[name] > 1)
    # a window can repeat only if each of its blocks does: the rest of the strings is left out of the transforms
    window = again.copy()
    for k in range(1, rounds):
        later = np.zeros(len(h), bool)
        later[: len(h) - k * block] = again[k * block :]
        window &= later
    window &= offset + length <= sizes[owner]
    if not window.any():
        return none
    kept = np.zeros(len(h), bool)
    for k in range(rounds):
        kept[k * block :] |= window[: len(h) - k * block]
    at = np.flatnonzero(kept)
    at = at[np.lexsort((at, offset[at] % block, owner[at]))]
    ends = np.ones(len(at), bool)
    ends[:-1] = (at[1:] != at[:-1] + block) | (owner[at[1:]] != owner[at[:-1]])
    symbols = np.unique(name[at], return_inverse=True)[1].astype(np.int64)
    shard_of = owner[at] * min(SHARDS, len(raws)) // len(raws)
    parts = [np.flatnonzero(shard_of == s) for s in range(SHARDS)]
    parts = [p for p in parts if len(p)]
    built = [shard_transform(symbols[p], ends[p]) for p in parts]
    source, prefix = merge_transforms([t for _, t in built], rounds)
    suffix = np.full(len(source), -1, np.int64)
    for s, (order, _) in enumerate(built):
        suffix[source == s] = np.where(order >= 0, parts[s][order], -1)
    same = prefix >= rounds
    repeats = same.copy()
    repeats[:-1] |= same[1:]
    found = at[suffix[repeats & (suffix >= 0)]]
    found = np.sort(found[window[found]])
    cut = np.searchsorted(found, begin)
    return [found[cut[i] : cut[i + 1]] - begin[i] for i in range(len(raws))]


def _runs(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Covered byte ranges of sorted window starts."""
    if len(starts):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
        tails = np.append(heads[1:], len(starts)) - 1
        yield from zip(starts[heads].tolist(), (starts[tails] + length).tolist(), strict=True)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, limit: int = FRAGMENTS) -> DataFrame:
    """(rk, spans): the byte ranges to remove of every text that has some, unmerged."""
    parts = stored(fragments(docs, length, gram), "fragments")
    known = parts.where("key is null").select("rk", "start", "size")
    rows = repeated(parts.where("key is not null"))
    while True:
        hot = rows.where("not equal").groupBy("key").agg(F.count_distinct("content").alias("n")).where(F.col("n") > limit).select("key")
        hot = stored(hot, "hot-keys")
        if hot.isEmpty():
            break
        split = stored(_split(rows.join(hot, "key"), docs, length), "fragments")
        rows = stored(rows.join(hot, "key", "left_anti").unionByName(repeated(split)), "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def merged() -> pa.RecordBatch:
            out = []
            for (rk, start, _), starts in zip(held, repeated_windows([x[2] for x in held], length, block), strict=True):
                out += [(rk, start + a, start + b) for a, b in _runs(starts, length)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["rk", "a", "b"])

        for batch in batches:
            for rk, start, key, raw in zip(*[batch.column(c).to_pylist() for c in ("rk", "start", "key", "raw")], strict=True):
                if key != last and size > MERGE_BYTES:
                    yield merged()
                    held, size = [], 0
                last = key
                held.append((rk, start, raw))
                size += len(raw)
        if held:
            yield merged()

    # one copy of each fragment; those with a second place repeat whole, which is known where it is in the same text
    kinds = rows.where("not equal").groupBy("key", "content").agg(
        F.sum("times").alias("n"), F.min(F.struct("rk", "start", "size")).alias("one"), F.max("parts").alias("parts")
    )
    kinds = stored(kinds, "fragment-kinds")
    single = stored(kinds.where("n = 1").select("key").distinct(), "single-keys")
    wanted = kinds.join(single, "key").select("key", "content", "one.*")
    cut = with_bytes(wanted, docs).select("key", "content", "rk", "start", "raw").dropDuplicates(["key", "content"])
    found = cut.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rk long, a long, b long")
    none = F.lit(0).cast("long")
    twice = kinds.where("n > 1").select("key", "content", F.explode(F.sequence(none, F.col("parts") - 1)).alias("part"))
    once = rows.where("times = 1")
    places = once.where("not equal").withColumn("part", F.pmod(F.xxhash64("rk", "start"), "parts"))
    whole = places.join(twice, ["key", "content", "part"], "left_semi").select("rk", "start", "size").union(once.where("equal").select("rk", "start", "size"))
    found = found.union(whole.union(known).select("rk", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
    return found.groupBy("rk").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in ranges:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column="raw"):
            rows = []
            for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cut, raw = _merged(ranges), raw or b""
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_kept(raw, cut)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(spans(docs, length), "spans")
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("raw"))
    rows = rows.join(found, "rk", "left").select("doc_id", "raw", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` without the repeated strings; n_chars, where there is one, is counted anew.

    A character that loses some of its bytes goes as a whole.  Null texts stay null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ranges = batch.column("spans__").to_pylist()
            texts = batch.column("text").to_pylist()
            for i, found in enumerate(ranges):
                if found and texts[i]:
                    texts[i] = _kept(texts[i].encode(), _merged(found)).decode(errors="ignore")
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                counts = [o if not f else len(t or "") for o, f, t in zip(batch.column("n_chars").to_pylist(), ranges, texts, strict=True)]
                new["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    found = stored(spans(docs, length), "spans").select(F.col("rk").alias("row_key__"), F.col("spans").alias("spans__"))
    rows = docs.withColumn("row_key__", row_key("doc_id", "text")).join(found, "row_key__", "left").drop("row_key__")
    return rows.mapInArrow(run, docs.schema)
