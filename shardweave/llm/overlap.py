"""N-gram Jaccard join by T-occurrence search.

Two texts link when ``100 * |common shingles| >= percent * |all shingles|``.  Texts with equal shingle sets
are one class from the start.  Among classes, a pair that links must share one of the first
``n - ceil(n * percent / 100) + 1`` shingles of either text in any fixed order; the order used puts shingles
made of rare words first, so that these prefixes meet almost only where texts are near copies.  Classes that
share such a shingle go to the bucket of the smallest of them.  Before the texts of a bucket are fetched, those
that are too far from every other member go: the parities of a set's hashes, counted in as many bins as the set has
shingles, differ in no more bins than the sets differ in shingles.  Inside a bucket each text is a query against
inverted lists of whole shingle sets, solved by DivideSkip: the short lists are merged by a heap, texts with
enough hits there are looked up in the long lists by binary search until the required overlap is reached or
out of reach.  Every member of a hot bucket meets the members of its own chunk and the bucket's first text;
after a round of components, whatever is not yet connected to the bucket's largest component meets all other
chunks.  Nothing is capped: pairs are left out only when both sides are already in one component.

Null and empty texts have no shingles and link with nothing; so do texts of white space.  Shingles and sets
are compared by 64-bit hashes.  Rows that share an id are kept as rows; the component is the smallest id of
all rows that can be reached.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import Batch, components, pieces, row_key, shingles, stored

#: Texts in one chunk of a bucket; bounds the memory and time of a task's index, not its partners.
CHUNK = 256
#: Words and shingles of all texts are counted by the first bits of their hashes; the counts go round in slices.
#: The counts order shingles, which decides speed only, never the result.
BITS, SLICES = 20, 64
FREQUENT_WORDS = 50_000
FREQUENT_SHINGLES = 100_000
#: Bytes of text whose shingles are held at once.
PIECE = 1 << 18
#: Most bins of a set's parities.
PARITIES = 1 << 15
#: Bits that tell which texts are wanted, and those in one row of their table.
WANTED, WANTED_ROW = 1 << 24, 1 << 15
#: Weight of the long lists in DivideSkip.
MU = 0.001


def least_overlap(n: int, percent: int) -> int:
    """Common shingles a text of ``n`` needs with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted bins of frequent words and shingles of all texts, with weights.  Both lists are bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)

        def counted(h: np.ndarray) -> np.ndarray:
            total[0] += np.bincount(_bins(h), minlength=1 << BITS)
            return np.zeros(len(h), np.float32)

        for batch in pieces(batches, 4 * PIECE):
            h = shingles(Batch(batch.column("text")), width, counted)[0]
            total[1] += np.bincount(_bins(h), minlength=1 << BITS)
        raw = [zlib.compress(part.tobytes(), 1) for part in total.reshape(2 * SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * SLICES, dtype=np.int32)), pa.array(raw, pa.binary())], ["slice", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k >= SLICES)), pa.array(k % SLICES * len(n) + at), pa.array(n[at])], ["gram", "h", "n"]
            )

    counts = docs.select("text").mapInArrow(count, "slice int, raw binary").repartition("slice").mapInArrow(add, "gram boolean, h long, n long")
    counts = stored(counts.where("n > 1"), "frequent")
    out = []
    for gram, most in ((False, FREQUENT_WORDS), (True, FREQUENT_SHINGLES)):
        top = counts.where(F.col("gram") == gram).orderBy(F.desc("n"), "h").limit(most).toPandas().sort_values("h")
        out += [top["h"].to_numpy(np.int64), np.log2(top["n"].to_numpy(np.float32) + 1)]
    return tuple(out)


def _table(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of every bin; 0 for those not listed."""
    out = np.zeros(1 << BITS, np.float32)
    out[bins] = weights
    return out


def parities(mine: np.ndarray) -> bytes:
    """Whether an odd number of the set's hashes falls into each of a power of two of bins."""
    bins = min(max(64, 1 << (len(mine) - 1).bit_length()), PARITIES)
    odd = np.bincount((mine & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row key, set size, class, parities and prefix shingles of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rate, grams, often = shared.value
        of_word, of_shingle = _table(common, rate), 1000 * _table(grams, often)
        for batch in pieces(batches, PIECE):
            texts = Batch(batch.column("text"))
            h, row, weight = shingles(texts, width, lambda w: of_word[_bins(w)])
            weight = weight + of_shingle[_bins(h)]
            at = np.searchsorted(row, np.arange(len(texts) + 1))
            sizes, classes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            prefix, odd = [np.zeros(0, np.int64)] * len(texts), [b""] * len(texts)
            for i in range(len(texts)):
                if at[i] == at[i + 1]:
                    continue
                mine, first = np.unique(h[at[i] : at[i + 1]], return_index=True)
                sizes[i] = n = len(mine)
                classes[i] = np.int64(np.uint64(xxhash.xxh3_64_intdigest(mine.tobytes())).astype(np.int64))
                odd[i] = parities(mine)
                order = np.lexsort((mine, weight[at[i] : at[i + 1]][first]))
                prefix[i] = mine[order[: n - least_overlap(n, percent) + 1]].view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rk"), pa.array(sizes), pa.array(classes), pa.array(odd, pa.binary()), keys],
                ["doc_id", "rk", "n", "cls", "odd", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("rk"))
    return stored(rows.mapInArrow(run, f"doc_id {kind}, rk long, n long, cls long, odd binary, keys array<long>"), "signatures")


def buckets(signed: DataFrame, percent: int) -> DataFrame:
    """(hub, cls): classes that share a prefix shingle and may be near in size, under the first of them.

    Streams over rows sorted by shingle and set size.  A step in size too large for a link ends a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, n_now, hub_now = None, 0, 0
        for batch in batches:
            key, n, cls = (np.asarray(batch.column(c)) for c in ("key", "n", "cls"))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
            new[0] = key_now is None or key[0] != key_now or 100 * n_now < percent * n[0]
            heads = np.flatnonzero(new)
            hub = np.concatenate([[hub_now], cls[heads]])[np.cumsum(new)]
            key_now, n_now, hub_now = key[-1], n[-1], hub[-1]
            other = hub != cls
            pairs = np.unique(np.stack([hub[other], cls[other]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hub", "cls"])

    rows = signed.where("n > 0").select(F.explode("keys").alias("key"), "n", "cls")
    pairs = rows.repartition("key").sortWithinPartitions("key", "n", "cls").mapInArrow(run, "hub long, cls long").distinct()
    pairs = stored(pairs, "bucket-pairs")
    return pairs.union(pairs.select("hub", F.col("hub").alias("cls")).distinct())


class ShingleIndex:
    """Inverted lists over the whole shingle sets of one chunk, texts numbered by ascending set size."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sizes = [len(sets[i]) for i in self.order]
        tokens = np.concatenate([sets[i] for i in self.order])
        ids = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        self.tokens, begin = np.unique(tokens[by], return_index=True)
        self.begin = np.append(begin, len(tokens))
        self.ids = ids[by].tolist()

    def search(self, query: np.ndarray, percent: int, skip, own: bool = False) -> Iterator[int]:
        """Members whose Jaccard similarity with ``query`` reaches ``percent``; ``skip(i)`` leaves one out.

        ``own``: the query is a member too, so lists that hold it alone are of no use.

        DivideSkip over the lists of the query's shingles, cut to the members whose size can qualify.
        """
        n, need = len(query), least_overlap(len(query), percent)
        first, last = bisect_left(self.sizes, need), bisect_left(self.sizes, n * 100 // percent + 1)
        if first >= last or not len(self.tokens):
            return
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        at = at[self.begin[at + 1] - self.begin[at] > own]
        if len(at) < need:
            return
        lists = []
        for k in at.tolist():
            a = bisect_left(self.ids, first, self.begin[k], self.begin[k + 1])
            b = bisect_left(self.ids, last, a, self.begin[k + 1])
            if b - a > own:
                lists.append((a, b))
        if len(lists) < need:
            return
        lists.sort(key=lambda x: x[1] - x[0])
        longest = lists[-1][1] - lists[-1][0]
        # the least overlap holds for every partner, so more than need - 1 long lists would miss some
        n_long = min(max(int(need / (MU * math.log2(longest + 1) + 1)), 0), need - 1, len(lists))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = heapq.merge(*[self.ids[a:b] for a, b in short])
        found, count = -1, 0
        for i in [*merged, -1]:
            if i == found:
                count += 1
                continue
            if found >= 0 and count >= need - n_long and not skip(self.order[found]):
                # overlap >= percent / (100 + percent) * (n + m)
                total = -(-percent * (n + self.sizes[found]) // (100 + percent))
                left = n_long
                for a, b in long:
                    if count >= total or count + left < total:
                        break
                    p = bisect_left(self.ids, found, a, b)
                    count += p < b and self.ids[p] == found
                    left -= 1
                if count >= total:
                    yield self.order[found]
            found, count = i, 1


def _may_link(n: np.ndarray, odd: list[bytes], query: np.ndarray, indexed: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of one task differ from another one, query from indexed, in few enough bins for a link."""
    out = np.zeros(len(n), bool)
    length = np.array([len(x) for x in odd])
    maps = {k: np.flatnonzero(length == k) for k in np.unique(length).tolist()}
    for small, here in maps.items():
        mine = np.frombuffer(b"".join(odd[i] for i in here), np.uint64).reshape(len(here), -1)
        for large, there in maps.items():
            if large < small:
                continue
            other = np.frombuffer(b"".join(odd[i] for i in there), np.uint64).reshape(len(there), -1, small // 8)
            other = np.bitwise_xor.reduce(other, axis=1)  # more bins fold to fewer
            for i, bins in zip(here, mine):
                total = n[i] + n[there]
                apart = np.maximum(np.bitwise_count(other ^ bins).sum(1, dtype=np.int64), np.abs(n[i] - n[there]))
                near = apart <= total - 2 * -(-percent * total // (100 + percent))
                near &= (there != i) & ((query[i] & indexed[there]) | (indexed[i] & query[there]))
                out[i] |= near.any()
                out[there[near]] = True
    return out


def near_enough(tasks: DataFrame, percent: int) -> DataFrame:
    """The rows of ``tasks`` that may link with another row of their task (hub, i, j), by the parities of their sets."""
    names = ["hub", "i", "j", "cls", "rk", "query", "indexed", "comp"]

    def whole(rows: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        n, query, indexed = (rows.column(c).to_numpy() for c in ("n", "query", "indexed"))
        odd, kept = rows.column("odd").to_pylist(), np.zeros(len(rows), bool)
        for s, e in zip([0, *ends], [*ends, len(rows)]):
            if e - s > 1:
                kept[s:e] = _may_link(n[s:e], odd[s:e], query[s:e], indexed[s:e], percent)
        yield from rows.select(names).filter(pa.array(kept)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            at = np.stack([np.asarray(rows.column(c)) for c in ("hub", "i", "j")])
            ends = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()
            rest = rows.slice(ends[-1]) if ends else rows
            if ends:
                yield from whole(rows.slice(0, ends[-1]), ends[:-1])
        if rest is not None:
            yield from whole(rest, [])

    rows = tasks.select(*names, "n", "odd").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return stored(rows.mapInArrow(run, tasks.select(*names).schema), "near-enough")


def wanted_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(rk, text) of all texts that ``rows`` name by rk and of few others, so that a join moves little else.

    A table of bits of fixed size tells by hash which texts may be wanted.
    """
    bit = F.pmod(F.col("rk"), F.lit(WANTED))
    place = [F.floor(bit / WANTED_ROW).alias("row"), (bit % WANTED_ROW).alias("bit")]
    bits = rows.select(*place).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    texts = docs.select(row_key("doc_id", "text").alias("rk"), "text").select("rk", "text", *place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # at most WANTED / WANTED_ROW rows, whatever the corpus
    found = texts.join(F.broadcast(bits), "row").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0)
    return found.select("rk", "text")


def _shingle_sets(texts: pd.Series, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for start in range(0, len(texts), 64):
        part = Batch(pa.array(texts.iloc[start : start + 64], pa.string()))
        h, row, _ = shingles(part, width)
        at = np.searchsorted(row, np.arange(len(part) + 1))
        out += [np.unique(h[at[i] : at[i + 1]]) for i in range(len(part))]
    return out


def _search(tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links found in every task: rows of (task, cls, query, indexed, comp, text)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["cls"]).reset_index(drop=True) if not group["cls"].is_unique else group.reset_index(drop=True)
        sets = _shingle_sets(group["text"], width)
        keep = [i for i in np.flatnonzero(group["indexed"]) if len(sets[i])]
        if not keep:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        index = ShingleIndex([sets[i] for i in keep])
        root = list(range(len(group)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        seen: dict[int, int] = {}
        for i, comp in enumerate(group["comp"]):
            if comp is not None and not pd.isna(comp):
                root[top(i)] = top(seen.setdefault(comp, i))
        cls, a, b, members = group["cls"].to_numpy(), [], [], set(keep)
        for i in np.flatnonzero(group["query"]):
            if not len(sets[i]):
                continue
            for j in index.search(sets[i], percent, lambda j, i=i: top(keep[j]) == top(i), i in members):
                root[top(keep[j])] = top(i)
                a.append(cls[i])
                b.append(cls[keep[j]])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return tasks.groupBy("hub", "i", "j").applyInPandas(run, "a long, b long")


def _sized(members: DataFrame) -> DataFrame:
    """Members with the first class of their bucket and the number of chunks it needs; lone members go."""
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"), F.min("cls").alias("head")).where("size > 1")
    return members.join(sizes.select("hub", "head", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "hub")


def links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links between classes that connect every pair of linked classes."""
    one = signed.where("n > 0").groupBy("cls").agg(F.min("rk").alias("rk"), F.min("n").alias("n"), F.min("odd").alias("odd"))
    members = stored(_sized(buckets(signed, percent)).join(one, "cls"), "bucket-members")
    # Sizes that link are at most one band apart, so a large bucket becomes one for each two neighbouring bands.
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    cut = members.where("chunks > 1").withColumn("band", F.explode(F.array(band, band + 1)))
    cut = _sized(cut.select(F.xxhash64("hub", "band").alias("hub"), "cls", "rk", "n", "odd"))
    columns = ["hub", "cls", "rk", "n", "odd", "head", "chunks", F.pmod(F.xxhash64("cls", "hub"), F.col("chunks")).cast("int").alias("i")]
    members = stored(members.where("chunks = 1").select(*columns).union(cut.select(*columns)), "bucket-chunks")

    def with_texts(rows: DataFrame) -> DataFrame:
        """The texts of these rows' classes, one of each."""
        keys = stored(rows.select("rk", "cls").distinct(), "text-keys")
        return wanted_texts(docs, keys).join(keys, "rk").select("cls", "text")

    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    heads = members.where("head = cls and chunks > 1").select("hub", "cls", "rk", "n", "odd", every.alias("i"))
    first = members.where("head <> cls or chunks = 1").select("hub", "cls", "rk", "n", "odd", "i").union(heads)
    flags = [F.lit(True).alias("query"), F.lit(True).alias("indexed"), F.lit(None).cast("long").alias("comp")]
    first = near_enough(first.select("*", F.col("i").alias("j"), *flags), percent)
    found = stored(_search(first.join(wanted_texts(docs, first), "rk").select("hub", "i", "j", "cls", "text", "query", "indexed", "comp"), width, percent), "links-1")
    hot = stored(members.where("chunks > 1"), "hot-buckets")
    if hot.isEmpty():
        return found
    comps = components(found)
    hot = hot.join(comps, hot["cls"] == comps["node"], "left").withColumn("comp", F.coalesce("component", "cls"))
    hot = stored(hot.select("hub", "cls", "rk", "n", "odd", "i", "chunks", "comp"), "hot-components")
    per = hot.groupBy("hub", "comp").agg(F.count("*").alias("size"))
    main = per.groupBy("hub").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    hot = stored(hot.join(main, "hub"), "hot-main")
    loose = hot.where("comp <> main")
    if loose.isEmpty():
        return found
    # every loose text meets each other chunk of its bucket once: as query there, with the chunk as index
    asked = loose.select("hub", "i", every.alias("j"), "cls", "rk", "n", "odd", "comp").where("i <> j")
    where = asked.select("hub", "i", "j").distinct()
    index = where.join(hot.select("hub", F.col("i").alias("j"), "cls", "rk", "n", "odd", "comp"), ["hub", "j"])
    rows = asked.select("hub", "i", "j", "cls", "rk", "n", "odd", "comp", F.lit(True).alias("query"), F.lit(False).alias("indexed")).union(
        index.select("hub", "i", "j", "cls", "rk", "n", "odd", "comp", F.lit(False).alias("query"), F.lit(True).alias("indexed"))
    )
    rows = near_enough(rows, percent)
    rest = _search(rows.join(with_texts(rows), "cls").select("hub", "i", "j", "cls", "text", "query", "indexed", "comp"), width, percent)
    return found.union(stored(rest, "links-2"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row key rk, n_shingles and component_id of every row of ``docs``."""
    signed = signatures(docs, width, percent)
    comps = components(links(docs, signed, width, percent))
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    nodes = classes.join(comps, classes["cls"] == comps["node"], "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = stored(nodes.join(least, "comp").select("cls", "component_id"), "class-components")
    rows = signed.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    return rows.join(ids, "cls", "left").select("doc_id", "rk", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.  Rows without words all stay.

    Rows that repeat that document with its id stay with it, as do the rows of a component without any id.
    """
    rows = jaccard_components(docs, width, percent)
    dropped = rows.where("n_shingles > 0 and not doc_id <=> component_id").select("rk").distinct()
    key = "row_key__"
    return docs.withColumn(key, row_key("doc_id", "text")).join(dropped.withColumnRenamed("rk", key), key, "left_anti").drop(key)
