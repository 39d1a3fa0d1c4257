import random
import re

import numpy as np
import pytest

import odd

from shardweave.llm import overlap


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(data, width, percent):
    sets = [shingle_set(r[1], width) for r in data]
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(data)), key=str)


def test_frequencies_count_every_text(spark):
    # more texts than the sample of 8,000 that was counted before
    docs = spark.range(9000, numPartitions=5).selectExpr("id as doc_id", "if(id % 3 = 0, 'one two three', concat('one two ', id)) as text")
    words, rate, grams, often = overlap.frequent(docs.union(docs.limit(1).selectExpr("doc_id", "cast(null as string)")), 3)
    assert len(words) == len(rate) and len(grams) == len(often)
    assert sorted(np.round(2 ** rate.astype(float) - 1).astype(int))[-3:] == [3000, 9000, 9000]
    assert np.round(2 ** often.max().astype(float) - 1) == 3000


@pytest.mark.parametrize(("width", "percent", "chunk"), [(3, 90, 256), (5, 80, 256), (2, 30, 2)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, chunk):
    monkeypatch.setattr(overlap, "CHUNK", chunk)
    got = overlap.jaccard_components(odd.docs(spark), width, percent).drop("rk").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd.rows(), width, percent)


def test_hot_bucket_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK", 4)
    draw = random.Random(4)
    base = odd.sentence(draw, 120).split()
    data = []
    for i in range(40):
        words = list(base)
        for _ in range(draw.randrange(0, 5)):
            words[draw.randrange(len(words))] = odd.sentence(draw, 1)
        data.append((i, " ".join(words), "en", "s", 0, *[None] * 10))
    got = overlap.jaccard_components(odd.docs(spark, data), 3, 90).drop("rk").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data, 3, 90)


def test_keep_first(spark):
    docs = odd.docs(spark)
    kept = overlap.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute(odd.rows(), 5, 80) if n}
    rows = kept.collect()
    assert {r.doc_id for r in rows if r.text and r.text.split()} == want
    empty = [r for r in odd.rows() if not (r[1] or "").split()]
    assert sum(not (r.text or "").split() for r in rows) == len(empty)


def test_empty_table(spark):
    assert overlap.jaccard_components(odd.docs(spark, [])).collect() == []


def test_search_needs_no_partner_beyond_the_overlap():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 30))).astype(np.uint64) for _ in range(80)]
    index = overlap.ShingleIndex(sets)
    for percent in (20, 50, 90, 100):
        for i, q in enumerate(sets):
            got = set(index.search(q, percent, lambda j, i=i: j == i, True))
            want = {j for j, s in enumerate(sets) if j != i and 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))}
            assert got == want


def test_texts_far_from_all_others_of_their_bucket_are_not_fetched(spark):
    draw = np.random.default_rng(6)
    sets = []
    for n in [1, 2, 3, 30, 60, 70, 380, 500, 530, 1000, 1100]:
        base = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
        for k in range(5):  # copies that lack up to a third, and one stranger of the size
            sets.append(np.sort(draw.choice(base, max(1, n - n * k // 12), replace=False)))
        sets.append(np.unique(draw.integers(0, 1 << 64, n, np.uint64)))
    rows = [(h, 0, 0, i, i, len(s), overlap.parities(s), True, True, None) for h in (1, 2) for i, s in enumerate(sets)]
    rows.append((3, 0, 0, 0, 0, len(sets[0]), overlap.parities(sets[0]), True, True, None))
    schema = "hub long, i int, j int, cls long, rk long, n long, odd binary, query boolean, indexed boolean, comp long"
    tasks = spark.createDataFrame(rows, schema).repartition(4)
    for percent in (30, 80, 90, 100):
        near = {
            i for i, s in enumerate(sets) for j, t in enumerate(sets)
            if i != j and 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))
        }
        got = [(r.hub, r.cls) for r in overlap.near_enough(tasks, percent).collect()]
        assert len(got) == len(set(got)) and {h for h, _ in got} == {1, 2}
        assert {(h, i) for h in (1, 2) for i in near} <= set(got)
        if percent >= 80:
            strangers = [i for i in range(5, len(sets), 6) if len(sets[i]) > 100]
            assert not {(h, i) for h in (1, 2) for i in strangers} & set(got)
    # neither two queries nor two indexed rows meet
    apart = spark.createDataFrame([(*r[:7], r[3] % 2 == 0, False, None) for r in rows], schema)
    assert overlap.near_enough(apart, 30).collect() == []


def test_all_wanted_texts_are_fetched_and_few_others(spark):
    docs = spark.range(20_000, numPartitions=3).selectExpr("id as doc_id", "concat('text ', id) as text")
    rows = docs.where("doc_id % 40 = 1").select(overlap.row_key("doc_id", "text").alias("rk"))
    got = [r.text for r in overlap.wanted_texts(docs, rows.union(rows)).collect()]
    assert {f"text {i}" for i in range(1, 20_000, 40)} <= set(got)
    assert len(got) == len(set(got)) < 520
    assert overlap.wanted_texts(docs, rows.limit(0)).collect() == []
