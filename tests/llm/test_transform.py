import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import odd

from shardweave.llm import transform


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        covered = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered)[: len(r)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_report_equals_brute_force(spark):
    data = odd.rows()
    got = transform.removal_report(odd.docs(spark)).collect()
    want = [(r[0], *b) for r, b in zip(data, brute([r[1] for r in data], 400), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_hot_keys_are_dealt_anew(spark):
    draw = random.Random(2)
    middle = odd.sentence(draw, 40)[:150]
    texts = [odd.sentence(draw, 60) + middle + odd.sentence(draw, 60) for _ in range(30)]
    texts += [texts[0], texts[1][200:], texts[2][:-150], "z" * 900]
    data = [(i, t, None, None, 0, *[None] * 10) for i, t in enumerate(texts)]
    docs = odd.docs(spark, data)
    found = {r.rk: r.spans for r in transform.spans(docs, limit=2).collect()}
    keys = {r.doc_id: r.rk_ for r in docs.select("doc_id", transform.row_key("doc_id", "text").alias("rk_")).collect()}
    for i, (_, removed, runs, _) in enumerate(brute(texts, 400)):
        ranges = transform._merged([s.asDict() for s in found.get(keys[i], [])])
        assert (sum(b - a for a, b in ranges), len(ranges)) == (removed, runs)


def test_text_that_repeats_itself_gives_one_row_a_fragment(spark):
    draw = random.Random(3)
    line, block = "Is onhe. ", odd.sentence(draw, 80)[:330]
    texts = [odd.sentence(draw, 90) + line * 300 + odd.sentence(draw, 5 * i) for i in range(20)]
    texts += [odd.sentence(draw, 90) + line * 60, line * 47, line * 300, line * 300]  # places that occur once in their text too
    texts += [odd.sentence(draw, 90) + (block + str(i)) * 7 + block * 5 + odd.sentence(draw, 20) for i in range(3)]  # several anchors a period
    docs = odd.docs(spark, [(i, t, None, None, 0, *[None] * 10) for i, t in enumerate(texts)])
    keys = {r.doc_id: r.rk_ for r in docs.select("doc_id", transform.row_key("doc_id", "text").alias("rk_")).collect()}
    want = brute(texts, 400)
    for limit in (20_000, 2):
        found = {r.rk: r.spans for r in transform.spans(docs, limit=limit).collect()}
        for i, (_, removed, runs, _) in enumerate(want):
            ranges = transform._merged([s.asDict() for s in found.get(keys[i], [])])
            assert (sum(b - a for a, b in ranges), len(ranges)) == (removed, runs)
    rows = transform.fragments(docs).where("key is not null")
    assert rows.groupBy("rk", "content").count().where("count > 1").isEmpty()
    assert rows.agg({"times": "sum"}).first()[0] > 3 * rows.count()


def test_windows_equal_brute_force_on_any_bytes():
    draw = random.Random(5)
    for _ in range(6):
        base = bytes(draw.choice(b"ab") if draw.random() < 0.5 else draw.randrange(256) for _ in range(1500))
        raws = []
        for _ in range(25):
            a = draw.randrange(900)
            raw = bytearray(base[a : a + draw.randrange(60, 500)])
            if draw.random() < 0.5:
                raw[draw.randrange(len(raw))] ^= 1
            raws.append(bytes(raw))
        raws.append(b"q" * 200)
        count = Counter(r[i : i + 60] for r in raws for i in range(len(r) - 59))
        want = [[i for i in range(len(r) - 59) if count[r[i : i + 60]] > 1] for r in raws]
        assert [w.tolist() for w in transform.repeated_windows(raws, 60, 10)] == want


def test_merged_transform_is_the_transform_of_the_whole():
    draw = np.random.default_rng(8)
    strings = [draw.integers(0, 3, draw.integers(1, 9)) for _ in range(30)]
    rounds = 12

    def built(some):
        symbols = np.concatenate(some).astype(np.int64)
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum([len(s) for s in some]) - 1] = True
        return transform.shard_transform(symbols, ends)

    shards = [strings[:10], strings[10:17], strings[17:]]
    parts = [built(s) for s in shards]
    source, prefix = transform.merge_transforms([t for _, t in parts], rounds)
    merged, at = [], [0] * len(shards)
    suffixes = [[tuple(s[i:]) for s in shard for i in range(len(s))] for shard in shards]
    for s in source:
        k = parts[s][0][at[s]]
        at[s] += 1
        merged.append(suffixes[s][k] if k >= 0 else ())
    assert merged == sorted(merged)

    def common(a, b):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return min(n, rounds)

    for k in range(1, len(merged)):
        if merged[k] != merged[k - 1]:
            assert prefix[k] == common(merged[k], merged[k - 1])


def test_stage_keeps_columns_and_whole_characters(spark):
    text = "é" * 300
    data = [(1, text, "fr", "s", 300, *[None] * 10), (2, "a" + text, "fr", "s", 301, *[None] * 10), (3, None, None, None, None, *[None] * 10)]
    rows = {r.doc_id: r for r in transform.without_repeats(odd.docs(spark, data)).collect()}
    assert rows[1].text == "" and rows[1].n_chars == 0
    assert rows[2].text == "a" and rows[2].n_chars == 1
    assert rows[3].text is None


def test_long_text_is_cut_into_segments(spark, monkeypatch):
    # the constant travels to the tasks with the closure of fragments()
    monkeypatch.setattr(transform, "SEGMENT", 1000)
    draw = random.Random(9)
    a = odd.sentence(draw, 1500)
    data = [(1, a, None, None, 0, *[None] * 10), (2, "start " + a[2000:6000], None, None, 0, *[None] * 10)]
    got = transform.removal_report(odd.docs(spark, data)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute([r[1] for r in data], 400))


def test_empty_table(spark):
    assert transform.removal_report(odd.docs(spark, [])).collect() == []


def test_length_must_fit_the_blocks():
    with pytest.raises(ValueError, match="multiple"):
        transform.repeated_windows([b"abc"], 25, 10)
