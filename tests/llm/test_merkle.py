"""Merkle manifest against trees built in plain Python."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import odd

from shardweave.llm import merkle


def h(text):
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        a = at // 8 * 8
        out.append(("".join(level[a:at]), "".join(level[at + 1 : a + 8])))
        at //= 8
    return out


def expected(rows):
    """(leaf, subroot, root, proof) of rows (group, order, leaf)."""
    groups = {}
    for group, order, leaf in rows:
        groups.setdefault(group, []).append((order is not None, order or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, leaf in enumerate(trees[g][0]):
            out.append((leaf, trees[g][-1][0], top[-1][0], siblings(trees[g], at) + siblings(top, k)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "g string, o long, leaf string").repartition(4)
    got = merkle.manifest(df, "g", "o", "leaf", ["g", "o"])
    proof = got.select("leaf", "subroot", "root", "proof", merkle.proof_digest("proof").alias("digest"), merkle.folded("leaf", "proof").alias("found")).collect()
    assert all(r.found == r.root for r in proof)
    assert all(r.digest == h("".join(a + b for a, b in r.proof)) for r in proof)
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in proof) == sorted(expected(rows))


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (64, 65, 7), (512, 513, 63), (1025, 2, 8, 1, 1, 1, 1, 1, 1, 3), (4700,)])
def test_equals_plain_python(spark, sizes):
    draw = random.Random(sum(sizes))
    names = [None, "", "B", "a", "é", "z", "de", "en", "fr", "日"]
    rows = [(names[k], draw.randrange(n * 2), h(f"{k} {i}")) for k, n in enumerate(sizes) for i in range(n)]
    draw.shuffle(rows)
    check(spark, rows)


def test_small_blocks_recurse_often(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    check(spark, [("en", i, h(str(i))) for i in range(700)] + [(f"l{i}", 0, h(f"l{i}")) for i in range(70)])


def test_repeated_rows_and_null_orders(spark):
    check(spark, [("en", 5, h("x"))] * 900 + [("en", None, h("y"))] * 3 + [(None, None, h("z"))])


def test_leaf_and_tampering(spark):
    docs = odd.docs(spark)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    rows = docs.select(*fields, merkle.leaf_digest([F.col(c) for c in fields]).alias("leaf")).collect()
    for r in rows:
        want = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:-1])
        assert r.leaf == h(want)
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest([F.col(c) for c in fields]).alias("leaf"), F.sha2(F.lit("other"), 256).alias("tampered"))
    got = merkle.manifest(leaves, "lang", "doc_id", "leaf", ["doc_id", "tampered"])
    assert got.count() == docs.count()
    assert got.where(merkle.folded("tampered", "proof") == F.col("root")).count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], "g string, o long, leaf string"), "g", "o", "leaf", []).count() == 0
