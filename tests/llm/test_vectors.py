import numpy as np
import pytest
from pyspark.sql import functions as F

from shardweave.llm import neighbours, quantise, shared

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cls string, n string, cell string, rank string"


def vectors(seed=1, n=500, dim=16):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    x[100:160] = x[100] + 0.05 * draw.normal(size=(60, dim))
    x[200:230] = x[200]
    x[300:320] = x[300:301] * np.linspace(0.5, 2, 20)[:, None]
    out = [(int(i), v.astype(np.float32).tolist(), int(i // 50 % 3), *["?"] * 5) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    out += [(1000 + i, v, 1, *["?"] * 5) for i, v in enumerate(odd)]
    out += [(2000, out[200][1], None, *["?"] * 5), out[5]]
    return out


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def brute_links(rows, least):
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    live = [i for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    for i in live:
        for j in live:
            a, b = rows[i], rows[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[i] += 1
                    n[j] += 1
                    root[top(i)] = top(j)
    comp = {}
    for i, r in enumerate(rows):
        comp[top(i)] = min(comp.get(top(i), r[0]), r[0])
    return sorted((r[0], n[i], comp[top(i)], r[0] == comp[top(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("least", "members"), [(0.98, 2048), (0.9, 16)])
def test_links_equal_brute_force(spark, monkeypatch, least, members):
    monkeypatch.setattr(quantise, "MEMBERS", members)
    monkeypatch.setattr(quantise, "QUERIES", members)
    monkeypatch.setattr(quantise, "LIST_SIZE", 60)
    rows = vectors()
    got = quantise.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), least).collect()
    assert sorted(tuple(r) for r in got) == brute_links(rows, least)


def test_links_of_no_rows(spark):
    assert quantise.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, 1, *["?"] * 5)], SCHEMA)
    assert [tuple(r) for r in quantise.near_copies(none).collect()] == [(1, 0, 1, True)]


def test_table_distances_are_distances_to_the_coded_vector():
    draw = np.random.default_rng(7)
    sample = draw.normal(size=(400, 12))
    book = quantise.Codebook.of(sample / np.linalg.norm(sample, axis=1)[:, None], 400)
    rest = draw.normal(size=(30, 12))
    codes = book.codes(rest)
    coded = np.hstack([b[codes[:, j]] for j, b in enumerate(book.books)])
    assert np.allclose(book.distances(rest[:5], codes), ((rest[:5, None] - coded[None]) ** 2).sum(2))
    assert np.allclose(book.error(rest, codes), np.linalg.norm(rest - coded, axis=1))


@pytest.mark.parametrize(("aim", "cell"), [(1500, 8000), (60, 40)])
def test_neighbours_recall(spark, monkeypatch, aim, cell):
    monkeypatch.setattr(neighbours, "AIM", aim)
    monkeypatch.setattr(neighbours, "CELL", cell)
    rows = vectors()
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0).collect()
    live = {r[0]: np.array(r[1], float) for r in rows if usable(r[1]) and len(r[1]) == 16}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in live:
        if q % 20:
            continue
        want = sorted(((-float(live[q] @ v), i) for i, v in live.items() if i != q))[:20]
        mine = sorted(found.pop(q))
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert all(abs(live[q] @ live[i] - s) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in want})
        total += len(want)
    assert hits / total >= 0.9
    assert set(found) <= {1000, 1007}


def test_queries_hold_more_until_probes_find_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 10)
    x = np.random.default_rng(3).normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, embedding array<double>").coalesce(1)
    queries = rows.where("node % 15 = 0").select(F.col("node").alias("query"), "node", "embedding")
    index, entries = neighbours.build(rows)
    # ten held results cannot be nineteen of twenty neighbours
    assert neighbours._held(index, entries, rows, queries, 20) > 10


def test_search_in_turns_keeps_only_tables_that_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "fresh_path", lambda spark, label: f"{tmp_path}/{label}-{len(made)}" if made.append(label) is None else "")
    for name, value in (("AIM", 60), ("TURN", 2500), ("QUERIES", 25)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    made = []
    x = np.random.default_rng(4).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(2)
    got = neighbours.nearest_neighbours(rows, F.col("vec_id") % 12 == 0).collect()
    left = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    # the graph, the vectors and what was met on the way were tables as well
    assert {"graph", "nodes"} <= set(made) and not {"graph", "nodes", "cells", "met", "meet", "messages", "vectors"} & set(left)
    assert left.count("beams") < made.count("beams") / 2
    assert spark.conf.get(shared.Scratch.CLEANUP) == "false"
    found = {(r.query_id, r.vec_id) for r in got}
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {(q, int(v)) for q in range(0, 600, 12) for v in np.argsort(-score[q])[:20]}
    assert len(got) == len(found) == len(want) and len(found & want) >= 0.95 * len(want)


def test_messages_are_for_neighbours_of_open_nodes_that_are_not_held(spark):
    near = {1: [2, 3, 4], 2: [5, 1], 3: [6, 7, 5]}
    cell = {n: 10 + n % 2 for n in range(1, 8)}
    index = [(n, [1.0, float(n)], cell[n], near.get(n), near.get(n) and [cell[m] for m in near[n]]) for n in cell]
    index = spark.createDataFrame(index, "node long, embedding array<double>, cell long, near array<long>, at array<long>")
    beams = spark.createDataFrame(
        [(1, [(9.0, 1, False), (8.0, 3, True), (7.0, 2, True)]), (2, [(4.0, 2, True)]), (3, [(9.0, 1, False)])],
        "query long, beam array<struct<score double, node long, open boolean>>",
    )
    queries = index.where("node <= 3").select(F.col("node").alias("query"), "node", "embedding")
    got = {(r.query, r.cell): (sorted(r.targets), r.floor, r.embedding) for r in neighbours._messages(beams, index, queries, 3).collect()}
    low = float("-inf")
    assert got == {(1, 11): ([5, 7], 7.0, [1.0, 1.0]), (1, 10): ([6], 7.0, [1.0, 1.0]), (2, 11): ([1, 5], low, [1.0, 2.0])}


def test_neighbours_of_few_or_no_rows(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    three = spark.createDataFrame([(i, [1.0, float(i)], 1, *["?"] * 5) for i in range(3)], SCHEMA)
    got = neighbours.nearest_neighbours(three, F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


def test_small_labels_are_one_list_however_many_there_are(spark):
    draw = np.random.default_rng(8)
    rows = [(i, i % 12, draw.normal(size=8).tolist()) for i in range(3600)]
    classes = spark.createDataFrame(rows, "cls long, label int, embedding array<double>").selectExpr("*", "1L as n", "8 as dim")
    assert {r.lists for r in quantise._lists(classes).select("lists").distinct().collect()} == {1}
    # the largest label alone has lists, and every vector of another label is looked up once
    more = [(i, 0, draw.normal(size=8).tolist()) for i in range(3600, 5000)]
    classes = classes.union(spark.createDataFrame(more, "cls long, label int, embedding array<double>").selectExpr("*", "1L as n", "8 as dim"))
    listed = quantise._lists(classes)
    assert {tuple(r) for r in listed.selectExpr("label = 0", "lists").distinct().collect()} == {(True, 4), (False, 1)}
    sample = np.array([r[2] for r in rows])
    books = {(8, k): quantise.Codebook.of(sample / np.sqrt((sample**2).sum(1))[:, None], k * quantise.LIST_SIZE) for k in (1, 4)}
    dealt = quantise._deal(listed.select("label", "cls", "n", "embedding", "dim", "lists"), books, 0.2)
    assert dealt.where("label <> 0").count() == 3300


def test_start_graph_leaves_few_neighbours_to_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AIM", 60)
    made = []
    kept = neighbours._kept
    monkeypatch.setattr(neighbours, "_kept", lambda edges: made.append(kept(edges)) or made[-1])
    x = np.random.default_rng(9).normal(size=(1500, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, embedding array<double>").coalesce(1)
    neighbours.build(nodes)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    true = np.argsort(-score, axis=1)[:, : neighbours.DEGREE]
    start = {r.node: {e.near for e in r.edges} for r in made[0].collect()}
    assert sum(len(start[i] & set(t)) for i, t in enumerate(true.tolist())) >= 0.95 * true.size
