import os

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from shardweave.llm import overlap
from shardweave.llm.shared import components, table
from test_overlap import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 9), (9, 8), (20, 21), (21, 20), (30, 30), (7, 100), (100, 50), (50, 8)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 7), 1), **dict.fromkeys((7, 8, 9, 10, 50, 100), 7), 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stages_on_their_own_input(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF_DIR)
        if name == "near-duplicates":
            data = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in rows.collect()} == {c for _, _, c in brute(data, 5, 80)}
        if name == "packing":
            assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
            assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert rows.columns == columns
        assert 0 < rows.count()
        docs = overlap.stored(rows, "stage")


def test_stages_without_rows(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


@pytest.mark.parametrize("name", [*(n for n in sorted(entry.queries()) if n.startswith("op")), "pipeline"])
def test_queries_return_their_rows(spark, name):
    rows = entry.queries()[name](spark, SF_DIR)
    source = {"op1": "pages", "op3": "embeddings"}.get(name.split("_")[0], "documents")
    n = table(spark, SF_DIR, source).count()
    if name.split("_")[0] in ("op2", "op5", "op7", "pipeline"):
        assert rows.count() > 0
    else:
        assert rows.count() == n
