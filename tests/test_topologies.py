import pytest
from pyspark.sql import functions as F

from shardweave.operators import reshard as R
from shardweave.operators import topologies as T
from shardweave.sources.topology import Range, equal_hash_topology

SCHEMA = "cluster string, keyspace string, pos int, lo long, hi long, shard string"


def ranges(spark, spec):
    """{keyspace: [(lo, hi), …]}"""
    rows = [("c", ks, i, lo, hi, f"s{i}") for ks, list_ in spec.items() for i, (lo, hi) in enumerate(list_)]
    return spark.createDataFrame(rows, SCHEMA)


def test_overlaps_and_gaps(spark):
    big = 1 << 24
    df = ranges(
        spark,
        {
            "good": [(0, 9), (10, 19), (20, 4294967295)],
            "overlap": [(0, 10 * big), (big, big + 1), (9 * big, 11 * big)],
            "gap": [(20, 30), (0, 9), (12 * big, 13 * big)],
            "inverted": [(9, 3)],
        },
    )
    found = {(r.keyspace, r.pos, r.problem) for r in T.find_overlaps(df).collect()}
    assert found == {("overlap", 1, "overlap"), ("overlap", 2, "overlap"), ("inverted", 0, "inverted")}
    gaps = {(r.keyspace, r.gap_lo, r.gap_hi) for r in T.find_gaps(df).collect()}
    assert gaps == {("gap", 10, 19), ("gap", 31, 12 * big - 1)}


def test_split_plans(spark):
    sources = ranges(spark, {"ok": [(0, 99)], "short": [(0, 99)], "hole": [(0, 99)], "merge": [(0, 49), (50, 99)]})
    targets = ranges(spark, {"ok": [(50, 99), (0, 49)], "short": [(0, 49), (50, 98)], "hole": [(0, 48), (50, 99)], "merge": [(0, 99)]})
    verdicts = {r.keyspace: (r.covered, r.valid) for r in T.check_split_plans(sources, targets).collect()}
    assert verdicts == {"ok": (True, True), "short": (False, False), "hole": (True, False), "merge": (True, True)}


def test_midpoints_and_names(spark):
    df = ranges(spark, {"a": [(0, 0xFFFFFFFF)], "b": [(0, 0x7FFFFFFF)], "c": [(7, 7)], "d": [(8, 2)], "e": [(4, 5)]})
    halves = {r.keyspace: (r.lo0, r.hi0, r.lo1, r.hi1, r.error) for r in T.split_midpoint(df).collect()}
    assert halves["a"] == ("0x00000000", "0x7fffffff", "0x80000000", "0xffffffff", None)
    assert halves["b"] == ("0x00000000", "0x3fffffff", "0x40000000", "0x7fffffff", None)
    assert halves["c"][4] == "single key" and halves["d"][4] == "inverted"
    assert halves["e"][:4] == ("0x00000004", "0x00000004", "0x00000005", "0x00000005")
    names = {r.shard for r in T.split_targets(df.filter("keyspace = 'b'")).collect()}
    assert names == {"as897d1ca", "as897d1cb"}


def test_upsert_counts_generations(spark):
    cols = "cluster string, keyspace string, range_lo string, range_hi string, shard_id string, vindex_type string"
    first = spark.createDataFrame([("c", "k", "0", "9", "s0", "hash")], cols)
    empty = spark.createDataFrame([], cols + ", generation long, updated_at long")
    one = T.metadata_upsert(empty, first, F.lit(1).cast("long"))
    again = spark.createDataFrame(
        [("c", "k", "0", "9", "s1", "hash"), ("c", "k", "10", "19", "s2", "hash"), ("c", "k", "20", "29", "", "hash"), ("c", "k", None, "39", "s3", "hash")],
        cols,
    )
    two = T.metadata_upsert(one, again, F.lit(2).cast("long"))
    rows = [(r.range_lo, r.shard_id, r.generation, r.updated_at) for r in T.metadata_list(two, "c", "k").collect()]
    assert rows == [("0", "s1", 2, 2), ("10", "s2", 1, 2)]
    left = T.metadata_delete(two, again.limit(1))
    assert [r.range_lo for r in left.collect()] == ["10"]


def test_driver_check_agrees_with_table_check(spark):
    four = equal_hash_topology("k", 4)
    good = R.split_move(four, "shard-3", ("x", "y"))
    assert [(r.lo, r.hi) for r in good.targets] == [("0xc0000000", "0xdfffffff"), ("0xe0000000", "0xffffffff")]
    R.moved_topology(four, good)
    bad = [
        R.Move(("shard-3",), (Range("0xc0000000", "0xdfffffff", "x"), Range("0xe0000001", "0xffffffff", "y"))),
        R.Move(("shard-3",), (Range("0xc0000000", "0xe0000000", "x"), Range("0xe0000000", "0xffffffff", "y"))),
        R.Move(("shard-3",), (Range("0xc0000000", "0xfffffffe", "x"),)),
        R.Move(("shard-3",), (Range("0xffffffff", "0xc0000000", "x"),)),
        R.Move(("shard-1", "shard-3"), (Range("0x40000000", "0xffffffff", "x"),)),
        R.Move(("shard-9",), (Range("0x00000000", "0xffffffff", "x"),)),
        R.Move(("shard-3",), (Range("0xc0000000", "0xffffffff", "shard-0"),)),
    ]
    for move in bad:
        with pytest.raises(R.SplitRefused):
            R.moved_topology(four, move)


def test_placement_drift(spark):
    spec = spark.createDataFrame(
        [("a", "z1", "n1"), ("b", "z1", "n1"), ("c", "", "n2"), ("d", "z1", "")], "shard_id string, preferred_zone string, preferred_node string"
    )
    seen = spark.createDataFrame(
        [("a", "z2", "n9", False), ("c", "z2", "n2", True), ("d", "", "n1", True), ("x", "z1", "n1", True)],
        "shard_id string, zone string, node string, ready boolean",
    )
    named = spark.createDataFrame([("a",), ("lost",)], "shard string")
    found = {(r.shard_id, r.reason) for r in T.placement_drift(spec, seen, named).collect()}
    assert found == {
        ("a", "ZoneMismatch"), ("a", "NodeMismatch"), ("a", "NotReady"), ("b", "Missing"), ("x", "Extra"), ("lost", "RangeUncovered"),
    }
