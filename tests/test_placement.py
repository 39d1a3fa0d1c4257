import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardweave.functions.hashing import MASK32
from shardweave.operators import placement as P
from shardweave.operators.intervals import first_match
from shardweave.sources.topology import (
    Range,
    Topology,
    TopologyError,
    bound_value,
    equal_hash_topology,
    parse_bound,
    parse_range_list,
    read_topology,
)

TWO = equal_hash_topology("k", 2)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def placed(df, topology, **options):
    return {r.k: r[P.SHARD] for r in P.assign_shard(df, topology, **options).collect()}


def test_published_split_of_ten_thousand_keys(spark):
    df = spark.range(1, 10001).select(F.col("id").alias("k"))
    counts = {r[P.SHARD]: r["n"] for r in P.assign_shard(df, TWO).groupBy(P.SHARD).agg(F.count("*").alias("n")).collect()}
    assert counts == {"shard-0": 4914, "shard-1": 5086}


def test_published_names(spark):
    assert placed(keys(spark, ["alice", "bob", "carol"]), TWO) == {"alice": "shard-0", "bob": "shard-1", "carol": "shard-0"}


def test_null_key_goes_to_the_lowest_range(spark):
    assert placed(keys(spark, [None, "a"]), TWO)[None] == "shard-0"


def test_range_placement(spark):
    rule = Topology("k", (Range("AA", "LZ", "west"), Range("MN", "ZZ", "east")), vindex_type="range")
    found = placed(keys(spark, ["AA", "KR", "MN", "US", "M"]), rule)
    assert found == {"AA": "west", "KR": "west", "MN": "east", "US": "east", "M": None}
    assert P.resolve_key(rule, "KR") == "west"
    with pytest.raises(TopologyError):
        P.resolve_key(Topology("k", (Range("A", "B", "s"),), vindex_type="range"), "Z")


def test_numbers_compare_as_text_in_ranges(spark):
    rule = Topology("k", (Range("1", "2", "low"), Range("3", "99", "high")), vindex_type="range")
    df = spark.range(1, 101).select(F.col("id").alias("k"))
    found = placed(df, rule)
    assert found[100] == "low" and found[10] == "low" and found[9] == "high" and found[25] is None


def test_strict_placement_fails_on_unplaced_keys(spark):
    rule = Topology("k", (Range("A", "B", "s"),), vindex_type="range")
    with pytest.raises(PySparkException, match="no range for key Z"):
        P.assign_shard(keys(spark, ["Z"]), rule, strict=True).collect()


def test_first_listed_range_wins(spark):
    overlapping = Topology("k", (Range("0", "3000000000", "first"), Range("1000", "4294967295", "second")))
    found = P.assign_shard(spark.range(500).select(F.col("id").alias("k")), overlapping)
    from shardweave.functions.hashing import with_key_hash

    wrong = with_key_hash(found, "k").filter(F.expr("__shard <> IF(__hash <= 3000000000, 'first', 'second')"))
    assert wrong.count() == 0
    assert first_match([(5, 9, "a"), (0, 20, "b"), (7, 30, "c")]) == [(0, 4, "b"), (5, 9, "a"), (10, 20, "b"), (21, 30, "c")]


@pytest.mark.parametrize("n", [64, 65, 1000])
def test_many_ranges_use_the_join_and_agree(spark, n):
    rule = equal_hash_topology("k", n)
    sample = [f"key-{i}" for i in range(300)]
    found = placed(keys(spark, sample), rule)
    assert all(found[k] == P.resolve_key(rule, k) for k in sample)


def test_many_text_ranges(spark):
    ranges = tuple(Range(f"{i:03d}", f"{i:03d}~", f"s{i}") for i in range(200))
    rule = Topology("k", ranges, vindex_type="range")
    found = placed(keys(spark, ["000", "1234", "199x", "2"]), rule)
    assert found == {"000": "s0", "1234": "s123", "199x": "s199", "2": None}


def ring(n, vnodes=160):
    return Topology("k", tuple(Range("", "", f"shard-{i}") for i in range(n)), vindex_type="consistent-hash", virtual_nodes=vnodes)


def test_adding_a_shard_moves_a_known_share(spark):
    df = spark.range(4000).select(F.concat(F.lit("tenant-"), "id").alias("k"))
    moves = P.movement(df, ring(3), ring(4)).filter("moved").collect()
    assert sum(r.n_rows for r in moves) == 1161
    assert {r.to_shard for r in moves} == {"shard-3"}


def test_ring_on_the_driver_equals_ring_as_a_job(spark, monkeypatch):
    small = sorted(map(tuple, P.topology_ring(spark, ring(4)).collect()))
    monkeypatch.setattr(P, "MAX_LOCAL_POINTS", 0)
    assert sorted(map(tuple, P.topology_ring(spark, ring(4)).collect())) == small
    assert small[0][0] == 0 and small[-1][1] == MASK32
    assert all(a[1] + 1 == b[0] for a, b in zip(small, small[1:]))


def test_large_ring_lookup_agrees(spark):
    sample = [f"tenant-{i}" for i in range(500)]
    rule = ring(5, 100)
    shards = spark.createDataFrame([(s,) for s in rule.shards], "shard string")
    points = P.ring_points(shards, "shard", 100)
    found = {r.k: r.shard for r in P.ring_lookup(keys(spark, sample), "k", points, "shard").collect()}
    assert found == placed(keys(spark, sample), rule) == {k: P.resolve_key(rule, k) for k in sample}


def test_lookup_placement(spark):
    rule = Topology("K", TWO.ranges, vindex_type="lookup")
    mapping = spark.createDataFrame([("a", "s1")], "key string, shard string")
    assert placed(keys(spark, ["a", "b"]), rule, mapping=mapping) == {"a": "s1", "b": None}
    with pytest.raises(TopologyError):
        P.assign_shard(keys(spark, ["a"]), rule)


def test_column_name_ignores_case_and_must_exist(spark):
    assert placed(keys(spark, ["bob"]), equal_hash_topology("K", 2)) == {"bob": "shard-1"}
    with pytest.raises(P.ShardKeyError):
        P.assign_shard(keys(spark, ["bob"]), equal_hash_topology("other", 2))


def test_bounds(spark):
    assert parse_bound("0x80000000") == 1 << 31 and parse_bound("4294967295") == MASK32
    for text in ("010", "ffffffff", "0b11", "4294967296", "0x100000000", ""):
        with pytest.raises(TopologyError):
            parse_bound(text)
    texts = ["0x0000ffff", "17", "010", "ffffffff", "4294967296", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(bound_value(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [65535, 17, None, None, None, None]


def test_range_list_and_topology_source(spark):
    text = "a:0x00000000:0x7fffffff,b:0x80000000:0xffffffff"
    rows = parse_range_list(spark.createDataFrame([(text,)], "t string"), "t").collect()
    assert [(r.pos, r.shard, r.lo, r.hi) for r in rows] == [(0, "a", "0x00000000", "0x7fffffff"), (1, "b", "0x80000000", "0xffffffff")]
    with pytest.raises(PySparkException, match="shard:lo:hi"):
        parse_range_list(spark.createDataFrame([("a:1",)], "t string"), "t").collect()
    frame = equal_hash_topology("k", 3, keyspace="one").frame(spark)
    assert read_topology(frame, "main", "one") == equal_hash_topology("k", 3, keyspace="one")
    with pytest.raises(TopologyError):
        read_topology(frame, "main", "other")
