import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from shardweave.functions import hashing as H


def plain_murmur3(data: bytes) -> int:
    mask, h = 0xFFFFFFFF, 0

    def scramble(k):
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = (((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64) & mask
    h ^= scramble(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def plain_fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


PLAIN = {"murmur3": plain_murmur3, "fnv": plain_fnv, "crc32": zlib.crc32}


def test_known_values():
    known = {"": 0, "1": 0x9416AC93, "42": 0xBC58A436, "user-42": 0xB972DAD0, "abcd": 0x43ED676A}
    assert {k: H.hash_value("murmur3", k) for k in known} == known
    assert H.hash_value("fnv", "1") == 0x340CA71C
    assert H.hash_value("fnv", "42") == 0x87E38583


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), min_size=1, max_size=20))
def test_batches_match_plain_hashes(texts):
    batch = pa.array(texts, pa.string())
    for name in ("murmur3", "fnv"):
        assert H.hash_batch(name, batch).tolist() == [PLAIN[name]((t or "").encode()) for t in texts]
        # A sliced batch has an offset into its buffers.
        assert H.hash_batch(name, batch[1:]).tolist() == [PLAIN[name]((t or "").encode()) for t in texts[1:]]


def test_columns_match_plain_hashes(spark):
    texts = ["", "a", "alice", "x" * 23, "x" * 100, "héllo wörld", "日本語テキスト", None]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    for name in H.HASH_FUNCTIONS:
        rows = H.with_key_hash(df, "k", name).collect()
        assert [r["__hash"] for r in rows] == [PLAIN[name]((r.k or "").encode()) for r in rows]


def test_numbers_hash_as_text(spark):
    rows = H.with_key_hash(spark.range(-5, 2000).select(F.col("id").cast("int").alias("k")), "k").collect()
    assert all(r["__hash"] == plain_murmur3(str(r.k).encode()) for r in rows)


def test_other_types_are_refused(spark):
    for sql in ("1.5D", "current_timestamp()", "1.50"):
        with pytest.raises(H.KeyTypeError):
            H.with_key_hash(spark.sql(f"SELECT {sql} AS k"), "k")
    with pytest.raises(ValueError):
        H.hash_text("md5", F.lit("x"))
