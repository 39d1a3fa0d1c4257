import pytest
from pyspark.sql import functions as F

from shardweave.operators import workload as W
from shardweave.operators.placement import resolve_key
from shardweave.sources.topology import equal_hash_topology

RULE = equal_hash_topology("tenant_id", 4, reference_tables=("Countries",))


def log(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "stmt_id long, sql string")


def feature(spark, texts, fn):
    return [r.x for r in log(spark, texts).select("stmt_id", fn(F.col("sql")).alias("x")).orderBy("stmt_id").collect()]


def test_key_by_column(spark):
    cases = {
        "SELECT * FROM t WHERE tenant_id = 'acme'": "acme",
        "select 1 from t where a=1 and TENANT_ID='t9'": "t9",
        "UPDATE t SET x = 1 WHERE tenant_id=-42": "-42",
        "SELECT * FROM t WHERE other = 'x'": None,
        "SELECT * FROM t WHERE tenant_id = ''": None,
        "SELECT * FROM t WHERE my_tenant_id = 'x'": None,
        "SELECT 1 FROM t WHERE note = 'tenant_id = 5'": None,
        "UPDATE t SET note = 'tenant_id = 5' WHERE tenant_id = 9": "9",
        "SELECT 1 FROM t /* tenant_id = 3 */ WHERE tenant_id = 4 -- tenant_id = 5": "4",
        "SELECT 1 FROM t WHERE \"Tenant_Id\" = 'it''s'": "it's",
        "SELECT 1 FROM t WHERE t.tenant_id = 1.5": "1.5",
    }
    assert feature(spark, list(cases), lambda s: W.key_by_column(s, "tenant_id")) == list(cases.values())


def test_first_literal(spark):
    cases = {"INSERT INTO t VALUES ('k1', 2)": "k1", "SELECT 1 FROM t WHERE id = 'k2'": "k2", "SELECT 1": None, "SELECT 1 FROM t WHERE id = 5": None}
    assert feature(spark, list(cases), W.first_literal) == list(cases.values())


def test_insert_keys(spark):
    cases = {
        "INSERT INTO t (a, tenant_id) VALUES (1, 'x')": ("x", ["x"]),
        "insert into s.t (tenant_id,a) values (7, 1), ('y', 2) on conflict do nothing": ("7", ["7", "y"]),
        "INSERT INTO t (tenant_id) VALUES ('a'), (DEFAULT)": ("a", None),
        "INSERT INTO t (a) VALUES (1)": (None, None),
        "INSERT INTO t (a, tenant_id) VALUES (1)": (None, None),
        "INSERT INTO t (tenant_id) VALUES ('')": (None, None),
        "INSERT INTO t (a, tenant_id) VALUES ('x, (y)', 'k,1'), (f(g(1, 2), 3), -2) RETURNING a": ("k,1", ["k,1", "-2"]),
        "INSERT INTO t (a, tenant_id) VALUES (1, 'a') /* , (2, 'b') */ ON CONFLICT (a) DO UPDATE SET a = (3)": ("a", ["a"]),
        "SELECT 1": (None, None),
    }
    assert feature(spark, list(cases), lambda s: W.insert_key(s, "tenant_id")) == [c[0] for c in cases.values()]
    assert feature(spark, list(cases), lambda s: W.insert_keys(s, "tenant_id")) == [c[1] for c in cases.values()]


def test_reads_and_tables(spark):
    cases = {
        "SELECT * FROM a JOIN b.C c ON true": (True, ["a", "c"]),
        "  select 1 from t where x = 'wait for it'": (True, ["t"]),
        "SELECT * FROM t FOR UPDATE": (False, ["t"]),
        "TABLE t": (True, []),
        "WITH x AS (SELECT 1) SELECT * FROM x": (False, ["x"]),
        "INSERT INTO t SELECT * FROM u": (False, ["t", "u"]),
        "UPDATE t SET x = 1": (False, ["t"]),
        "selection": (False, []),
    }
    assert feature(spark, list(cases), W.is_read_only) == [c[0] for c in cases.values()]
    assert feature(spark, list(cases), W.tables_touched) == [c[1] for c in cases.values()]


def two_keys(same: bool) -> tuple[str, str]:
    home = resolve_key(RULE, "k0")
    return "k0", next(f"k{i}" for i in range(1, 100) if (resolve_key(RULE, f"k{i}") == home) == same)


def test_routing(spark):
    (a, b), (c, d) = two_keys(True), two_keys(False)
    home = resolve_key(RULE, "k0")
    cases = {
        f"SELECT 1 FROM t WHERE tenant_id = '{a}'": ("single", home),
        f"INSERT INTO t (tenant_id) VALUES ('{a}'), ('{b}')": ("single", home),
        f"INSERT INTO t (tenant_id) VALUES ('{c}'), ('{d}')": ("reject: several shards", None),
        "SELECT count(*) FROM t": ("scatter", None),
        "DELETE FROM t": ("reject: write without key", None),
        "SELECT * FROM countries": ("any shard", "shard-0"),
        "UPDATE countries SET x = 1": ("reject: write without key", None),
        "SELECT * FROM countries JOIN t ON true": ("scatter", None),
        "SELECT 1 FROM t WHERE tenant_id = 'a' OR tenant_id = 'b'": ("scatter", None),
        "SELECT 1 FROM t WHERE tenant_id = 'a' OR tenant_id = 'a'": ("single", resolve_key(RULE, "a")),
    }
    routed = W.route(log(spark, list(cases)), RULE).orderBy("stmt_id").collect()
    assert [(r.decision, r.shard) for r in routed] == list(cases.values())
    blocked = W.route(log(spark, list(cases)), equal_hash_topology("tenant_id", 4, write_blocked=True, reference_tables=("Countries",)))
    assert {r.decision for r in blocked.filter("NOT read").collect()} == {"reject: write blocked"}


@pytest.mark.parametrize("width", [3, 1000])
def test_write_blocks(spark, width):
    texts = ["SELECT 1", "DELETE FROM t"]
    rows = [(at * 2 + w, "ks", at, texts[w]) for at in range(60) for w in (0, 1)] + [(1000, "other", 11, texts[1])]
    df = spark.createDataFrame(rows, "stmt_id long, keyspace string, at long, sql string")
    # The second block lies inside the first; equal blocks may be listed twice.
    blocks = [("ks", 10, 30), ("ks", 12, 15), ("ks", 12, 15), ("ks", 40, 41), ("none", 0, 99)]
    kept = W.accepted_statements(df, spark.createDataFrame(blocks, "keyspace string, from_at long, to_at long"), width)
    want = {i for i, ks, at, sql in rows if sql == texts[0] or not any(k == ks and a <= at < b for k, a, b in blocks)}
    assert {r.stmt_id for r in kept.collect()} == want
