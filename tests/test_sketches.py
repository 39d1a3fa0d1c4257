import random

from shardweave.operators import autosplit as A


def test_merged_sketches_keep_the_rank_error(spark):
    rng = random.Random(5)
    rows = [(f"s{i % 7}", i % 5, "hot" if i % 3 else "cold", rng.lognormvariate(0, 2)) for i in range(30_000)] + [("s0", 0, "hot", None), ("s0", 0, "hot", float("nan"))]
    sketches = A.quantile_sketches(spark.createDataFrame(rows, "shard string, day int, kind string, v double"), ["shard", "day", "kind"], "v")
    got = A.merged_quantiles(sketches, ["kind"], {"low": 0.01, "mid": 0.5, "high": 0.99}).collect()
    assert len(got) == 2
    for r in got:
        values = [v for _, _, kind, v in rows if kind == r.kind and v is not None and v == v]
        assert r.n_samples == len(values)
        for name, q in (("low", 0.01), ("mid", 0.5), ("high", 0.99)):
            assert abs(sum(v <= r[name] for v in values) / len(values) - q) < 0.005
    assert A.merged_quantiles(sketches.limit(0), ["kind"], {"mid": 0.5}).collect() == []
