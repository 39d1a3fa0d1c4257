from pyspark.sql import functions as F

from shardweave.operators import fleet as M

NOW = 1_000_000_000_000
BEATS = (
    "pod string, role string, promoted boolean, ready boolean, endpoint string, lag long, size long, reason string, at long, seq long"
)
PODS = "pod string, shard string, cluster string, pod_ready boolean, is_job boolean, is_target boolean, created_at long"


def beat(pod, role="replica", promoted=False, ready=True, lag=0, size=0, reason=None, at=NOW, seq=0):
    return (pod, role, promoted, ready, f"{pod}:1", lag, size, reason, at, seq)


def pod(name, shard="s", cluster="c", ready=True, job=False, target=False, created=0):
    return (name, shard, cluster, ready, job, target, created)


def members(spark, pods, beats, fenced=()):
    latest = M.latest_status(spark.createDataFrame(beats, BEATS))
    fences = spark.createDataFrame([(f,) for f in fenced], "pod string")
    return M.member_status(spark.createDataFrame(pods, PODS), latest, fences, NOW)


def places(df):
    return {r.pod: (r.place, r.ready, r.reason) for r in df.collect()}


def test_primary_and_replicas(spark):
    df = members(
        spark,
        [pod("p0"), pod("p1"), pod("p2", ready=False), pod("p3"), pod("p4"), pod("j", job=True), pod("p5")],
        [
            beat("p0", "primary", size=7), beat("p1", lag=-1), beat("p2", reason=None), beat("p3", at=NOW - M.STALE_AFTER - 1),
            beat("p4"), beat("j"), beat("p1", ready=False, at=NOW - 5),
        ],
        ["p4"],
    )
    assert places(df) == {
        "p0": ("primary", True, None), "p1": ("replica", True, None), "p2": ("replica", False, "pod-not-ready"),
        "p3": ("replica", False, None), "p4": ("replica", False, "fenced"), "p5": ("replica", False, None),
    }
    row = M.shard_status(df).first()
    assert row.primary.pod == "p0" and row["size"] == 7
    assert [(r.pod, r.lag) for r in row.replicas] == [("p1", 0), ("p2", 0), ("p3", 0), ("p4", 0), ("p5", 0)]


def test_rogue_and_fenced_primaries(spark):
    df = members(
        spark,
        [pod("a"), pod("b"), pod("c")],
        [beat("a", "primary"), beat("b", "primary", promoted=True), beat("c", "primary", promoted=True)],
        ["c"],
    )
    assert places(df) == {"a": ("replica", False, "rogue-primary"), "b": ("primary", True, None), "c": ("replica", False, "fenced")}
    assert [r.pod for r in M.rogue_reseeds(M.shard_status(df)).collect()] == ["a"]
    assert M.split_brain(df).count() == 0


def test_split_brain_keeps_the_first(spark):
    df = members(spark, [pod("a"), pod("b")], [beat("b", "primary"), beat("a", "primary")])
    assert places(df) == {"a": ("primary", True, None), "b": ("replica", True, None)}
    assert [r.claimants for r in M.split_brain(df).collect()] == [2]


def test_target_without_status_serves(spark):
    df = members(spark, [pod("t", target=True), pod("u", target=True), pod("v", target=True, ready=False)], [beat("other")])
    assert places(df) == {"t": ("primary", True, None), "u": ("unused", True, None), "v": ("replica", False, None)}
    assert [r.endpoint for r in M.serving_endpoints(M.shard_status(df)).collect()] == ["t:5432"]


def test_failure_and_candidate(spark):
    df = members(
        spark,
        [pod("a", "s0"), pod("b", "s0"), pod("c", "s0"), pod("d", "s1"), pod("e", "s2"), pod("f", "s2"), pod("g", "s10"), pod("h", "s10")],
        [
            beat("a", "primary", ready=False), beat("b", lag=50), beat("c", lag=50), beat("d", ready=False),
            beat("e", "primary"), beat("f"), beat("g", lag=200), beat("h", lag=30),
        ],
    )
    decisions = M.failure_decision(M.shard_status(df))
    found = {r.shard: (r.failed, r.reason, r.candidate) for r in decisions.collect()}
    assert found == {
        "s0": (True, "PrimaryNotReady", "b"), "s1": (True, "NoEligibleReplica", None),
        "s2": (False, "None", None), "s10": (True, "NoPrimary", "h"),
    }
    first = M.first_failure(decisions, F.expr("CAST(substr(shard, 2) AS INT)")).first()
    assert (first.shard, first.candidate) == ("s0", "b")


def test_phase(spark):
    df = members(spark, [pod("a", "s0", "c0"), pod("b", "s1", "c1"), pod("x", "s2", "c2")], [beat("a", "primary"), beat("b", "primary", ready=False), beat("x", "primary")])
    status = M.shard_status(df)
    clusters = spark.createDataFrame(
        [("c0", False, True, True, True), ("c1", False, True, False, False), ("c2", False, False, True, False), ("c3", False, True, False, False), ("c4", True, True, False, False)],
        "cluster string, hibernated boolean, was_ready boolean, router_active boolean, router_ready boolean",
    )
    phases = {r.cluster: r.phase for r in M.cluster_phase(clusters, status, M.failure_decision(status)).collect()}
    assert phases == {"c0": "Ready", "c1": "Degraded", "c2": "Provisioning", "c3": "Provisioning", "c4": "Hibernated"}


def test_volume_fences(spark):
    cols = "pvc string, pod string, role string, ready boolean, holder string, renewed_at long, duration_s int, multi_attach boolean"
    rows = [
        ("m", "a", "primary", True, "a", NOW, 30, True), ("m", "b", "replica", True, "a", NOW, 30, True),
        ("s", "a", "primary", True, "a", NOW, 30, False), ("s", "b", "primary", True, "a", NOW, 30, False), ("s", "c", "replica", True, "a", NOW, 30, False),
        ("l", "a", "primary", True, "z", NOW - 31_000_000, 30, False), ("l", "c", "replica", True, "z", NOW - 31_000_000, 30, False),
        ("k", "a", "primary", True, "z", NOW - 30_000_000, 30, False),
        ("n", "a", "primary", True, "z", None, 30, False), ("d", "a", "primary", True, "z", 5, 0, False),
    ]
    found = {(r.pvc, r.pod): (r.fence, r.reason) for r in M.fence_decisions(spark.createDataFrame(rows, cols), NOW).collect()}
    assert found == {
        ("m", "a"): (True, "MultiAttach"), ("m", "b"): (True, "MultiAttach"),
        ("s", "a"): (False, "SplitBrain"), ("s", "b"): (True, "SplitBrain"),
        ("l", "a"): (True, "StaleLease"), ("k", "a"): (False, ""), ("n", "a"): (False, ""), ("d", "a"): (False, ""),
    }


def test_stuck_standbys(spark):
    pods = [pod("p"), pod("old", created=NOW - M.STUCK_AFTER), pod("new", created=NOW - M.STUCK_AFTER + 1), pod("again")]
    df = members(spark, pods, [beat("p", "primary"), beat("old", ready=False), beat("new", ready=False), beat("again", ready=False)])
    reseeds = spark.createDataFrame([("again", NOW - M.RESEED_EVERY + 1), ("old", NOW - M.RESEED_EVERY)], "pod string, reseeded_at long")
    found = M.stuck_standbys(M.shard_status(df), spark.createDataFrame(pods, PODS), reseeds, NOW)
    assert [r.pod for r in found.collect()] == ["old"]


def test_switchovers(spark):
    df = members(spark, [pod("p"), pod("r"), pod("n")], [beat("p", "primary"), beat("r"), beat("n", ready=False)])
    asked = spark.createDataFrame([(1, "c", "p"), (2, "c", "r"), (3, "c", "n"), (4, "c", "?"), (5, "other", "r")], "id int, cluster string, target string")
    found = {r.id: (r.verdict, r.endpoint) for r in M.check_switchovers(asked, df).collect()}
    missing = ("not found or not ready", None)
    assert found == {1: ("already primary", None), 2: ("ok", "r:1"), 3: missing, 4: missing, 5: missing}
