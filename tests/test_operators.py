import hashlib

import pytest
from pyspark.sql import functions as F

from causalframe.config import ClusterConfig, LogConfig
from causalframe.functions.hashing import position
from causalframe.functions.predicates import circuit_breaker_error, retryable, same_version
from causalframe.operators import membership, merkle, quorum, repair, resilience, ring, telemetry


def test_config():
    assert ClusterConfig().vnodes == 256 and LogConfig().segment_bytes == 10 << 20
    for bad in ({"r": 4}, {"w": 0}, {"n": 0}, {"vnodes": 0}, {"storage": "bolt"}):
        with pytest.raises(ValueError):
            ClusterConfig(**bad)


def test_ring_goldens(spark):
    nodes = spark.createDataFrame([(f"node{i}", i) for i in range(10)], "node_id string, ord long")
    whole = ring.tokens(nodes, 256)
    one = {r["position"] for r in whole.where("node_id = 'node1'").collect()}
    assert {173995284, 275538713, 233233554, 1778904957, 223540258, 4248092695} <= one
    key = spark.createDataFrame([("user:123",)], "key string").select(position(F.col("key")).alias("p")).first()["p"]
    assert key == 2430271536
    keys = spark.range(10000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    got = {r["node_id"]: r["n_keys"] for r in ring.load(keys, whole).collect()}
    assert [got[f"node{i}"] for i in range(10)] == [1018, 812, 1012, 971, 967, 1102, 972, 1090, 1081, 975]


def test_ring_walks(spark):
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "node_id string, ord long")
    small = ring.tokens(nodes, 10)
    keys = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    for n, want in ((3, 3), (7, 3), (1, 1)):
        lists = ring.preference_lists(keys, small, n)
        assert {len(set(r["nodes"])) for r in lists.collect()} == {want}
    rest = ring.preference_lists(keys, ring.without(ring.without(small, "n0"), "n1"), 3)
    assert {tuple(r["nodes"]) for r in rest.collect()} == {("n2",)}
    before = {r["key"]: r["node_id"] for r in ring.coordinators(keys, small).collect()}
    after = {r["key"]: r["node_id"] for r in ring.coordinators(keys, ring.without(small, "n0")).collect()}
    assert all(after[k] == n for k, n in before.items() if n != "n0") and len(after) == 200
    with pytest.raises(ValueError):
        ring.tokens(nodes, 0)
    many = {}
    for n in ("n0", "n1", "n2"):
        for i in range(56_000):
            c = "\ufffd" if 0xD800 <= i <= 0xDFFF else chr(i)
            many[int.from_bytes(hashlib.md5(f"{n}:{c}".encode()).digest()[:4], "big")] = n
    assert {r["position"]: r["node_id"] for r in ring.tokens(nodes, 56_000).collect()} == many


def _root(hashes):
    if not hashes:
        return hashlib.sha256(b"empty").hexdigest()
    if len(hashes) == 1:
        return hashes[0]
    m = len(hashes) // 2
    return hashlib.sha256((_root(hashes[:m]) + _root(hashes[m:])).encode()).hexdigest()


def test_merkle(spark):
    rows = [("a", "key1", "value1"), ("a", "key2", "value2"), ("b", "key1", "value1"), ("b", "key2", "value2"), ("b", "key3", "value3"), ("c", "key1", "value1"), ("c", "key2", "different"), ("c", "key3", "value3")]
    rows += [(f"t{n}", f"k{i:03}", str(i * n)) for n in (1, 2, 5, 7, 64, 100) for i in range(n)]
    df = spark.createDataFrame(rows, "tree string, key string, value string")
    got = {r["tree"]: r["root"] for r in merkle.roots(df).collect()}
    assert got["a"] == "87e5e8d2fca10f59e50769186ab401bcab29a11b17b700ca441a783441c7b2e8"
    assert got["b"] == "35c83221fd217d61386ac3da741d05dd5c19dc224c2ed8b89ef71a0e35a5a7ae"
    assert got["c"] == "e7249442d63dfdeeb9c597eb8f5f5f5d90c76d0b9a6aa2b050a6e8c5d4e7ec59"
    for n in (1, 2, 5, 7, 64, 100):
        assert got[f"t{n}"] == _root([hashlib.sha256(f"k{i:03}{i * n}".encode()).hexdigest() for i in range(n)])
    assert merkle.EMPTY_ROOT == _root([])
    counts = merkle.nodes(merkle.leaves(df)).groupBy("tree").count().collect()
    assert {r["tree"]: r["count"] for r in counts}["t7"] == 13
    other = df.withColumn("value", F.when((F.col("tree") == "a") & (F.col("key") == "key2"), "x").otherwise(F.col("value")))
    assert [(r["tree"], r["key"]) for r in merkle.positional_diff(df, other).collect()] == [("a", "key2")]
    assert merkle.roots(df.where("false")).count() == 0


def test_quorum_statuses(spark):
    rows = [(1, "node0", True, 1), (1, "node1", True, 1), (2, "node0", True, 1), (2, "node1", False, 0), (3, "node0", False, 0), (3, "node1", True, 0), (4, "node0", None, 0), (4, "node1", False, 0), (5, "node0", False, 0), (5, "node1", False, 0)]
    df = spark.createDataFrame(rows, "req_id long, node_id string, ok boolean, n_values int").withColumn("key", F.lit("k")).withColumn("arrival_ns", F.lit(1))
    assert {r["req_id"]: r["status"] for r in quorum.read_status(df, 2).collect()} == {1: "ok", 2: "quorum_failed", 3: "timeout", 4: "timeout", 5: "timeout"}
    wrote = {r["req_id"]: (r["status"], r["ref_status"]) for r in quorum.write_status(df, 2).collect()}
    assert wrote == {1: ("ok", "ok"), 2: ("quorum_failed", "quorum_failed"), 3: ("quorum_failed", "quorum_failed"), 4: ("timeout", "timeout"), 5: ("all_failed", "ok")}
    assert {(r["req_id"], r["holder"], r["for_node"]) for r in quorum.hints(df).collect()} == {(2, "node0", "node1"), (3, "node1", "node0")}


def test_hints_and_members(spark):
    hints = spark.createDataFrame([("h", "a"), ("h", "b"), ("g", "zz")], "holder string, for_node string")
    members = spark.createDataFrame([("a", 0), ("b", 2)], "node_id string, status int")
    done, kept = repair.deliver(hints, members)
    assert [r["for_node"] for r in done.collect()] == ["a"] and kept.count() == 2
    counts = {r["status"]: r["members"] for r in membership.member_counts(members).collect()}
    assert counts == {"alive": 1, "suspected": 0, "dead": 1}
    mine = spark.createDataFrame([("a", 0, 5), ("b", 1, 5)], "node_id string, status int, heartbeat long")
    theirs = spark.createDataFrame([("a", 2, 5), ("b", 2, 6), ("c", 0, 1)], "node_id string, status int, heartbeat long")
    merged = {r["node_id"]: r["status"] for r in membership.merge_members(mine, theirs).collect()}
    assert merged == {"a": 0, "b": 2, "c": 0}
    pairs = membership.gossip_pairs(theirs.withColumn("status", F.lit(0)), 3).collect()
    assert len(pairs) == 3 and all(r["node_id"] != r["peer"] for r in pairs)


@pytest.mark.parametrize("ratio,want", [(0.5, 2), (1, 4), (1.5, 8), (2, 12), (2.5, 16), (3, 20)])
def test_simple_phi(spark, ratio, want):
    beats = spark.createDataFrame([("n", 0)], "node_id string, arrival_ns long")
    row = membership.phi(membership.intervals(beats), int(ratio * 1000), 1000).first()
    assert abs(row["phi"] - want) < 1e-9


def test_phi_is_capped(spark):
    beats = spark.createDataFrame([("n", i * 1_000_000_000) for i in range(50)], "node_id string, arrival_ns long")
    row = membership.phi(membership.intervals(beats), 10**13, 10**9).first()
    assert abs(row["phi"] - 4.0) < 1e-6 and row["phi_raw"] > 8
    members = spark.createDataFrame([("n", 0), ("gone", 0), ("me", 0)], "node_id string, status int")
    got = {r["node_id"]: r["new_status"] for r in membership.changes(members, membership.phi(membership.intervals(beats), 10**13, 10**9), self_id="me").collect()}
    assert got == {"gone": 2}


def test_latency_percentiles(spark):
    rows = [("A", i, v) for i, v in enumerate([5] * 8 + [500] * 2)] + [("B", i, 30) for i in range(10)] + [("C", i, i + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "node_id string, seq long, latency_ns long")
    got = {r["node_id"]: (r["p50"], r["p99"]) for r in telemetry.latency(df).collect()}
    assert got == {"A": (5, 500), "B": (30, 30), "C": (50, 99)}
    over = spark.createDataFrame([("D", i, 100) for i in range(10)] + [("D", 10 + i, 1) for i in range(10)], "node_id string, seq long, latency_ns long")
    assert telemetry.latency(over, 10).first()["p99"] == 1
    assert telemetry.rolling_latency(df, 10).where("node_id = 'C' and seq = 99").first()["value"] == 99
    lists = spark.createDataFrame([("k", 0, "A"), ("k", 1, "X"), ("k", 2, "B")], "key string, rank int, node_id string")
    assert telemetry.select_coordinator(lists, telemetry.latency(df)).first()["node_id"] == "B"
    order = telemetry.reorder_by_latency(lists, telemetry.latency(df)).orderBy("new_rank").collect()
    assert [r["node_id"] for r in order] == ["B", "A", "X"]


def test_admission(spark):
    slow = spark.createDataFrame([("n", i, 200_000_000) for i in range(100)], "node_id string, seq long, latency_ns long")
    checks = spark.createDataFrame([("n", 100 + i) for i in range(15)], "node_id string, seq long")
    rows = telemetry.admission(slow, checks, 50_000_000).orderBy("seq").collect()
    assert rows[-1]["slots"] == 1 and rows[0]["slots"] == 9
    fast = telemetry.admission(slow.withColumn("latency_ns", F.lit(1).cast("long")), checks, 50_000_000)
    assert fast.agg(F.min("slots")).first()[0] == 10
    few = telemetry.admission(slow.where("seq < 9"), checks, 50_000_000)
    assert few.agg(F.min("slots"), F.max("slots")).first()[0] == 10


def test_metrics(spark):
    obs = spark.createDataFrame([("m", "", v) for v in (0.05, 0.3, 0.7, 2.0)], "metric string, labels string, value double")
    rows = telemetry.histogram(obs, (0.1, 0.5, 1.0)).orderBy("i").collect()
    assert [(r["le"], r["count"]) for r in rows] == [("0.1", 1), ("0.5", 2), ("1", 3), ("+Inf", 4)]
    lines = [r["line"] for r in telemetry.histogram_lines(telemetry.histogram(obs, (0.1,))).orderBy("place").collect()]
    assert lines == ['m_bucket{le="0.1"} 1', 'm_bucket{le="+Inf"} 4', "m_sum 3.05", "m_count 4"]
    one = spark.range(1)
    assert one.select(telemetry.labels("op", "get", "x").alias("l")).first()["l"] == '{op="get",x=""}'
    assert one.select(telemetry.labels().alias("l")).first()["l"] == ""
    moves = spark.createDataFrame([("g", "", 1, "add", 5), ("g", "", 2, "set", 7), ("g", "", 3, "add", -2), ("h", "", 1, "add", 4)], "metric string, labels string, seq long, kind string, value long")
    assert {r["metric"]: r["value"] for r in telemetry.gauges(moves).collect()} == {"g": 5, "h": 4}


def test_retries(spark):
    config = resilience.RetryConfig(retries=3)
    assert [(r["wait_ms"], r["total_ms"]) for r in resilience.backoff(spark, config).orderBy("attempt").collect()] == [(100, 100), (200, 300), (400, 700)]
    rows = [(1, 0, False, "timeout"), (1, 1, True, None), (2, 0, False, "server_error"), (2, 1, True, None), (3, 0, False, "timeout"), (3, 1, False, "timeout"), (3, 2, False, "timeout"), (3, 3, False, "unreachable"), (3, 4, True, None)]
    got = {r["req_id"]: (r["tries"], r["ok"], r["error"]) for r in resilience.retry_outcomes(spark.createDataFrame(rows, "req_id long, attempt int, ok boolean, error string"), config).collect()}
    assert got == {1: (2, True, None), 2: (1, False, "server_error"), 3: (4, False, "unreachable")}
    codes = spark.createDataFrame([("unreachable",), ("timeout",), ("circuit_open",), ("server_error",), ("invalid_response",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(retryable(F.col("c")), circuit_breaker_error(F.col("c"))).collect()] == [(True, False), (True, False), (True, True), (False, False), (False, False), (False, False)]


def test_breaker(spark):
    config = resilience.BreakerConfig(failures_to_open=2, successes_to_close=2, half_open_requests=2, reset_ns=100)
    events = [("failure", 1), ("failure", 2), ("allow", 50), ("allow", 102), ("allow", 103), ("allow", 104), ("success", 105), ("success", 106), ("allow", 107), ("failure", 108), ("success", 109), ("failure", 110), ("failure", 111), ("reset", 112)]
    df = spark.createDataFrame([("x", t, i, e) for i, (e, t) in enumerate(events)], "address string, ts_ns long, seq long, event string")
    rows = resilience.breaker_states(df, config).orderBy("seq").collect()
    assert [r["allowed"] for r in rows if r["event"] == "allow"] == [False, True, True, False, True]
    assert [r["state"] for r in rows] == ["closed", "open", "open", "half_open", "half_open", "half_open", "half_open", "closed", "closed", "closed", "closed", "closed", "open", "closed"]
    assert resilience.breaker_stats(resilience.breaker_states(df, config)).first()["rejected"] == 2


def test_same_version(spark):
    df = spark.createDataFrame([(("d", {"a": 1}, False), ("d", {"a": 1}, False)), (("d", {"a": 1}, False), ("d", {"a": 2}, False)), ((None, {}, True), (None, {}, True))], "a struct<data:string,versions:map<string,bigint>,is_tombstone:boolean>, b struct<data:string,versions:map<string,bigint>,is_tombstone:boolean>")
    assert [r[0] for r in df.select(same_version(F.col("a"), F.col("b"))).collect()] == [True, False, True]
