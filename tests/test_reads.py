"""Reads at a quorum: requests that ask the same replicas share what these hold, and each gets what it would get alone."""

from collections import Counter

from compare import spark_rows

from causalframe.operators import quorum

ANSWERS = "req_id long, key string, node_id string, arrival_ns long, ok boolean, n_values int"
HELD = "key string, node_id string, seq long, data string, versions map<string,bigint>, is_tombstone boolean"


def test_requests_of_the_same_replicas_share_the_work(spark, monkeypatch):
    answers = [(i, "k", f"n{r}", (i + r) % 3, True, 1) for i in range(100) for r in range(3)]
    held = [("k", f"n{r}", s, "x", {"a": s}, False) for r in range(3) for s in range(1, 31)]
    given, plain = [], quorum.reconcile

    def counted(rows, *args):
        given.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(quorum, "reconcile", counted)
    got, context = quorum.read(spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(held, HELD), 2)
    assert Counter(r["req_id"] for r in got.collect()) == Counter({i: 2 for i in range(100)}) and context.count() == 100
    assert sum(given) <= 3 * 30 + 3 * 2  # each replica's versions, and the survivors of each pair of replicas


def test_reads_against_each_request_alone(spark):
    answers = [(1, "k", "n0", 5, True, 1), (1, "k", "n1", 5, True, 1), (1, "k", "n2", 5, True, 1), (2, "k", "n2", 1, True, 1), (2, "k", "n0", 2, False, 1), (2, "k", "n1", 3, True, 1), (3, "k", "n0", 1, True, 1),
               (4, "none", "n0", 1, True, 1), (4, "none", "n1", 1, True, 1), (5, None, "n0", 1, True, 1), (5, "k", "n1", 1, True, 1), (None, "k", "n0", 1, True, 1), (None, "k", "n1", 2, True, 1),
               (6, "k", "n0", 1, True, 1), (6, "z", "n0", 2, True, 1), (7, "k", "n0", 1, True, 1), (7, "k", "n0", 2, True, 1), (8, "empty", "n0", 1, True, 1), (8, "empty", "n1", 1, True, 1)]
    held = [("k", "n0", 1, "x", {"a": 1}, False), ("k", "n0", 2, None, {"a": 2}, False), ("k", "n1", 1, "x", {"a": 1}, False), ("k", "n1", 3, "y", {"b": 1}, True), ("k", "n2", 4, "w", {"a": 2, "b": 1}, False),
            ("k", "n2", 5, "v", None, False), ("z", "n0", 6, "u", {"a": 1, "c": 1}, False), ("empty", "n0", 7, "e", {}, False), ("unasked", "n0", 8, "", {"a": 9}, False)]
    got, context = quorum.read(spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(held, HELD), 2)
    more = lambda a, b: a is not None and b is not None and any(n > (b or {}).get(x, 0) for x, n in a.items())
    want, merged = Counter(), {}
    for i in sorted({a[0] for a in answers if a[0] is not None}):
        first = sorted((a[3], a[2], a[1]) for a in answers if a[0] == i and a[4] and a[5] > 0)[:2]
        rows = [h for _, node, key in first for h in held if key is not None and h[:2] == (key, node)] if len(first) == 2 else []
        for h in rows:
            if not any(more(o[4], h[4]) and not more(h[4], o[4]) for o in rows):
                want[i, h[0], h[1], h[2]] += 1
            for node, n in (h[4] or {}).items():
                merged.setdefault(i, {})[node] = max(n, merged.get(i, {}).get(node, 0))
    assert got.columns == ["key", "node_id", "req_id", "seq", "data", "versions", "is_tombstone"]
    assert Counter(tuple(r) for r in got.select("req_id", "key", "node_id", "seq").collect()) == want
    assert {r["req_id"]: r["context"] for r in context.collect()} == merged
    once = quorum.read(spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(held, HELD), 2, dedupe=True)[0]
    assert sum(spark_rows(once.where("req_id = 7").select("seq"))[1].values()) == 1
