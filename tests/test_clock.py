import itertools
import random

import pytest
from pyspark.sql import functions as F

from causalframe.functions import clock
from causalframe.operators.reconcile import contexts, last_write_wins, merge_carts, reconcile, reconcile_with, stale
from causalframe.operators.store import Store, sweep
from causalframe.schema import VERSIONS
from causalframe.streaming.stateful import maximal


def one(spark, expr, **maps):
    df = spark.createDataFrame([tuple(maps.values())], ", ".join(f"{k} map<string,bigint>" for k in maps))
    return df.select(expr.alias("x")).first()["x"]


def versions(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, data string, versions map<string,bigint>, is_tombstone boolean").withColumn("ts", F.timestamp_seconds("seq")).select("key", "seq", "data", "versions", "ts", "is_tombstone")


@pytest.mark.parametrize(
    "a,b,want",
    [({"n1": 1, "n2": 2}, {"n1": 1, "n2": 3}, "before"), ({"n1": 1, "n2": 3}, {"n1": 1, "n2": 2}, "after"), ({"n1": 2, "n2": 1}, {"n1": 1, "n2": 2}, "concurrent"), ({"a": 0}, {}, "equal"), ({"a": 1}, {"a": 1}, "equal"), (None, {"a": 1}, "concurrent")],
)
def test_compare(spark, a, b, want):
    assert one(spark, clock.compare(F.col("a"), F.col("b")), a=a, b=b) == want


def test_increment_merge_prune(spark):
    twice = clock.increment(clock.increment(F.col("a"), "n1"), "n1")
    assert one(spark, twice, a={}) == {"n1": 2}
    assert one(spark, clock.merge(F.col("a"), F.col("b")), a={"n1": 2, "n2": 1}, b={"n1": 1, "n2": 3, "n3": 1}) == {"n1": 2, "n2": 3, "n3": 1}
    assert one(spark, clock.prune(F.col("a"), 10), a={f"n{i:02}": i for i in range(20)}) == {f"n{i:02}": i for i in range(10, 20)}
    assert one(spark, clock.prune(F.col("a"), 1), a={"x": 3, "y": 3}) == {"y": 3}
    assert one(spark, clock.equals(F.col("a"), F.col("b")), a={"a": 1}, b={"a": 1}) is True
    assert one(spark, clock.render(F.col("a")), a={"b": 2, "a": 1}) == "a=1,b=2"


def test_merge_is_a_join_of_the_order(spark):
    rng = random.Random(1)
    draw = lambda: {k: rng.randint(1, 3) for k in "abc" if rng.random() < 0.7}
    rows = [(draw(), draw(), draw()) for _ in range(60)]
    df = spark.createDataFrame(rows, "a map<string,bigint>, b map<string,bigint>, c map<string,bigint>")
    a, b, c = (F.col(x) for x in "abc")
    eq = lambda x, y: clock.render(x) == clock.render(y)
    flip = {"before": "after", "after": "before", "equal": "equal", "concurrent": "concurrent"}
    got = df.select(
        eq(clock.merge(a, b), clock.merge(b, a)).alias("commutes"), eq(clock.merge(clock.merge(a, b), c), clock.merge(a, clock.merge(b, c))).alias("associates"), eq(clock.merge(a, a), a).alias("idempotent"),
        clock.covers(clock.merge(a, b), a).alias("above"), clock.compare(a, b).alias("ab"), clock.compare(b, a).alias("ba"),
    ).collect()
    assert all(r["commutes"] and r["associates"] and r["idempotent"] and r["above"] and flip[r["ab"]] == r["ba"] for r in got)


def test_reconcile_goldens(spark):
    chain = [("k", i, f"version{i}", {"n1": i}, False) for i in range(1, 101)]
    assert [r["seq"] for r in reconcile(versions(spark, chain)).collect()] == [100]
    two = versions(spark, [("k", 1, "a", {"n1": 1}, False), ("k", 2, "b", {"n2": 1}, False)])
    assert reconcile(two).count() == 2
    tomb = versions(spark, [("k", 1, "value1", {"n1": 1}, False), ("k", 2, "value2", {"n2": 1}, False), ("k", 3, None, {"n1": 2}, True)])
    assert {r["seq"] for r in reconcile(tomb).collect()} == {2, 3}
    same = versions(spark, [("k", 1, "a", {"n1": 1}, False), ("k", 2, "a", {"n1": 1}, False), ("k", 3, "z", None, False)])
    assert reconcile(same).count() == 3 and reconcile(same, dedupe=True).count() == 2
    assert {r["key"]: r["context"] for r in contexts(two).collect()} == {"k": {"n1": 1, "n2": 1}}


def test_reconcile_is_the_maximal_set(spark):
    rng = random.Random(7)
    rows = [(f"k{i % 9}", i, "d", {n: rng.randint(1, 4) for n in "abcd" if rng.random() < 0.6}, False) for i in range(400)]
    got = {r["seq"] for r in reconcile(versions(spark, rows)).collect()}
    want = set()
    for _, group in itertools.groupby(sorted(rows), lambda r: r[0]):
        want |= {r[1] for r in maximal([(s, d, c, t) for _, s, d, c, t in group]) for r in [(None, r[0])]}
    assert got == want
    half = reconcile(versions(spark, rows[:200]))
    assert {r["seq"] for r in Store(half).put(versions(spark, rows[200:])).versions.collect()} == want


def test_resolution(spark):
    rows = versions(spark, [("k", 1, "a", {"n1": 1}, False), ("k", 2, "b", {"n2": 1}, False)])
    assert last_write_wins(rows).first()["data"] == "b"
    tie = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert last_write_wins(tie).first()["data"] == "a"
    assert reconcile_with(rows, "+".join).first()["data"] == "a+b"
    carts = versions(spark, [("c", 1, '{"user_id":"u","items":["b","a"]}', {"n1": 1}, False), ("c", 2, '{"user_id":"v","items":["c","a"]}', {"n2": 1}, False)])
    assert merge_carts(carts).first()["data"] == '{"user_id":"v","items":["a","b","c"]}'


@pytest.mark.parametrize("cur,latest,want", [({"a": 1}, {"a": 2}, True), ({"a": 1}, {"a": 1}, False), ({"a": 2}, {"a": 1}, False), ({"a": 2, "b": 1}, {"a": 1, "b": 2}, True)])
def test_stale(spark, cur, latest, want):
    got = stale(versions(spark, [("k", 1, "x", cur, False)]), versions(spark, [("k", 2, "y", latest, False)]))
    assert (got.count() == 1) is want


def test_store_modes(spark):
    rows = versions(spark, [(k, i, k, {"n": 1}, False) for i, k in enumerate("cabde")])
    store = Store(rows)
    assert [r["key"] for r in store.keys().collect()] == list("abcde")
    assert sorted(r["key"] for r in store.range("b", "d").collect()) == ["b", "c"]
    keys = spark.createDataFrame([("a",), ("q",)], "key string")
    assert store.multi_get(keys).count() == 1 and store.get("zz").count() == 0
    assert store.delete(keys).versions.count() == 4
    log = Store(rows, "log").delete(keys)
    assert log.get("a").count() == 1 and log.versions.count() == 7
    assert Store.empty(spark).put(rows).versions.count() == 5
    assert spark.createDataFrame([], VERSIONS).schema.names == rows.columns
    with pytest.raises(ValueError):
        Store(rows, "bolt")


def test_sweep(spark):
    day = 86_400
    rows = versions(spark, [("old", 2 * day, None, {"a": 1}, True), ("new", 9 * day, None, {"a": 1}, True), ("live", 1, "v", {"a": 1}, False), ("mixed", 1, None, {"a": 1}, True), ("mixed", 2, "v", {"b": 1}, False)])
    kept, removed = sweep(rows, F.timestamp_seconds(F.lit(10 * day)), 7 * day * 1_000_000)
    assert [r["key"] for r in removed.collect()] == ["old"] and kept.count() == 4
