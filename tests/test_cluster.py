from pyspark.sql import functions as F

from causalframe.config import ClusterConfig
from causalframe.operators import merkle
from causalframe.operators.cluster import Cluster

ASK = "key string, seq long, data string, context map<string,bigint>"


def members(spark):
    return spark.createDataFrame([(f"n{i}", i, 0, 1) for i in range(5)], "node_id string, ord long, status int, heartbeat long")


def asks(spark, rows):
    return spark.createDataFrame(rows, ASK).withColumn("ts", F.timestamp_seconds("seq"))


def test_read_modify_write(spark):
    c = Cluster.start(members(spark), ClusterConfig(vnodes=4))
    c, status = c.put(asks(spark, [("k", 1, "v1", None), ("j", 1, "w", None)]))
    assert {r["status"] for r in status.collect()} == {"ok"} and c.replicas.count() == 6
    _, found = c.get(spark.createDataFrame([("k",)], "key string"))
    context = found.first()["context"]
    c, _ = c.put(asks(spark, [("k", 2, "v2", context)]))
    got, _ = c.get(spark.createDataFrame([("k",), ("none",)], "key string"))
    assert [r["data"] for r in got.collect()] == ["v2"]
    _, found = c.get(spark.createDataFrame([("none",)], "key string"))
    assert found.first()["status"] == "timeout"
    c, _ = c.delete(asks(spark, [("k", 3, None, {"n0": 9, "n1": 9, "n2": 9, "n3": 9, "n4": 9})]))
    got, _ = c.get(spark.createDataFrame([("k",)], "key string"))
    assert [r["is_tombstone"] for r in got.collect()] == [True]


def test_merkle_update_and_delete(spark):
    rows = spark.createDataFrame([("t", "a", "1"), ("t", "b", "2")], "tree string, key string, value string")
    more = merkle.update(rows, spark.createDataFrame([("t", "b", "3"), ("t", "c", "4")], rows.schema))
    assert merkle.leaves(more).count() == 3
    back = merkle.delete(more, more.where("key = 'c'"))
    assert merkle.roots(merkle.update(back, rows)).first()["root"] == merkle.roots(rows).first()["root"]
