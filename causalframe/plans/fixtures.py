"""Key-value tables made from the driver's tables, by rules that Spark and other engines work out alike.

Every event is a write to key user:<id> by node event_id mod 3. Purchases and errors are read-modify-writes: their clock
counts all writes of the key so far; others are blind and count their own node's. Errors are tombstones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalframe.functions import clock

REPLICAS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, node_id, data, versions, ts, is_tombstone, value."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "event_id", "ts", "event_type", "value", "props")
    past = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    node = F.col("event_id") % REPLICAS
    whole = F.col("event_type").isin("purchase", "error")
    counts = [F.sum((node == i).cast("long")).over(past).alias(f"c{i}") for i in range(REPLICAS)]
    seen = [F.struct(F.lit(f"node{i}").alias("key"), F.when(whole | (node == i), F.col(f"c{i}")).otherwise(0).alias("value")) for i in range(REPLICAS)]
    versions = F.map_from_entries(F.filter(F.array(*seen), lambda x: x["value"] > 0)).alias("versions")
    rows = e.select("*", *counts)
    return rows.select("key", F.col("event_id").alias("seq"), F.concat(F.lit("node"), node.cast("string")).alias("node_id"), F.col("props").alias("data"), versions, "ts", (F.col("event_type") == "error").alias("is_tombstone"), "value")


def replicas(versions: DataFrame) -> DataFrame:
    """versions as held by nodes node0 to node2 (holder): node r lacks those of seq modulo 7 = r."""
    each = versions.withColumnRenamed("node_id", "writer").withColumn("r", F.explode(F.array(*[F.lit(i) for i in range(REPLICAS)])))
    return each.where(F.col("seq") % 7 != F.col("r")).withColumn("node_id", F.concat(F.lit("node"), F.col("r").cast("string"))).drop("r")


def nodes(spark: SparkSession, count: int = 10) -> DataFrame:
    return spark.range(count).select(F.concat(F.lit("node"), F.col("id").cast("string")).alias("node_id"), F.col("id").alias("ord"))


def members(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Members by supplier: status and heartbeat by arithmetic on the key; shift gives another view of them."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.col("s_name").alias("node_id"), F.concat(F.lit("10.0.0."), k.cast("string")).alias("address"), ((k + shift) % 3).cast("int").alias("status"), ((k * 7 + shift * 13) % 50).cast("long").alias("heartbeat"))


def responses(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """req_id, key, node_id, arrival_ns, ok, n_values: three replicas' answers to every so many events."""
    e = table(spark, sf_dir, "events").where(F.col("event_id") % every == 0)
    rows = e.select(F.col("event_id").alias("req_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.explode(F.array(*[F.lit(i) for i in range(REPLICAS)])).alias("r"))
    id_, r = F.col("req_id"), F.col("r")
    ok = ((id_ + r * 5) % 4 != 0) & (id_ % 29 != 0)
    return rows.select("req_id", "key", F.concat(F.lit("node"), r.cast("string")).alias("node_id"), ((id_ * 7919 + r * 104729) % 1000).cast("long").alias("arrival_ns"), ok.alias("ok"), ((id_ * 3 + r) % 4).cast("int").alias("n_values"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, seq, latency_ns: the events' values as milliseconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node"), (F.col("event_id") % 7).cast("string")).alias("node_id"), F.col("event_id").alias("seq"), F.round(F.col("value") * 1_000_000).cast("long").alias("latency_ns"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, arrival_ns: the events of each node as heartbeats."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node"), (F.col("event_id") % 7).cast("string")).alias("node_id"), (micros(F.col("ts")) * 1000).alias("arrival_ns"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def log(versions: DataFrame) -> DataFrame:
    """versions as a log: 1,000 entries a segment, the offset by the place in it."""
    length = F.length("data").cast("long") + 40
    return versions.withColumn("segment_id", F.expr("seq div 1000")).withColumn("offset", F.col("seq")).withColumn("length", length)


def shown(versions: DataFrame) -> DataFrame:
    """key, seq, data, clock as text, is_tombstone: columns that compare as values."""
    return versions.select("key", "seq", "data", clock.render(F.col("versions")).alias("clock"), "is_tombstone")
