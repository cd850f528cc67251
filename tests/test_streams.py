import time

from pyspark.sql import functions as F

from causalframe.operators.reconcile import reconcile
from causalframe.operators.resilience import BreakerConfig, breaker_states
from causalframe.plans import fixtures as fx
from causalframe.plans.streams import run_reconcile
from causalframe.streaming.stateful import breaker_stream, deduplicated, detector_stream, request_rates, sessions

from conftest import SMALL


def test_stream_reconciles_as_the_batch_does(spark):
    rows = fx.kv(spark, SMALL).where("seq < 600")
    assert {r["seq"] for r in run_reconcile(rows).collect()} == {r["seq"] for r in reconcile(rows).collect()}


def _run(query_df, mode, spark, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_breaker_stream(spark, tmp_path):
    kinds = ["failure", "failure", "allow", "success", "allow", "allow"]
    df = spark.range(60).select(F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("address"), (F.col("id") * 10).alias("ts_ns"), F.col("id").alias("seq"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(F.col("id") / 3) % 6 + 1).cast("int")).alias("event"))
    df.coalesce(1).write.parquet(f"{tmp_path}/b")
    config = BreakerConfig(failures_to_open=2, reset_ns=50)
    got = _run(breaker_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/b"), config), "append", spark, "breakers")
    columns = ["address", "seq", "allowed", "state", "failures"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, breaker_states(df, config).select(columns).collect()), key=str)


def test_detector_stream(spark, tmp_path):
    beats = spark.createDataFrame([("n1", 1), ("n2", 1)], "node_id string, arrival_ns long")
    beats.write.parquet(f"{tmp_path}/h")
    stream = spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/h")
    q = detector_stream(stream, 200).writeStream.format("memory").queryName("detector").outputMode("update").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("detector").where("status = 2").count() < 2:
            time.sleep(0.5)
        got = [(r["node_id"], r["status"]) for r in spark.table("detector").collect()]
    finally:
        q.stop()
    assert sorted(got) == [("n1", 0), ("n1", 1), ("n1", 2), ("n2", 0), ("n2", 1), ("n2", 2)]


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("get", "k", 120), ("get", "k", 150), ("put", "k", 210), ("get", "k", 2120), ("get", "k", 2120), ("get", "z", 90120)], "op string, key string, t long").select("op", "key", F.timestamp_seconds("t").alias("ts"))
    rows.write.parquet(f"{tmp_path}/r")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/r")
    rates = {(r["op"], r["requests"]) for r in _run(request_rates(stream(), "ts"), "append", spark, "rates").collect()}
    assert ("get", 2) in rates and ("put", 1) in rates
    assert _run(deduplicated(stream(), ["op", "key", "ts"], "ts"), "append", spark, "dedup").count() == 5
    found = {(r["key"], r["writes"]) for r in _run(sessions(stream(), "ts"), "append", spark, "sess").collect()}
    assert ("k", 3) in found and ("k", 2) in found
