from pyspark.sql import functions as F

from causalframe.llm.warc import audit, in_files


def _kinds(rows):
    return {(r["file"], r["place"], r["kind"], r["digest"] == r["replica_digest"]) for r in rows.collect()}


def test_moved_records(spark):
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 5 + 1).alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    ours = in_files(rows, ["k"], 30)
    shifted = ours.withColumn("offset", F.when(F.col("k").isin(3, 44), F.col("offset") + 1).otherwise(F.col("offset")))
    assert _kinds(audit(ours, shifted, 4)) == {(0, 3, "moved", True), (1, 14, "moved", True)}
    padded = ours.withColumn("length", F.when(F.col("k") == 3, F.col("length") + 1).otherwise(F.col("length")))
    assert _kinds(audit(ours, padded, 4)) == {(0, 3, "moved", True)}
    both = shifted.withColumn("digest", F.when(F.col("k") == 3, "x").otherwise(F.col("digest"))).where("k != 9")
    assert _kinds(audit(ours, both, 4)) == {(0, 3, "damaged", False), (0, 9, "missing", False), (1, 14, "moved", True)}
    one = ours.where("k = 0")
    assert _kinds(audit(one, one.withColumn("offset", F.lit(7).cast("long")), 4)) == {(0, 0, "moved", True)}
    assert audit(ours, ours, 4).count() == 0
