"""Queries that run through a stream or through files, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalframe.sources.shared import shared_path
from causalframe.sources.segments import read_segments, write_segments
from causalframe.streaming.stateful import SURVIVORS, reconcile_stream

def run_reconcile(versions: DataFrame, files: int = 3) -> DataFrame:
    """The survivors of all keys, by putting versions through reconcile_stream() a file at a time.

    Batches are appended with their number; what a key has at its last batch is what survives. A batch that is run
    again writes its folder anew.
    """
    spark = versions.sparkSession
    source, out = shared_path(spark, "source"), shared_path(spark, "survivors")
    versions.select("key", "seq", "data", "versions", "is_tombstone").repartition(files).write.parquet(source)
    stream = spark.readStream.schema("key string, seq long, data string, versions map<string,bigint>, is_tombstone boolean").option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = reconcile_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(SURVIVORS + ", batch long").parquet(out)
    return rows.withColumn("_last", F.max("batch").over(Window.partitionBy("key"))).where("batch = _last").drop("_last", "batch")


def through_segments(rows: DataFrame) -> DataFrame:
    """rows written as log segments and read back."""
    spark = rows.sparkSession
    path = shared_path(spark, "segments")
    write_segments(rows, path, segment_bytes=64 << 10)
    return read_segments(spark, path)
