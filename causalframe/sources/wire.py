"""Versions and clocks as JSON on the wire; payloads are base64."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.functions.clock import JSON_TIME

VALUE = "data string, vector_clock struct<versions:map<string,bigint>,timestamp:timestamp>, is_tombstone boolean"


def to_wire(versions: DataFrame) -> DataFrame:
    """key and value: each version as JSON. The clock's time travels."""
    clock = F.struct(F.col("versions"), F.col("ts").alias("timestamp"))
    body = F.struct(F.base64(F.col("data").cast("binary")).alias("data"), clock.alias("vector_clock"), F.col("is_tombstone"))
    return versions.select("key", F.to_json(body, JSON_TIME).alias("value"))


def from_wire(rows: DataFrame) -> DataFrame:
    """key, data, versions, ts, is_tombstone of JSON values; text that is no JSON gives nulls."""
    parsed = rows.select("key", F.from_json("value", VALUE, JSON_TIME).alias("v"))
    return parsed.select("key", F.unbase64("v.data").cast("string").alias("data"), F.col("v.vector_clock.versions").alias("versions"), F.col("v.vector_clock.timestamp").alias("ts"), F.col("v.is_tombstone").alias("is_tombstone"))
