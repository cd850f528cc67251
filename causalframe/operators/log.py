"""The index of a log and its maintenance. Log rows: segment_id, offset, length, key, data, versions, ts, is_tombstone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions.predicates import key_in, tombstone_expired
from causalframe.operators.reconcile import reconcile

HEADER = 32


def index(log: DataFrame) -> DataFrame:
    """key, segment_id, offset, ts of each entry."""
    return log.select("key", "segment_id", "offset", "ts")


def index_latest(pointers: DataFrame) -> DataFrame:
    """Of each key the pointer of the latest time; of several, the first in the log."""
    best = F.max_by(F.struct("segment_id", "offset", "ts"), F.struct(F.col("ts"), -F.col("segment_id"), -F.col("offset"))).alias("p")
    return pointers.groupBy("key").agg(best).select("key", "p.*")


def set_pointers(pointers: DataFrame, anew: DataFrame) -> DataFrame:
    """pointers with those of the keys in anew replaced."""
    return pointers.join(anew.select("key").distinct(), "key", "left_anti").unionByName(anew)


def delete_keys(pointers: DataFrame, keys: DataFrame) -> DataFrame:
    """pointers without those of the keys in keys. That of no keys, an index that is cleared, is pointers.limit(0)."""
    return pointers.join(keys.select("key").distinct(), "key", "left_anti")


def keys_of(pointers: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The different keys of an index, or those from start to before end."""
    keys = pointers.select("key").distinct()
    return keys if start is None else keys.where(key_in(F.col("key"), start, end))


def size(pointers: DataFrame) -> DataFrame:
    """keys and pointers: how many of both an index has."""
    return pointers.agg(F.count_distinct("key").alias("keys"), F.count("*").alias("pointers"))


def remove_segment(pointers: DataFrame, segment_id: int) -> DataFrame:
    return pointers.where(F.col("segment_id") != segment_id)


def lookup(pointers: DataFrame, log: DataFrame) -> DataFrame:
    """The entries that pointers name, without tombstones."""
    return log.join(pointers.select("segment_id", "offset"), ["segment_id", "offset"], "left_semi").where("not is_tombstone")


def segment_stats(log: DataFrame) -> DataFrame:
    """segment_id, entries, bytes (the header's included) and first and last offset."""
    return log.groupBy("segment_id").agg(F.count("*").alias("entries"), (F.sum("length") + HEADER).alias("bytes"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def rotate(rows: DataFrame, segment_bytes: int, order: str = "seq", stream: str | None = None) -> DataFrame:
    """order, stream, length, segment_no and offset of rows: a segment is closed by the entry that would go beyond segment_bytes.

    That entry starts the next segment, behind its header; one that fits in no segment has one of its own. Where a
    segment ends depends on all before it, so a stream (a writer; without one, all rows are of one) passes through one
    task, sorted by Spark, of which a number is held. Entries of one place in order may come in any order.
    """
    by = [stream] if stream else []
    chosen = rows.select(*by, order, "length")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, segment, size = object(), 0, HEADER
        for part in parts:
            segments, offsets = [], []
            owners = part[stream].tolist() if stream else [None] * len(part)
            for owner, length in zip(owners, part["length"].tolist()):
                if owner != at:
                    at, segment, size = owner, 0, HEADER
                if size > HEADER and size + length > segment_bytes:
                    segment, size = segment + 1, HEADER
                segments.append(segment)
                offsets.append(size)
                size += length
            yield part.assign(segment_no=segments, offset=offsets)

    spread = chosen.repartition(*by) if by else chosen.coalesce(1)
    return spread.sortWithinPartitions(*by, order).mapInPandas(run, ", ".join([*columns, "segment_no long", "offset long"]))


def oldest_segments(log: DataFrame, k: int = 3) -> DataFrame:
    """segment_id of the k oldest segments, none if there are fewer."""
    ids = log.select("segment_id").distinct().orderBy("segment_id").limit(k)
    count = ids.agg(F.count("*").alias("n"))
    return ids.crossJoin(F.broadcast(count)).where(F.col("n") >= k).select("segment_id")


def compact(log: DataFrame, now, ttl_us: int, mode: str = "latest", by: str = "ts") -> DataFrame:
    """What merging segments leaves: of each key the latest entry (latest), or all that survive (causal); no expired tombstones.

    Of entries of one time the first in the log stays. by: the column of times, if there is one finer than ts.
    """
    if mode == "causal":
        kept = reconcile(log)
    elif mode == "latest":
        order = Window.partitionBy("key").orderBy(F.desc(by), "segment_id", "offset")
        kept = log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    else:
        raise ValueError(f"unknown mode {mode!r}: it is latest or causal")
    return kept.where(~tombstone_expired(now, ttl_us))


def replace_segments(log: DataFrame, merged: DataFrame, old: DataFrame) -> DataFrame:
    """log with the segments in old replaced by merged."""
    return log.join(old.select("segment_id"), "segment_id", "left_anti").unionByName(merged)
