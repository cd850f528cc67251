"""The verbs of the store over a table of versions. An absent key is no rows.

Two modes: memory reconciles at every put and deletes by removing the key; log appends, deletes by a tombstone without
a clock, and its reads leave tombstones out but not what they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.functions.predicates import key_in, live
from causalframe.operators.reconcile import reconcile
from causalframe.schema import VERSIONS
from causalframe.sources.shared import saved

MODES = ("memory", "log")


class Store:
    """A table of versions with the verbs of one mode; each verb returns a table or another Store, nothing is changed in place."""

    def __init__(self, versions: DataFrame, mode: str = "memory"):
        if mode not in MODES:
            raise ValueError(f"unknown storage {mode!r}: it is one of {', '.join(MODES)}")
        self.versions, self.mode = versions, mode

    @classmethod
    def empty(cls, spark: SparkSession, mode: str = "memory") -> Store:
        return cls(spark.createDataFrame([], VERSIONS), mode)

    def _read(self, rows: DataFrame) -> DataFrame:
        return rows if self.mode == "memory" else rows.where(live())

    def get(self, key: str) -> DataFrame:
        return self._read(self.versions.where(F.col("key") == key))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Of a table with a key column; Spark broadcasts it if it is small."""
        return self._read(self.versions.join(keys.select("key").distinct(), "key", "left_semi"))

    def range(self, start: str, end: str) -> DataFrame:
        return self._read(self.versions.where(key_in(F.col("key"), start, end)))

    def keys(self) -> DataFrame:
        """All keys: sorted in memory mode; with deleted ones in log mode."""
        keys = self.versions.select("key").distinct()
        return keys.orderBy("key") if self.mode == "memory" else keys

    def put(self, rows: DataFrame) -> Store:
        """Only keys that are put are reconciled anew; the others pass by. In memory mode versions are worked out once, and saved with a mark."""
        if self.mode == "log":
            return Store(self.versions.unionByName(rows), self.mode)
        columns, whole = self.versions.columns, F.lit(True)
        touched = rows.select("key").distinct().withColumn("_put", whole)
        marked = self.versions.join(touched, "key", "left").select(*columns, "_put").unionByName(rows.select(*columns, whole.alias("_put")))
        marked = saved(marked, "put")
        return Store(marked.where("_put is null").select(*columns).unionByName(reconcile(marked.where("_put").select(*columns))), self.mode)

    def delete(self, keys: DataFrame, now=None) -> Store:
        if self.mode == "memory":
            return Store(self.versions.join(keys.select("key").distinct(), "key", "left_anti"), self.mode)
        now = F.current_timestamp() if now is None else now
        gone = keys.select("key").distinct().select("key", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("data"), F.create_map().cast("map<string,bigint>").alias("versions"), now.cast("timestamp").alias("ts"), F.lit(True).alias("is_tombstone"))
        return Store(self.versions.unionByName(gone, allowMissingColumns=True), self.mode)


def sweep(versions: DataFrame, now, ttl_us: int, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept versions, removed keys): keys all of whose versions are tombstones of age ttl or more go. keys limits the sweep."""
    cutoff = now - F.expr(f"interval {ttl_us} microseconds")
    tested = versions.join(keys.select("key").distinct(), "key", "left_semi") if keys is not None else versions
    old = F.col("is_tombstone") & (F.col("ts").isNull() | (F.col("ts") <= cutoff))
    removed = tested.groupBy("key").agg(F.bool_and(old).alias("gone")).where("gone").select("key")
    return versions.join(removed, "key", "left_anti"), removed
