"""Which versions of a key survive, and what they resolve to.

The maximal versions of all that were ever put are those that reconciling at every put would leave, as dominance is
transitive. So one batch operator replaces the fold, and a stream may apply it to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.functions import clock


def reconcile(versions: DataFrame, by: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """The rows of versions that no version of the same key (or columns by) dominates. Equal clocks all stay, unless dedupe.

    First each key's version of the largest counter sum drops what it dominates: a grouped maximum and one join,
    linear in the rows even of a hot key; any one of that sum will do, as none dominates another. Only what is left is
    compared in pairs, each different clock once. Clocks are compared only where their sums allow it.
    """
    by = by or ["key"]
    rows = versions.withColumn("_total", clock.total(F.col("versions")))
    top = rows.where("versions is not null").groupBy(*by).agg(F.max_by("versions", "_total").alias("_top"), F.max("_total").alias("_most"))
    below = F.coalesce(F.col("_most") > F.col("_total"), F.lit(False)) & clock.dominates(F.col("_top"), F.col("versions"))
    left = rows.join(top, by, "left").where(~below).drop("_top", "_most").withColumn("_clock", clock.render(F.col("versions")))
    clocks = left.select(*by, "_clock", F.col("versions").alias("_other"), F.col("_total").alias("_more")).where("_other is not null").dropDuplicates([*by, "_clock"])
    clocks = clocks.drop("_clock").withColumnsRenamed({c: f"_{c}" for c in by})
    cond = (F.col("_more") > F.col("_total")) & clock.dominates(F.col("_other"), F.col("versions"))
    for c in by:
        cond &= F.col(c) == F.col(f"_{c}")
    kept = left.join(clocks, cond, "left_anti")
    if dedupe:
        kept = kept.dropDuplicates([*by, "_clock", "data", "is_tombstone"])
    return kept.select(*versions.columns)


def contexts(versions: DataFrame, by: str = "key") -> DataFrame:
    """key and context: the merge of all clocks of a key, by nodes, so that no group of clocks is gathered."""
    top = versions.select(by, F.explode("versions").alias("node", "n")).groupBy(by, "node").agg(F.max("n").alias("n"))
    return top.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("context"))


def last_write_wins(versions: DataFrame) -> DataFrame:
    """Of each key the version of the latest time; of several, the first put."""
    columns = [c for c in versions.columns if c != "key"]
    best = F.max_by(F.struct(*columns), F.struct(F.col("ts"), -F.col("seq"))).alias("best")
    return versions.groupBy("key").agg(best).select("key", "best.*")


def reconcile_with(versions: DataFrame, fn: Callable[[list], object], result: str = "string") -> DataFrame:
    """key and data: the application's fn over the payloads of a key's siblings, in the order in which they were put.

    versions should be reconciled, so that groups are a key's few siblings.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        return pd.DataFrame({"key": [part["key"].iloc[0]], "data": [fn(part["data"].tolist())]})

    return versions.select("key", "seq", "data").groupBy("key").applyInPandas(run, f"key string, data {result}")


def merge_carts(versions: DataFrame) -> DataFrame:
    """key and data: JSON carts {user_id, items} merged to the union of their items and the user_id of the last version."""
    cart = F.from_json("data", "user_id string, items array<string>")
    carts = versions.select("key", "seq", cart.alias("cart"))
    users = carts.groupBy("key").agg(F.max_by("cart.user_id", "seq").alias("user_id"))
    items = carts.select("key", F.explode("cart.items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = users.join(items, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return both.select("key", F.to_json(F.struct("user_id", "items")).alias("data"))


def stale(current: DataFrame, latest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rows of latest that no row of current, of the same key, is equal to or after. Clocks are compared only where their sums allow it."""
    by = by or ["key"]
    have = current.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("versions").alias("_have"), clock.total(F.col("versions")).alias("_more"))
    cond = (F.col("_more") >= F.col("_total")) & clock.covers(F.col("_have"), F.col("versions"))
    for c in by:
        cond &= F.col(c) == F.col(f"_{c}")
    return latest.withColumn("_total", clock.total(F.col("versions"))).join(have, cond, "left_anti").select(*latest.columns)
