"""Merkle trees over the sorted keys of each tree: a node of n leaves splits at n div 2, a sole leaf is its own root.

The shape depends on n alone, so each leaf's path is worked out from its place, and digests are folded bottom-up, one
grouped step a level for all trees at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions.hashing import leaf
from causalframe.sources.shared import saved

EMPTY_ROOT = "2e1cfa82b035c26cbbbdae632cea070514eb8b773f616aaeaf668e2f0be8f10d"  # SHA-256 of the word empty


def leaves(rows: DataFrame, by: str = "tree") -> DataFrame:
    """tree, i (place of the key), n (leaves of the tree), key, hash. rows: tree, key, value; keys differ within a tree.

    Rows are range-partitioned by tree and key and saved, so that a large tree is in many parts; a leaf's place is that
    in its part and the number of leaves in the parts before, from a table of one row a tree and part.
    """
    hashed = rows.select(by, "key", leaf(F.col("key"), F.col("value")).alias("hash"))
    parts = saved(hashed.repartitionByRange(by, "key").withColumn("_part", F.spark_partition_id()), "leaves")
    counts = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("n"))
    here = F.row_number().over(Window.partitionBy(by, "_part").orderBy("key")) - 1
    placed = parts.withColumn("_here", here).join(counts, [by, "_part"])
    return placed.select(by, (F.col("_here") + F.col("_before")).cast("long").alias("i"), F.col("n").cast("long").alias("n"), "key", "hash")


def _interval(place: Column, n: Column, depth: int) -> Column:
    """struct(lo, hi): the leaves of the node at depth that holds a place of a tree of n leaves."""
    whole = F.struct(F.lit(0).cast("long").alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2)
        left = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        right = F.struct(middle.alias("lo"), s["hi"].alias("hi"))
        return F.when(s["hi"] - s["lo"] <= 1, s).when(place < middle, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), whole, halve) if depth else whole


def _levels(found: DataFrame, by: str, keep: Callable[[DataFrame], DataFrame] = lambda level: level) -> list[DataFrame]:
    """From the leaves up to the roots: by, n, lo, hi, hash. A level is one grouped step; nodes of one leaf pass through."""
    most = found.agg(F.max("n")).first()[0] or 0
    level = keep(found.select(by, "n", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"), "hash"))
    out = [level]
    for depth in range(max(0, (most - 1).bit_length()) - 1, -1, -1):
        up = level.withColumn("up", _interval(F.col("lo"), F.col("n"), depth))
        pairs = up.groupBy(by, "n", "up").agg(F.min_by("hash", "lo").alias("a"), F.max_by("hash", "lo").alias("b"), F.count("*").alias("c"))
        hashed = F.when(F.col("c") == 1, F.col("a")).otherwise(F.sha2(F.concat("a", "b"), 256))
        level = keep(pairs.select(by, "n", F.col("up.lo").alias("lo"), F.col("up.hi").alias("hi"), hashed.alias("hash")))
        out.append(level)
    return out


def nodes(found: DataFrame, by: str = "tree") -> DataFrame:
    """tree, lo, hi, hash of every node; [lo, hi) are the places of its leaves. found: the result of leaves()."""
    levels = _levels(found, by, lambda level: saved(level, "level"))  # each is read twice
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole.dropDuplicates([by, "lo", "hi"]).select(by, "lo", "hi", "hash")


def roots(rows: DataFrame, by: str = "tree") -> DataFrame:
    """tree, n and root of each tree of rows."""
    return _levels(leaves(rows, by), by)[-1].select(by, "n", F.col("hash").alias("root"))


def update(rows: DataFrame, changed: DataFrame, by: str = "tree") -> DataFrame:
    """rows with those of changed put in, or in their place; trees are folded anew from them."""
    return rows.join(changed.select(by, "key"), [by, "key"], "left_anti").unionByName(changed)


def delete(rows: DataFrame, keys: DataFrame, by: str = "tree") -> DataFrame:
    return rows.join(keys.select(by, "key"), [by, "key"], "left_anti")


def positional_diff(local: DataFrame, remote: DataFrame, by: str = "tree") -> DataFrame:
    """tree, i, key: the local leaves at which descending both trees by position, where hashes differ, ends. Both: tree, key, value.

    Nodes of equal hash are not descended, a local leaf that differs from the remote node at its place is named, and
    where the remote has a leaf and the local tree has not the descent ends without a name. A tree that one side lacks has
    no differences. It is right only for trees of the same keys; key_diff is right for all. One join of each side a level.
    """
    mine, theirs = leaves(local, by), leaves(remote, by)
    a = saved(nodes(mine, by), "nodes").select(by, F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("hash").alias("mine"))
    b = saved(nodes(theirs, by), "nodes").select(by, F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("hash").alias("theirs"))
    whole = lambda rows, n: rows.select(by, F.col("n").alias(n)).distinct()
    zero = F.lit(0).cast("long")
    at = whole(mine, "ha").join(whole(theirs, "hb"), by).select(by, zero.alias("la"), "ha", zero.alias("lb"), "hb")
    found = []
    while True:
        differ = saved(at.join(a, [by, "la", "ha"]).join(b, [by, "lb", "hb"]).where("mine != theirs").drop("mine", "theirs"), "descent")
        if differ.isEmpty():
            break
        found.append(differ.where("ha - la = 1").select(by, F.col("la").alias("i")))
        middle = lambda lo, hi: F.expr(f"{lo} + (({hi} - {lo}) div 2)")
        inner = differ.where("ha - la > 1 and hb - lb > 1").select(by, "la", middle("la", "ha").alias("ma"), "ha", "lb", middle("lb", "hb").alias("mb"), "hb")
        left = inner.select(by, "la", F.col("ma").alias("ha"), "lb", F.col("mb").alias("hb"))
        at = left.unionByName(inner.select(by, F.col("ma").alias("la"), "ha", F.col("mb").alias("lb"), "hb"))
    keys = mine.select(by, "i", "key")
    return reduce(DataFrame.unionByName, found).join(keys, [by, "i"]) if found else keys.limit(0)
