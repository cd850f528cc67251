"""Bringing replicas into step: read repair, pulls and pushes of differences, and delivery of hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.functions import clock
from causalframe.functions.hashing import RING_SIZE, position
from causalframe.operators.reconcile import reconcile, stale
from causalframe.operators.merkle import roots
from causalframe.operators.ring import placement, ranges


def latest(replicas: DataFrame) -> DataFrame:
    """The surviving versions of each key over all replicas, each clock once. replicas: node_id and versions."""
    return reconcile(replicas, dedupe=True).drop("node_id")


def stale_replicas(replicas: DataFrame, holders: DataFrame) -> DataFrame:
    """key, node_id, missing: the replicas that lack some of the latest versions, and how many. A replica without the key lacks all.

    holders: key, node_id of the replicas that should have each key.
    """
    return repairs(replicas, holders).groupBy("key", "node_id").agg(F.count("*").alias("missing"))


def repairs(replicas: DataFrame, holders: DataFrame) -> DataFrame:
    """The writes that read repair sends: node_id and each latest version that it neither has nor has a later one of."""
    due = holders.select("key", "node_id").distinct().join(latest(replicas), "key")
    return stale(replicas, due, ["key", "node_id"])


def pull(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local versions after taking over those remote ones that no local one covers."""
    return reconcile(local.unionByName(stale(local, remote)))


def push(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local versions that the remote lacks."""
    return stale(remote, local)


def key_digests(versions: DataFrame) -> DataFrame:
    """key and digest of a key's set of versions, whatever their order."""
    each = F.md5(F.concat_ws("|", F.coalesce("data", F.lit("")), clock.render(F.col("versions")), F.col("is_tombstone").cast("string")))
    return versions.groupBy("key").agg(F.md5(F.array_join(F.array_sort(F.collect_list(each)), ",")).alias("digest"))


def key_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key and side (local_only, remote_only, differs) of the keys on which two replicas differ. Both: key, digest."""
    both = local.select("key", F.col("digest").alias("mine")).join(remote.select("key", F.col("digest").alias("theirs")), "key", "full")
    side = F.when(F.col("theirs").isNull(), "local_only").when(F.col("mine").isNull(), "remote_only").otherwise("differs")
    return both.where("not (mine <=> theirs)").select("key", side.alias("side"))


def full_exchange(local: DataFrame, remote: DataFrame) -> DataFrame:
    """All keys of both sides: what an exchange without trees sends."""
    return local.select("key").unionByName(remote.select("key")).distinct()


def keys_in_ranges(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """keys with the stop of the ring range that holds each; a range whose start is not below its stop wraps.

    ranges: start (exclusive), stop (inclusive), of one node or all. Ranges are cut by the high byte of the position.
    """
    plain = ranges.where("start < stop").select((F.col("start") + 1).alias("lo"), F.col("stop").alias("hi"), "stop")
    wraps = ranges.where("start >= stop")
    high = wraps.select((F.col("start") + 1).alias("lo"), F.lit(RING_SIZE - 1).alias("hi"), "stop")
    low = wraps.select(F.lit(0).cast("long").alias("lo"), F.col("stop").alias("hi"), "stop")
    spans = plain.unionByName(high).unionByName(low).where("lo <= hi").withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    placed = keys.withColumn("position", position(F.col("key")))
    return placed.join(spans, (F.shiftright(F.col("position"), 24) == F.col("bucket")) & F.col("position").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "bucket")


def shared_ranges(ring_tokens: DataFrame, lists: DataFrame, one: str, other: str) -> DataFrame:
    """start and stop of the ring ranges that two nodes both hold. lists: the result of ring.preferences()."""
    both = lists.where(F.array_contains("nodes", one) & F.array_contains("nodes", other)).select(F.col("position").alias("stop"))
    return ranges(ring_tokens).select("start", "stop").join(both, "stop").select("start", "stop")


def differing_ranges(local: DataFrame, remote: DataFrame, spans: DataFrame) -> DataFrame:
    """start and stop of the ring ranges in spans whose Merkle trees, over the digests of their keys, have different roots."""
    trees = []
    for versions in (local, remote):
        placed = keys_in_ranges(key_digests(versions), spans)
        trees.append(roots(placed.select(F.col("stop").alias("tree"), "key", F.col("digest").alias("value"))))
    mine, theirs = trees[0].select("tree", "root"), trees[1].select("tree", F.col("root").alias("other"))
    return mine.join(theirs, "tree", "full").where("not (root <=> other)").join(spans, F.col("tree") == F.col("stop")).select("start", "stop")


def select_replica(keys: DataFrame, ring: DataFrame, members: DataFrame, n: int, self_id: str) -> DataFrame:
    """key and node_id of the replica to sync with: of the live holders but the node itself, the one of the least hash."""
    live = members.where("status = 0").select("node_id")
    held = placement(keys, ring, n).where(F.col("node_id") != self_id).join(live, "node_id", "left_semi")
    return held.groupBy("key").agg(F.min_by("node_id", F.struct(position(F.concat("key", F.lit("|"), F.col("node_id"))), F.col("node_id"))).alias("node_id"))


def deliver(hints: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hints whose target is alive, the rest). A target that no member is counts as not alive."""
    alive = members.where("status = 0").select(F.col("node_id").alias("for_node"))
    return hints.join(alive, "for_node", "left_semi"), hints.join(alive, "for_node", "left_anti")


def apply_hints(versions: DataFrame, delivered: DataFrame) -> DataFrame:
    """The target's versions after the hints' values are put."""
    return reconcile(versions.unionByName(delivered, allowMissingColumns=True).select(*versions.columns))


def hint_counts(hints: DataFrame) -> DataFrame:
    """holder and the number of its hints."""
    return hints.groupBy("holder").agg(F.count("*").alias("hints"))
