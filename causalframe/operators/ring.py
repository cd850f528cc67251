"""The consistent-hash ring as a small table (position, node_id), and keys placed on it.

A ring has nodes x vnodes rows, so it is a dimension: it is broadcast when counted to be small, and keys find their
successor by an equality join on the high byte of the position with the interval as a residual. No nested-loop join, no
window over all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions.hashing import RING_SIZE, position

BROADCAST_TOKENS = 500_000


def _character(i: Column) -> Column:
    """The character of code point i; that of the replacement where i is no character's."""
    valid = F.when(i.between(0xD800, 0xDFFF) | (i > 0x10FFFF), F.lit(0xFFFD)).otherwise(i)
    return F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")


def tokens(nodes: DataFrame, vnodes: int = 256) -> DataFrame:
    """position, node_id. nodes: node_id, and the order in which nodes joined if it has a column ord.

    The i-th token of a node hashes its id, a colon and the character of code point i. Of nodes with one position the
    last to join owns it.
    """
    if vnodes < 1:
        raise ValueError(f"vnodes = {vnodes}: it must be at least 1")
    order = F.col("ord") if "ord" in nodes.columns else F.col("node_id")
    each = nodes.select("node_id", order.alias("ord"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    spots = each.select(position(F.concat("node_id", F.lit(":"), _character(F.col("i")))).alias("position"), "node_id", "ord")
    return spots.groupBy("position").agg(F.max_by("node_id", "ord").alias("node_id"))


def explicit_tokens(members: DataFrame) -> DataFrame:
    """position, node_id of nodes with given tokens: node_id, tokens."""
    return members.select(F.explode("tokens").alias("position"), "node_id").groupBy("position").agg(F.max("node_id").alias("node_id"))


def without(ring: DataFrame, node_id: str) -> DataFrame:
    return ring.where(F.col("node_id") != node_id)


def stats(ring: DataFrame) -> DataFrame:
    """node_id and the number of its tokens."""
    return ring.groupBy("node_id").agg(F.count("*").alias("tokens"))


def ranges(ring: DataFrame) -> DataFrame:
    """node_id, start (exclusive) and stop (inclusive) of each token's range; the first starts at the last position and wraps."""
    order = Window.orderBy("position")
    last = F.max("position").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ring.select("node_id", F.coalesce(F.lag("position").over(order), last).alias("start"), F.col("position").alias("stop"))


def preferences(ring: DataFrame, n: int) -> DataFrame:
    """position and nodes: the first n different nodes clockwise from each token, its owner first.

    The ring is walked by a window over its own rows, which reaches twice as far for as long as some list is short of n
    nodes and of all nodes; so fewer nodes than n give shorter lists, and the rows gathered are about those that are needed.
    """
    facts = ring.agg(F.count("*").alias("tokens"), F.count_distinct("node_id").alias("nodes")).first()
    wanted = min(n, facts["nodes"])
    twice = ring.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    reach = 4 * max(n, 1)
    while True:
        ahead = Window.orderBy("lap", "position").rowsBetween(Window.currentRow, min(reach, facts["tokens"]))
        near = F.slice(F.array_distinct(F.collect_list("node_id").over(ahead)), 1, n)
        walked = twice.select("lap", "position", near.alias("nodes")).where("lap = 0").select("position", "nodes")
        if reach >= facts["tokens"] or walked.where(F.size("nodes") < wanted).isEmpty():
            return walked
        reach *= 2


def _intervals(ring: DataFrame, columns: list[str]) -> DataFrame:
    """lo, hi (closed), bucket and columns for the stretch of keys that each token is the successor of."""
    order = Window.orderBy("position")
    rows = ring.withColumn("lo", F.coalesce(F.lag("position").over(order) + 1, F.lit(0).cast("long")))
    first = ring.orderBy("position").limit(1)
    last = ring.agg((F.max("position") + 1).alias("lo"))
    wrap = first.crossJoin(last).withColumn("hi", F.lit(RING_SIZE - 1).cast("long")).where("lo <= hi")
    spans = rows.withColumn("hi", F.col("position")).select("lo", "hi", "position", *columns).unionByName(wrap.select("lo", "hi", "position", *columns))
    return spans.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))


def located(keys: DataFrame, ring: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """keys with position and, of the token that succeeds it clockwise, the columns (node_id by default)."""
    columns = columns or ["node_id"]
    spans = _intervals(ring.select("position", *[c for c in columns if c != "position"]), columns).select("lo", "hi", "bucket", *columns)
    spans = F.broadcast(spans) if ring.count() <= BROADCAST_TOKENS else spans
    placed = keys.withColumn("position", position(F.col("key")))
    cond = (F.shiftright(F.col("position"), 24) == F.col("bucket")) & F.col("position").between(F.col("lo"), F.col("hi"))
    return placed.join(spans, cond).drop("lo", "hi", "bucket")


def coordinators(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """keys with position and node_id of the coordinator."""
    return located(keys, ring)


def preference_lists(keys: DataFrame, ring: DataFrame, n: int) -> DataFrame:
    """keys with position and nodes, the n nodes that hold each key, coordinator first."""
    return located(keys, preferences(ring, n), ["nodes"])


def holders(keys: DataFrame, lists: DataFrame) -> DataFrame:
    """placement() of keys by lists, the result of preferences(), which serves many calls."""
    return located(keys, lists, ["nodes"]).select(*keys.columns, "position", F.posexplode("nodes").alias("rank", "node_id"))


def placement(keys: DataFrame, ring: DataFrame, n: int) -> DataFrame:
    """One row for each key and replica: rank (from 0) and node_id."""
    return holders(keys, preferences(ring, n))


def load(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """node_id, n_keys and deviation (per cent from the mean) of the keys that each node coordinates, idle nodes too."""
    counts = coordinators(keys, ring).groupBy("node_id").agg(F.count("*").alias("n"))
    counts = ring.select("node_id").distinct().join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_keys"))
    mean = F.avg("n_keys").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("deviation", (F.col("n_keys") - mean) / mean * 100)
