"""Connected components by alternating large-star and small-star rounds over an edge table.

Each round is two grouped minima and two joins on the node; stars shrink the graph's depth by a factor each
round, so the number of rounds is about the logarithm of the longest chain. Nothing is gathered: hub nodes are
reduced by partial minima before the shuffle, and the joins on a hub are ones that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.scratch import written


#: Links of rounds are written by a few tasks while there are at most so many, 16 bytes each.
FEW = 1_000_000


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that an edge touches; label is the smallest node that it can reach.

    edges: two columns of one orderable type; direction, repeats and self-loops do not matter; rows with a null end
    are no edges. An empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    loops = edges.where(x == y).select(x.alias("node"))
    links = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    links = written(links, "cc")
    mark = _signature(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        anew = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = written(anew.coalesce(8) if mark[0] <= FEW else anew, "cc")
        before, mark = mark, _signature(links)
        if mark == before:
            break
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = links.select(F.col("v").alias("node")).unionByName(loops.join(stars.select("node"), "node", "left_anti")).distinct()
    return stars.unionByName(roots.select("node", F.col("node").alias("label")))
