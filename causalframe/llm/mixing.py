"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target of words. All its documents are taken as many whole times as fit, and a remaining budget is
fitted exactly by length: documents are counted by source and exact length, a proportional share of every length is
taken, and bounded-knapsack dynamic programming over the counts that are left fills what remains of the budget. Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.llm.scratch import fresh, small, table, written

WEIGHTS = (5.0, 2.0, 1.0)
_SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null counts as none. Linear in long white space, too."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{_SPACE}]+"), "")).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target, one row a source.

    sizes: source and size. Sources in code point order, null last, weigh as weights say, repeating, and share share
    times all sizes; a target above most times its source's size stops there and the excess is shared again by weight.
    The level of that sharing, target = min(cap, level * weight), is found by sorting sources by cap / weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ring = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by = by.withColumn("weight", ring).withColumn("cap", cap).withColumn("turn", F.col("cap") / F.col("weight"))
    up = Window.orderBy("turn", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / heavy)
    level = F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(whole)
    target = F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return by.withColumn("target", target).select("source", "source_size", "target")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = 1 << 16) -> np.ndarray:
    """How many of each length to take, counts at most, so that their words come as near below budget as is found.

    A proportional share of every length is taken first, then single ones of the longest that fit, until at most reach
    words are missing; the rest is bounded-knapsack dynamic programming over words, which is exact there.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * int(budget) // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= reach:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (left - reach + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, min(left, reach))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Exact: the sum nearest below budget. sums holds, as the bits of a whole number, what the lengths so far can make."""
    take = np.zeros(len(lengths), np.int64)
    usable = lengths[(counts > 0) & (lengths > 0) & (lengths <= budget)]
    if not len(usable):
        return take
    budget -= budget % int(np.gcd.reduce(usable))  # no sum lies between
    mask, sums, stages = (1 << (budget + 1)) - 1, 1, []
    for i in np.flatnonzero((counts > 0) & (lengths > 0) & (lengths <= budget))[::-1]:
        length, count, piece = int(lengths[i]), min(int(counts[i]), budget // int(lengths[i])), 1
        while count > 0:
            n = min(piece, count)
            stages.append((i, n, n * length, sums))
            sums |= (sums << (n * length)) & mask
            count, piece = count - n, piece * 2
        if sums >> budget & 1:
            break
    at = sums.bit_length() - 1
    for i, n, words, before in reversed(stages):
        if not before >> at & 1:
            take[i] += n
            at -= words
    return take


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: int = 42, crowd: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of docs.

    size counts words, a null text none; taken is size times copies. Documents are taken whole, each at most the least
    whole number of times that is no less than most. Runs of equal tables agree, whatever the order of rows: which
    documents of one source and length have one copy more goes by a seeded hash of doc_id and text; of repeated rows
    any one may have it. Sources with no words have a target of zero; a null source is a source. Empty: no rows.

    Rows are spread by source, length and hash slice, so that a source, or a length within it, of any size is split.
    """
    chosen = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    rows = written(chosen, "sizes")
    goal = written(targets(rows, share, most, weights), "targets")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = counts.join(goal, counts["source"].eqNullSafe(goal["source"])).drop(goal["source"])

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        whole, aim = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        base = int(aim // whole) if whole else 0
        extra = fit_budget(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), round(aim - base * whole))
        return part.assign(base=base, extra=extra)[["source", "size", "n", "source_size", "target", "base", "extra"]]

    plans = counts.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, base long, extra long")
    plans = written(plans, "plans")
    slices = F.ceil(F.col("n") / F.lit(crowd)).cast("long")
    same = rows["source"].eqNullSafe(plans["source"]) & (rows["size"] == plans["size"])
    spread = rows.join(small(plans), same).select("doc_id", rows["source"], rows["size"], "draw", "source_size", "target", "base", "extra", F.pmod("draw", slices).alias("slice"))
    spread = written(spread, "spread")
    held = spread.where("extra > 0").groupBy("source", "size", "slice").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    order = Window.partitionBy("source", "size").orderBy("slice")
    quota = F.col("extra") - (F.sum("m").over(order) - F.col("m"))
    held = held.select("source", "size", "slice", "m", F.greatest(F.lit(0), F.least(F.col("m"), quota)).cast("long").alias("quota"))
    held = held.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slice").alias("k"), "m", "quota")
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("k"))
    ranked = spread.join(held, on, "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))
    part = ranked.where("quota > 0 and quota < m")
    nth = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    part = part.withColumn("more", (nth <= F.col("quota")).cast("long"))
    rest = ranked.where("not (quota > 0 and quota < coalesce(m, 0))").withColumn("more", (F.col("quota") > 0).cast("long"))
    copies = F.col("base") + F.col("more")
    return part.unionByName(rest).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The rows of docs as often as mix() takes them; the columns of docs.

    Documents with no words cost none of the budget and stay as they are. A doc_id with several rows, and rows without one,
    are told apart by the hash of their columns; of rows that are equal in all columns, one is repeated as often as all are taken.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mark, one = (fresh(docs, n) for n in ("mark", "one"))
    names = {n: fresh(docs, n) for n in ("c", "m", "z")}
    taken = mix(docs.select(F.xxhash64(*columns).alias("doc_id"), "source", "text"), share, most, weights, seed)
    taken = taken.groupBy(F.col("doc_id").alias(mark)).agg(F.sum("copies").alias(names["c"]), F.count("*").alias(names["m"]), F.max("size").alias(names["z"]))
    taken = written(taken, "taken")
    c, m, z = (F.col(names[n]) for n in ("c", "m", "z"))
    named = docs.withColumn(mark, F.xxhash64(*columns)).join(taken, mark)
    if not taken.where(m > 1).isEmpty():
        named = named.where(m == 1).unionByName(named.where(m > 1).dropDuplicates([mark]))
    copies = F.when(z == 0, m).otherwise(c).cast("int")
    return named.where(copies > 0).select(*columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(one)).drop(one)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mix(table(spark, sf_dir, "documents"))
