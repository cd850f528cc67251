"""Counters, gauges, histograms, rolling percentiles, and what is decided from them."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The default upper bounds of histogram buckets, in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def labels(*pairs: Column | str) -> Column:
    """{name="value",...} in the order given; an odd last name has an empty value, no names give an empty text."""
    if not pairs:
        return F.lit("")
    given = [F.lit(p) if isinstance(p, str) else p for p in pairs] + [F.lit("")] * (len(pairs) % 2)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(given[i].cast("string"), F.lit("="), quoted(given[i + 1])) for i in range(0, len(given), 2)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def counters(increments: DataFrame) -> DataFrame:
    """metric, labels, value: the sum of increments of each series."""
    return increments.groupBy("metric", "labels").agg(F.sum("value").alias("value"))


def gauges(changes: DataFrame) -> DataFrame:
    """metric, labels, value: of each series the last set value and what was added since. changes: seq, kind (set or add), value.

    Two grouped sums instead of a fold: the place of the last set, then what is at or behind it.
    """
    sets = changes.groupBy("metric", "labels").agg(F.max(F.when(F.col("kind") == "set", F.col("seq"))).alias("_last"))
    since = changes.join(sets, ["metric", "labels"]).where("_last is null or seq > _last or (seq = _last and kind = 'set')")
    return since.groupBy("metric", "labels").agg(F.sum("value").alias("value"))


def histogram(observations: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """metric, labels, le, count, sum, total: cumulative counts of values up to each bound, and +Inf.

    One pass of conditional counts, then a row for each bound; observations are not multiplied by bounds.
    """
    each = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = observations.groupBy("metric", "labels").agg(*each, F.count("value").alias("total"), F.sum("value").alias("sum"))
    buckets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit(len(bounds)).alias("i"), F.lit("+Inf").alias("le"), F.col("total").alias("count")))
    return rows.select("metric", "labels", F.inline(buckets), "sum", "total").select("metric", "labels", "le", "count", "sum", "total", "i")


def number(value: Column) -> Column:
    """A number as short text: whole ones without a point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def exposition(series: DataFrame, help_text: dict[str, str]) -> DataFrame:
    """metric, place, line: the text format of counters and gauges. series: metric, kind, labels, value. Metrics without series have no lines."""
    spark = series.sparkSession
    known = spark.createDataFrame([(m, h) for m, h in help_text.items()], "metric string, help string")
    heads = series.select("metric", "kind").distinct().join(F.broadcast(known), "metric", "left")
    head = heads.select("metric", F.lit(0).alias("rank"), F.lit("").alias("labels"), F.concat(F.lit("# HELP "), "metric", F.lit(" "), F.coalesce("help", F.lit(""))).alias("line"))
    kind = heads.select("metric", F.lit(1).alias("rank"), F.lit("").alias("labels"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "kind").alias("line"))
    rows = series.select("metric", F.lit(2).alias("rank"), "labels", F.concat("metric", "labels", F.lit(" "), number(F.col("value"))).alias("line"))
    lines = head.unionByName(kind).unionByName(rows)
    place = F.row_number().over(Window.partitionBy("metric").orderBy("rank", "labels"))
    return lines.select("metric", place.alias("place"), "line")


def bucket_lines(buckets: DataFrame) -> DataFrame:
    """metric, labels, i, line: the lines of histograms, in order of labels and i. buckets: the result of histogram()."""
    le = F.concat(F.lit('le="'), "le", F.lit('"}'))
    inserted = F.when(F.col("labels") == "", F.concat(F.lit("{"), le)).otherwise(F.concat(F.expr("substring(labels, 1, length(labels) - 1)"), F.lit(","), le))
    bucket = buckets.select("metric", "labels", F.col("i"), F.concat("metric", F.lit("_bucket"), inserted, F.lit(" "), F.col("count").cast("string")).alias("line"))
    once = buckets.where("le = '+Inf'")
    total = once.select("metric", "labels", (F.col("i") + 1).alias("i"), F.concat("metric", F.lit("_sum"), "labels", F.lit(" "), number(F.col("sum"))).alias("line"))
    count = once.select("metric", "labels", (F.col("i") + 2).alias("i"), F.concat("metric", F.lit("_count"), "labels", F.lit(" "), F.col("total").cast("string")).alias("line"))
    return bucket.unionByName(total).unionByName(count)


def histogram_lines(buckets: DataFrame) -> DataFrame:
    """metric, place, line: the text format of histograms. buckets: the result of histogram()."""
    lines = bucket_lines(buckets)
    return lines.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy("labels", "i")).alias("place"), "line")


def percentile(samples: Column, p: float) -> Column:
    """The value at floor((n - 1) p) of the sorted samples; zero of none."""
    i = F.floor((F.size(samples) - 1) * F.lit(p)).cast("int")
    return F.when(F.size(samples) == 0, F.lit(0)).otherwise(F.get(F.array_sort(samples), i))


def latency(samples: DataFrame, window: int = 100) -> DataFrame:
    """node_id, samples, p50, p99 of the last window latencies of each node. samples: node_id, seq, latency_ns.

    Only the last window rows of a node are gathered.
    """
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("seq")))
    last = samples.withColumn("_n", nth).where(F.col("_n") <= window)
    kept = last.groupBy("node_id").agg(F.collect_list("latency_ns").alias("x"))
    return kept.select("node_id", F.size("x").cast("long").alias("samples"), percentile(F.col("x"), 0.5).alias("p50"), percentile(F.col("x"), 0.99).alias("p99"))


def rolling_latency(samples: DataFrame, window: int = 100, p: float = 0.99) -> DataFrame:
    """samples with value: the percentile of the last window latencies of the node at each sample."""
    frame = Window.partitionBy("node_id").orderBy("seq").rowsBetween(-(window - 1), 0)
    return samples.withColumn("value", percentile(F.collect_list("latency_ns").over(frame), p))


def select_coordinator(lists: DataFrame, measured: DataFrame) -> DataFrame:
    """key and node_id of the least p99; nodes without samples are last, the first in the list wins. lists: key, rank, node_id."""
    rows = lists.join(measured.select("node_id", "p99"), "node_id", "left")
    return rows.groupBy("key").agg(F.min_by("node_id", F.struct(F.col("p99").isNull(), "p99", "rank")).alias("node_id"))


def reorder_by_latency(lists: DataFrame, measured: DataFrame) -> DataFrame:
    """lists with new_rank: nodes with samples by p99, then the others in their order."""
    rows = lists.join(measured.select("node_id", "p99"), "node_id", "left")
    order = Window.partitionBy("key").orderBy(F.col("p99").isNull(), "p99", "rank")
    return rows.withColumn("new_rank", F.row_number().over(order) - 1)


ADMISSION = "node_id string, seq long, samples long, p99 long, slots int, throttle boolean"


def admission(samples: DataFrame, checks: DataFrame, threshold_ns: int = 100_000_000, most: int = 10, least: int = 1, window: int = 1000) -> DataFrame:
    """node_id, seq, samples, p99, slots, throttle at each check: background slots after the checks so far.

    samples: node_id, seq, latency_ns; checks: node_id, seq, each behind the sample of its seq. A check with fewer than
    ten samples changes nothing; else slots go down by one while p99 is above the threshold and up by one otherwise,
    between least and most. The fold needs a node's rows in order: they stream through one task, sorted by Spark, and
    only the last window latencies are held.
    """
    least = max(1, min(least, most))
    window = window if window >= 10 else 1000

    def run(parts):
        node, recent, ranked, slots = None, deque(), [], most
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.node_id != node:
                    node, recent, ranked, slots = row.node_id, deque(), [], most
                if row.kind == 0:
                    if len(recent) == window:
                        ranked.pop(bisect_left(ranked, recent.popleft()))
                    recent.append(row.latency_ns)
                    insort(ranked, row.latency_ns)
                    continue
                p99 = ranked[int((len(ranked) - 1) * 0.99)] if ranked else 0
                full = len(ranked) >= 10
                if full:
                    slots = max(least, slots - 1) if p99 > threshold_ns else min(most, slots + 1)
                out.append((node, row.seq, len(ranked), p99, slots, full and p99 > threshold_ns))
            yield pd.DataFrame(out, columns=["node_id", "seq", "samples", "p99", "slots", "throttle"])

    rows = samples.select("node_id", "seq", F.lit(0).alias("kind"), "latency_ns").unionByName(checks.select("node_id", "seq", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("latency_ns")))
    rows = rows.where("node_id is not null and latency_ns is not null")
    return rows.repartition("node_id").sortWithinPartitions("node_id", "seq", "kind").mapInPandas(run, ADMISSION)


def admission_stats(checked: DataFrame, most: int = 10) -> DataFrame:
    """node_id, slots, max_slots, throttled and p99 after the last check of each node. checked: the result of admission()."""
    last = checked.groupBy("node_id").agg(F.max_by(F.struct("slots", "throttle", "p99"), "seq").alias("l"))
    return last.select("node_id", "l.slots", F.lit(most).alias("max_slots"), F.col("l.throttle").alias("throttled"), "l.p99")
