"""The series that a node of the store keeps, gathered from events into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalframe.operators import telemetry

#: The series by name behind the prefix, with their kinds, in the order of the text.
SERIES = {
    "request_duration_seconds": ("histogram", "Seconds that requests of clients took."),
    "requests_total": ("counter", "Requests of clients by operation and status."),
    "quorum_total": ("counter", "Operations at a quorum by type and result."),
    "divergent_versions_total": ("counter", "Reads that gave several concurrent versions."),
    "hints_pending": ("gauge", "Hints kept for each node."),
    "hints_delivered_total": ("counter", "Hints that were delivered."),
    "hints_stored_total": ("counter", "Hints that were stored."),
    "hints_delivery_failures_total": ("counter", "Hints that could not be delivered."),
    "gossip_rounds_total": ("counter", "Rounds of gossip."),
    "gossip_duration_seconds": ("histogram", "Seconds that rounds of gossip took."),
    "cluster_members": ("gauge", "Members by status."),
    "antientropy_syncs_total": ("counter", "Rounds of synchronization."),
    "antientropy_keys_synced_total": ("counter", "Keys sent by synchronization."),
    "antientropy_duration_seconds": ("histogram", "Seconds that rounds of synchronization took."),
    "antientropy_syncs_skipped_total": ("counter", "Rounds of synchronization left out by throttling."),
    "read_repairs_total": ("counter", "Repairs that reads began."),
    "read_repairs_failed_total": ("counter", "Repairs that failed."),
    "background_throttled": ("gauge", "Whether background work is throttled (1) or not (0)."),
}


def collected(events: DataFrame, prefix: str = "store_") -> DataFrame:
    """metric, place, line: the text of all series, a head for each even if it has no values.

    events: metric (a name of SERIES), labels, seq, kind and value. Counters sum their values; of gauges kind is set or
    add; histograms observe values. Events of other metrics are not of these series and are left out.
    """
    spark = events.sparkSession
    known = spark.createDataFrame([(i, m, k, h) for i, (m, (k, h)) in enumerate(SERIES.items())], "nth int, metric string, form string, help string")
    mine = events.join(F.broadcast(known.select("metric", "form")), "metric")
    sums = telemetry.counters(mine.where("form = 'counter'"))
    now = telemetry.gauges(mine.where("form = 'gauge'"))
    name = F.concat(F.lit(prefix), "metric")
    plain = sums.unionByName(now).select("metric", "labels", F.lit(0).alias("i"), F.concat(name, "labels", F.lit(" "), telemetry.number(F.col("value"))).alias("line"))
    buckets = telemetry.histogram(mine.where("form = 'histogram'").withColumn("metric", name))
    lines = telemetry.bucket_lines(buckets).withColumn("metric", F.expr(f"substring(metric, {len(prefix) + 1})"))
    heads = [known.select("metric", F.lit("").alias("labels"), F.lit(n).alias("i"), F.concat(F.lit(f"# {word} "), name, F.lit(" "), what).alias("line")) for n, word, what in ((-2, "HELP", "help"), (-1, "TYPE", "form"))]
    whole = plain.unionByName(lines).unionByName(heads[0]).unionByName(heads[1]).join(F.broadcast(known.select("metric", "nth")), "metric")
    order = Window.partitionBy("metric").orderBy((F.col("i") >= 0), F.when(F.col("i") < 0, F.col("i")), "labels", "i")
    return whole.select(name.alias("metric"), "nth", F.row_number().over(order).alias("place"), "line")


def quorum_events(status: DataFrame, kind: str, values: DataFrame | None = None) -> DataFrame:
    """events for collected() of a table of outcomes (req_id, status) of one kind, read or write, and of reads with more than one value in values (req_id, n_values)."""
    result = F.when(F.col("status") == "ok", "success").otherwise("failure")
    rows = status.select(F.lit("quorum_total").alias("metric"), telemetry.labels("type", F.lit(kind), "result", result).alias("labels"), F.col("req_id").alias("seq"), F.lit("inc").alias("kind"), F.lit(1.0).alias("value"))
    if values is None:
        return rows
    many = values.where("n_values > 1").select(F.lit("divergent_versions_total").alias("metric"), F.lit("").alias("labels"), F.col("req_id").alias("seq"), F.lit("inc").alias("kind"), F.lit(1.0).alias("value"))
    return rows.unionByName(many)
