"""Outcomes of reads and writes at a quorum, from tables of replica responses, and what they leave to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions import clock
from causalframe.functions.predicates import not_dead
from causalframe.operators.reconcile import contexts, reconcile
from causalframe.sources.shared import saved


def first_responses(responses: DataFrame, r: int) -> DataFrame:
    """The first r responses of each request, by arrival, that succeeded and hold a value."""
    order = Window.partitionBy("req_id").orderBy("arrival_ns", "node_id")
    return responses.where("ok and n_values > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= r)


def read_status(responses: DataFrame, r: int) -> DataFrame:
    """req_id, answers and status: ok at r answers, timeout at none, else quorum_failed."""
    counts = responses.groupBy("req_id").agg(F.count_if(F.col("ok") & (F.col("n_values") > 0)).alias("answers"))
    status = F.when(F.col("answers") >= r, "ok").when(F.col("answers") == 0, "timeout").otherwise("quorum_failed")
    return counts.withColumn("status", status)


def reads(responses: DataFrame, r: int) -> DataFrame:
    """req_id and asked of requests that reached r answers: the keys and nodes that answered, sorted."""
    used = first_responses(responses, r).where("req_id is not null")
    return used.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("key", "node_id"))).alias("asked")).where(F.size("asked") == r)


def read_sets(asked: DataFrame, replicas: DataFrame, dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(surviving versions by asked, contexts by asked) of each different set of asked: requests that ask the same read the same.

    First each replica's versions of a key are reconciled by themselves, as what one of them drops no set can bring back;
    only those are put together. The survivors' clocks have the greatest counters of all that they dominate.
    """
    sets = asked.select("asked").distinct().select("asked", F.explode("asked").alias("_of")).select("asked", "_of.*")
    wanted = replicas.join(sets.select("key", "node_id").distinct(), ["key", "node_id"], "left_semi")
    held = saved(reconcile(wanted, ["key", "node_id"]), "held")
    got = saved(reconcile(sets.join(held, ["key", "node_id"]), ["asked"], dedupe), "read")
    return got, contexts(got, "asked")


def read(responses: DataFrame, replicas: DataFrame, r: int, dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(surviving versions by req_id and key, contexts by req_id) of requests that reached r answers.

    replicas: node_id and versions. Two replicas in step give each version twice, unless dedupe. Every request has rows of
    its own: read_sets() gives those of the different sets of replicas alone.
    """
    asked = saved(reads(responses, r), "asked")
    got, context = read_sets(asked, replicas, dedupe)
    return asked.join(got, "asked").select("key", "node_id", "req_id", *[c for c in replicas.columns if c not in ("key", "node_id")]), asked.join(context, "asked").select("req_id", "context")


def divergence(survivors: DataFrame, by: str = "req_id") -> DataFrame:
    """by, siblings (as counted by rows) and concurrent (different clocks): whether a read diverged by either count."""
    counts = survivors.groupBy(by).agg(F.count("*").alias("siblings"), F.count_distinct(clock.render(F.col("versions"))).alias("concurrent"))
    return counts.withColumn("diverged", F.col("siblings") > 1).withColumn("truly_diverged", F.col("concurrent") > 1)


def write_status(responses: DataFrame, w: int) -> DataFrame:
    """req_id, acks, failures, status and ref_status of writes and deletes.

    ok at w acknowledgements; timeout at none while some replica has not answered; all_failed if every one failed,
    which ref_status calls a success; else quorum_failed. A replica that has not answered has a null ok.
    """
    counts = responses.groupBy("req_id").agg(F.count_if("ok").alias("acks"), F.count_if(~F.col("ok")).alias("failures"), F.count("*").alias("asked"))
    status = F.when(F.col("acks") >= w, "ok").when(F.col("failures") == F.col("asked"), "all_failed").when(F.col("acks") == 0, "timeout").otherwise("quorum_failed")
    ref = F.when(F.col("status") == "all_failed", "ok").otherwise(F.col("status"))
    return counts.withColumn("status", status).withColumn("ref_status", ref).drop("asked")


def written_versions(requests: DataFrame, max_clock: int, tombstone: bool = False) -> DataFrame:
    """The version that each request's coordinator writes: its context incremented for node_id, then pruned.

    requests: key, seq, node_id, data, context (null for none), ts.
    """
    context = F.coalesce("context", clock.new_clock())
    data = F.lit(None).cast("string") if tombstone else F.col("data")
    return requests.select("key", "seq", data.alias("data"), clock.prune(clock.increment(context, F.col("node_id")), max_clock).alias("versions"), "ts", F.lit(tombstone).alias("is_tombstone"))


def hints(responses: DataFrame) -> DataFrame:
    """req_id, key, holder, for_node: each failed replica's write is kept by a healthy one, taken in turn.

    The i-th failed replica in order of node_id goes to the i-th healthy one, and round again when these run out.
    """
    order = Window.partitionBy("req_id").orderBy("node_id")
    failed = responses.where("not ok").withColumn("i", F.row_number().over(order) - 1).select("req_id", "key", F.col("node_id").alias("for_node"), "i")
    well = responses.where("ok").withColumn("j", F.row_number().over(order) - 1).select("req_id", F.col("node_id").alias("holder"), "j")
    count = well.groupBy("req_id").agg(F.count("*").alias("n"))
    spread = failed.join(count, "req_id").withColumn("j", (F.col("i") % F.col("n")).cast("int"))
    return spread.join(well, ["req_id", "j"]).select("req_id", "key", "holder", "for_node")


def sloppy(lists: DataFrame, members: DataFrame, self_id: str | None = None) -> DataFrame:
    """lists (key, rank, node_id) without dead nodes, ranked anew in the same order; the node itself stays."""
    up = members.where(not_dead(self_id)).select("node_id")
    left = lists.join(up, "node_id", "left_semi")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("rank")) - 1)


def request_metrics(log: DataFrame) -> DataFrame:
    """op, requests, failures, and mean and greatest latency in ms of a log of req_id, op, ok, latency_ns."""
    ms = F.col("latency_ns") / 1e6
    return log.groupBy("op").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))
