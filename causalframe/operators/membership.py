"""Member tables, and failure detection from heartbeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions.clock import JSON_TIME
from causalframe.functions.predicates import member_alive
from causalframe.schema import ALIVE, DEAD, SUSPECTED

STATUS = ((ALIVE, "alive"), (SUSPECTED, "suspected"), (DEAD, "dead"))
#: The approximation 7.1.26 of the error function in Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
MIN_DEVIATION_NS = 10_000_000.0
MAX_CDF = 0.9999


def merge_members(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row a node: the one of the greater heartbeat, the local one of equal heartbeats."""
    columns = local.columns
    both = local.withColumn("_own", F.lit(1)).unionByName(remote.withColumn("_own", F.lit(0)))
    best = both.groupBy("node_id").agg(F.max_by(F.struct(*[c for c in columns if c != "node_id"]), F.struct("heartbeat", "_own")).alias("m"))
    return best.select("node_id", "m.*").select(*columns)


def gossip_pairs(members: DataFrame, round_no: int, seed: int = 0) -> DataFrame:
    """node_id and peer: the live peer that each live node gossips with in a round, by a seeded hash instead of chance."""
    up = members.where(F.col("status") == ALIVE).select("node_id")
    ranked = up.withColumn("r", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|{round_no}|"), F.col("node_id"))), "node_id")) - 1)
    n = ranked.agg(F.count("*").alias("n"))
    step = F.col("r") + 1
    asks = ranked.crossJoin(F.broadcast(n)).withColumn("to", F.when(step == F.col("n"), 0).otherwise(step))
    return asks.join(ranked.select(F.col("r").alias("to"), F.col("node_id").alias("peer")), "to").where("node_id != peer").select("node_id", "peer")


def member_counts(members: DataFrame) -> DataFrame:
    """status (as a word) and members, a row for each status even if none has it."""
    spark = members.sparkSession
    names = spark.createDataFrame(list(STATUS), "status int, name string")
    counts = members.groupBy("status").agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select(F.col("name").alias("status"), F.coalesce("n", F.lit(0)).alias("members"))


def healthy(members: DataFrame, self_id: str | None = None) -> DataFrame:
    return members.where(member_alive() | (F.col("node_id") == self_id) if self_id is not None else member_alive())


def intervals(heartbeats: DataFrame, keep: int = 100) -> DataFrame:
    """node_id, last_ns, n, mean_ns, sd_ns of the last keep gaps between heartbeats. heartbeats: node_id, arrival_ns.

    The last keep + 1 heartbeats of a node are found first, by a rank that Spark limits before the shuffle; only they are
    sorted for gaps.
    """
    order = Window.partitionBy("node_id").orderBy("arrival_ns")
    back = Window.partitionBy("node_id").orderBy(F.desc("arrival_ns"))
    recent = heartbeats.select("node_id", "arrival_ns", F.row_number().over(back).alias("nth")).where(F.col("nth") <= keep + 1)
    last = recent.withColumn("gap", F.col("arrival_ns") - F.lag("arrival_ns").over(order)).where(F.col("nth") <= keep)
    return last.groupBy("node_id").agg(F.max("arrival_ns").alias("last_ns"), F.count("gap").alias("n"), F.avg("gap").alias("mean_ns"), F.stddev_pop("gap").alias("sd_ns"))


def erf(x: Column) -> Column:
    """The error function to seven digits, in closed form."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    y = F.lit(1.0) - poly * F.exp(-z * z)
    return F.when(x < 0, -y).otherwise(y)


def phi(history: DataFrame, now_ns: Column | int, timeout_ns: int, suspect: float = 8.0, dead: float = 16.0) -> DataFrame:
    """history with phi and phi_raw: how suspicious the silence of each node is. history: the result of intervals().

    With two gaps or more, minus the decimal logarithm of the chance that a heartbeat is yet to come, for normal gaps of
    their mean and deviation (10 ms at least); the distribution is cut at 0.9999, so phi is at most 4, and phi_raw is
    the same without that cut. With fewer gaps it rises with the silence in timeouts: 8 at 1.5 and 16 at 2.5. A node
    never heard from is past dead.
    """
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    silence = (now - F.col("last_ns")).cast("double")
    sd = F.greatest(F.col("sd_ns"), F.lit(MIN_DEVIATION_NS))
    cdf = F.lit(0.5) * (F.lit(1.0) + erf((silence - F.col("mean_ns")) / (sd * F.lit(math.sqrt(2)))))
    score = lambda c: F.abs(F.log10(F.lit(1.0) - c))
    simple = simple_phi(silence, timeout_ns, suspect)
    known = F.when(F.col("n") >= 2, score(F.least(cdf, F.lit(MAX_CDF)))).otherwise(simple)
    raw = F.when(F.col("n") >= 2, score(F.least(cdf, F.lit(1.0 - 1e-16)))).otherwise(simple)
    unknown = F.col("last_ns").isNull()
    return history.withColumn("phi", F.when(unknown, dead + 1).otherwise(known)).withColumn("phi_raw", F.when(unknown, dead + 1).otherwise(raw))


def simple_phi(silence: Column, timeout_ns: int, suspect: float = 8.0) -> Column:
    """Half of suspect at one timeout of silence, and suspect more for each further one."""
    over = silence / F.lit(float(timeout_ns)) - 1
    return F.lit(suspect / 2) + over * F.when(over <= 0, F.lit(suspect / 2)).otherwise(F.lit(suspect))


def with_status(scored: DataFrame, suspect: float = 8.0, dead: float = 16.0, self_id: str | None = None) -> DataFrame:
    """scored with status by its phi: dead from dead on, suspected from suspect on. The node itself keeps its status."""
    status = F.when(F.col("phi") >= dead, DEAD).when(F.col("phi") >= suspect, SUSPECTED).otherwise(ALIVE)
    if self_id is not None:
        status = F.when(F.col("node_id") == self_id, F.col("status") if "status" in scored.columns else F.lit(ALIVE)).otherwise(status)
    return scored.withColumn("new_status", status)


def changes(members: DataFrame, scored: DataFrame, suspect: float = 8.0, dead: float = 16.0, self_id: str | None = None) -> DataFrame:
    """node_id, old_status, new_status of the members whose status changes."""
    rows = members.select("node_id", "status").join(scored.select("node_id", "phi"), "node_id", "left").withColumn("phi", F.coalesce("phi", F.lit(dead + 1)))
    return with_status(rows, suspect, dead, self_id).where("status != new_status").select("node_id", F.col("status").alias("old_status"), "new_status")


def add_member(members: DataFrame, rows: DataFrame) -> DataFrame:
    """members with rows put in, or in the place of those of their node_id."""
    return members.join(rows.select("node_id"), "node_id", "left_anti").unionByName(rows)


def nodes_of_status(members: DataFrame, status: int) -> DataFrame:
    return members.where(F.col("status") == status)


def node_status(scored: DataFrame, node_ids: DataFrame) -> DataFrame:
    """node_ids with phi and status; a node that is not known counts as alive."""
    return node_ids.join(scored.select("node_id", "phi", F.col("new_status").alias("status")), "node_id", "left").withColumn("status", F.coalesce("status", F.lit(ALIVE)))


WIRE = "node_id string, address string, status int, heartbeat bigint, tokens array<bigint>, timestamp timestamp"


def to_wire(members: DataFrame) -> DataFrame:
    """node_id and body: each member as JSON on the wire. members: node_id, address, status, heartbeat, tokens, timestamp; missing columns are null."""
    held = [F.col(c) if c in members.columns else F.lit(None).cast(t) for c, t in (f.split(" ", 1) for f in WIRE.split(", "))]
    names = [f.split(" ", 1)[0] for f in WIRE.split(", ")]
    return members.select("node_id", F.to_json(F.struct(*[c.alias(n) for c, n in zip(held, names)]), JSON_TIME).alias("body"))


def from_wire(rows: DataFrame) -> DataFrame:
    """Members of JSON bodies; text that is no JSON gives nulls."""
    return rows.select(F.from_json("body", WIRE, JSON_TIME).alias("m")).select("m.*")
