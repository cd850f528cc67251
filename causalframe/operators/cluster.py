"""A modelled cluster: members, a ring, replicas as a table, and the client's verbs over whole tables of keys."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.config import ClusterConfig
from causalframe.operators import membership, quorum, repair, ring
from causalframe.operators.reconcile import contexts, reconcile
from causalframe.sources.shared import saved, small

REPLICAS = "node_id string, key string, seq long, data string, versions map<string,bigint>, ts timestamp, is_tombstone boolean"
HINTS = "holder string, for_node string, key string, seq long, data string, versions map<string,bigint>, ts timestamp, is_tombstone boolean"
VERSION = ["key", "seq", "data", "versions", "ts", "is_tombstone"]


@dataclass(frozen=True)
class Cluster:
    """members: node_id, status, heartbeat (and ord, the order of joining). Every verb returns tables, or another Cluster.

    What a verb writes is saved as a table in the shared folder, so that plans do not grow with the number of verbs.
    """

    members: DataFrame
    config: ClusterConfig
    replicas: DataFrame
    hints: DataFrame

    @classmethod
    def start(cls, members: DataFrame, config: ClusterConfig = ClusterConfig()) -> Cluster:
        spark = members.sparkSession
        return cls(members, config, spark.createDataFrame([], REPLICAS), spark.createDataFrame([], HINTS))

    @cached_property
    def ring(self) -> DataFrame:
        return saved(ring.tokens(self.members, self.config.vnodes), "ring")

    @cached_property
    def lists(self) -> DataFrame:
        """The preference list of each token."""
        return saved(ring.preferences(self.ring, self.config.n), "lists")

    def _next(self, **changes: DataFrame) -> Cluster:
        """With changes; the ring of the same members is not made anew."""
        made = replace(self, **changes)
        if "members" not in changes:
            made.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("ring", "lists")})
        return made

    def joined(self, others: DataFrame) -> Cluster:
        """With what other members know merged in."""
        return self._next(members=saved(membership.merge_members(self.members, others), "members"))

    def seen(self, status: DataFrame) -> Cluster:
        """With the status of the members that status (node_id, status) names; the ring stays, as dead members keep their tokens."""
        other = status.select(F.col("node_id").alias("_node"), F.col("status").alias("_status"))
        members = self.members.join(other, F.col("node_id") == F.col("_node"), "left").withColumn("status", F.coalesce("_status", "status"))
        made = replace(self, members=saved(members.select(*self.members.columns), "members"))
        made.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("ring", "lists")})
        return made

    def _asked(self, keys: DataFrame) -> DataFrame:
        """keys with rank, node_id and ok (whether the node is alive) of each replica."""
        up = self.members.select("node_id", (F.col("status") == 0).alias("ok"))
        return ring.holders(keys, self.lists).join(small(up), "node_id")

    def _write(self, rows: DataFrame, tombstone: bool) -> tuple[Cluster, DataFrame]:
        owners = ring.coordinators(rows, self.ring).drop("position")
        versions = saved(quorum.written_versions(owners, self.config.max_clock_size, tombstone), "writes")
        asked = saved(self._asked(versions.select("key", "seq").distinct()).select("key", "seq", "node_id", "ok", F.struct("key", "seq").alias("req_id")), "asked")
        status = quorum.write_status(asked.select("req_id", "ok"), self.config.w).select("req_id.*", "acks", "status")
        stored = asked.where("ok").select("key", "seq", "node_id").join(versions, ["key", "seq"])
        left = quorum.hints(asked.select("req_id", "key", "node_id", "ok")).select(F.col("req_id.key").alias("key"), F.col("req_id.seq").alias("seq"), "holder", "for_node")
        hinted = self.hints.unionByName(left.join(versions, ["key", "seq"]).select("holder", "for_node", *VERSION))
        return self._with(stored)._next(hints=saved(hinted, "hints")), status

    def _with(self, sent: DataFrame) -> Cluster:
        """With versions put on their nodes; only the keys that a node is sent are reconciled, the others pass by."""
        sent = saved(sent.select("node_id", *VERSION), "sent")
        touched = sent.select("node_id", "key").distinct()
        held = self.replicas.join(touched, ["node_id", "key"], "left_semi").unionByName(sent)
        rest = self.replicas.join(touched, ["node_id", "key"], "left_anti").select("node_id", *VERSION)
        return self._next(replicas=saved(rest.unionByName(reconcile(saved(held, "touched"), ["node_id", "key"]).select("node_id", *VERSION)), "replicas"))

    def put(self, rows: DataFrame) -> tuple[Cluster, DataFrame]:
        """(cluster, status by key and seq). rows: key, seq, data, context (null for none), ts; differ in (key, seq)."""
        return self._write(rows, False)

    def delete(self, rows: DataFrame) -> tuple[Cluster, DataFrame]:
        """As put, of tombstones."""
        return self._write(rows.withColumn("data", F.lit(None).cast("string")), True)

    def get(self, keys: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
        """(surviving versions by key, key with status and context) of what the first r live replicas in the list hold."""
        keys = keys.select("key").distinct()
        held = self.replicas.groupBy("node_id", "key").agg(F.count("*").cast("int").alias("n_values"))
        asked = self._asked(keys).join(held, ["node_id", "key"], "left").select(F.col("key").alias("req_id"), "key", "node_id", F.col("rank").cast("long").alias("arrival_ns"), "ok", F.coalesce("n_values", F.lit(0)).alias("n_values"))
        asked = saved(asked, "asked")
        used = quorum.first_responses(asked, self.config.r).select("key", "node_id")
        status = quorum.read_status(asked, self.config.r)
        got = used.join(status.where("status = 'ok'").select(F.col("req_id").alias("key")), "key", "left_semi").join(self.replicas, ["key", "node_id"])
        got = saved(got, "got")
        found = status.select(F.col("req_id").alias("key"), "status").join(contexts(got), "key", "left")
        return reconcile(got, dedupe=dedupe).select(*VERSION), found

    def read_repaired(self, keys: DataFrame) -> Cluster:
        """With the latest versions of keys on each of their live replicas."""
        mine = self.replicas.join(keys.select("key").distinct(), "key", "left_semi")
        due = saved(self._asked(keys.select("key").distinct()).where("ok").select("key", "node_id"), "due")
        sent = repair.repairs(mine, due).select("node_id", *VERSION)
        return self._with(sent)

    def hints_delivered(self) -> Cluster:
        """With hints applied on those of their targets that are alive; the others are kept."""
        done, kept = repair.deliver(self.hints, self.members)
        sent = done.select(F.col("for_node").alias("node_id"), *VERSION)
        return self._with(sent)._next(hints=saved(kept, "hints"))

    def synced(self, one: str, other: str) -> Cluster:
        """With the keys on which two nodes differ exchanged both ways, in the ranges that both hold; ranges of equal Merkle roots are left alone."""
        a, b = (self.replicas.where(F.col("node_id") == n) for n in (one, other))
        ranges = saved(repair.differing_ranges(a, b, saved(repair.shared_ranges(self.ring, self.lists, one, other), "shared")), "differing")
        mine, theirs = (saved(repair.keys_in_ranges(x, ranges).select(*x.columns), "exchanged") for x in (a, b))
        sent = repair.push(theirs, mine).withColumn("node_id", F.lit(one)).unionByName(repair.push(mine, theirs).withColumn("node_id", F.lit(other)))
        return self._with(sent)

    def local_get(self, node_id: str, keys: DataFrame) -> DataFrame:
        """What one node itself holds of keys."""
        return self.replicas.where(F.col("node_id") == node_id).join(keys.select("key").distinct(), "key", "left_semi").select("key", *VERSION[1:])

    def local_put(self, node_id: str, versions: DataFrame) -> Cluster:
        """With versions put on one node, as a replica is sent them."""
        return self._with(versions.withColumn("node_id", F.lit(node_id)))
