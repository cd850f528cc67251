"""Named queries over the driver's tables, each with SQL of another engine that gives the same rows.

A query is declared next to its SQL. Outputs are scalar columns: clocks as text, doubles rounded, no maps or arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from causalframe.config import DAY_US
from causalframe.functions import clock, predicates
from causalframe.functions.hashing import position
from causalframe.functions.predicates import tombstone_expired
from causalframe.operators import log as logs
from causalframe.operators import collector, membership, merkle, quorum, repair, resilience, ring, telemetry
from causalframe.operators.cluster import Cluster
from causalframe.operators.reconcile import contexts, last_write_wins, merge_carts, reconcile, reconcile_with
from causalframe.operators.store import Store, sweep
from causalframe.plans import fixtures as fx
from causalframe.sources import wire
from causalframe.sources.shared import saved, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "timestamp '2024-02-15 00:00:00'"

KV = """with e as (select concat('user:', cast(user_id as varchar)) as key, event_id, event_id % 3 as nd, ts, event_type, value, props from events),
cw as (select *, sum(case when nd = 0 then 1 else 0 end) over p as c0, sum(case when nd = 1 then 1 else 0 end) over p as c1, sum(case when nd = 2 then 1 else 0 end) over p as c2
from e window p as (partition by key order by event_id rows between unbounded preceding and current row)),
kw as (select key, event_id as seq, concat('node', nd) as node_id, props as data, value, ts, event_type = 'error' as is_tombstone,
cast(case when event_type in ('purchase', 'error') or nd = 0 then c0 else 0 end as bigint) as n0, cast(case when event_type in ('purchase', 'error') or nd = 1 then c1 else 0 end as bigint) as n1,
cast(case when event_type in ('purchase', 'error') or nd = 2 then c2 else 0 end as bigint) as n2 from cw),
kv as (select *, concat_ws(',', case when n0 > 0 then concat('node0=', n0) end, case when n1 > 0 then concat('node1=', n1) end, case when n2 > 0 then concat('node2=', n2) end) as clock from kw)"""
STRICT = "b.n0 >= a.n0 and b.n1 >= a.n1 and b.n2 >= a.n2 and (b.n0 > a.n0 or b.n1 > a.n1 or b.n2 > a.n2)"
COVER = "b.n0 >= a.n0 and b.n1 >= a.n1 and b.n2 >= a.n2"
SURV = KV + f", surv as (select * from kv a where not exists (select 1 from kv b where b.key = a.key and {STRICT}))"
REPL = KV + ", rep as (select kv.* exclude (node_id), concat('node', r) as node_id from kv, (select unnest([0, 1, 2]) as r) where seq % 7 != r)"
LATEST = REPL + f", latest as (select distinct key, data, clock, is_tombstone, n0, n1, n2, seq from rep a where not exists (select 1 from rep b where b.key = a.key and {STRICT}))"
RESP = """with rs as (select event_id as req_id, concat('user:', cast(user_id as varchar)) as key, concat('node', r) as node_id, cast((event_id * 7919 + r * 104729) % 1000 as bigint) as arrival_ns,
(event_id + r * 5) % 4 != 0 and event_id % 29 != 0 as ok, cast((event_id * 3 + r) % 4 as int) as n_values from events, (select unnest([0, 1, 2]) as r))"""
RING = """with nd as (select concat('node', i) as node_id, i as ord from range(10) t(i)),
tk as (select cast(concat('0x', substr(md5(concat(node_id, ':', chr(cast(j as int)))), 1, 8)) as bigint) as position, node_id, ord from nd, range(64) u(j)),
ring as (select position, arg_max(node_id, ord) as node_id from tk group by position),
ks as (select key, cast(concat('0x', substr(md5(key), 1, 8)) as bigint) as position from (select distinct concat('user:', cast(user_id as varchar)) as key from events))"""
RINGED = RING + """, co as (select ks.key, ks.position, coalesce(r.node_id, (select arg_min(node_id, position) from ring)) as node_id from ks asof left join ring r on ks.position <= r.position)"""
WALK = RING + """, two as (select position, node_id, 0 as lap from ring union all select position, node_id, 1 from ring),
idx as (select *, row_number() over (order by lap, position) as i from two),
fi as (select a.i, a.position, b.node_id, min(b.i) as first from idx a join idx b on b.i between a.i and a.i + 100 where a.lap = 0 group by a.i, a.position, b.node_id),
pl as (select position, node_id, row_number() over (partition by position order by first) - 1 as rank from fi qualify rank < 3),
co as (select ks.key, ks.position, coalesce(r.position, (select min(position) from ring)) as token from ks asof left join ring r on ks.position <= r.position)"""
MEMB = """with m0 as (select s_name as node_id, concat('10.0.0.', s_suppkey) as address, cast(s_suppkey % 3 as int) as status, cast((s_suppkey * 7) % 50 as bigint) as heartbeat, s_suppkey from supplier),
m1 as (select s_name as node_id, concat('10.0.0.', s_suppkey) as address, cast((s_suppkey + 5) % 3 as int) as status, cast((s_suppkey * 7 + 65) % 50 as bigint) as heartbeat from supplier where s_suppkey % 4 != 1)"""
LAT = "with lat as (select concat('node', event_id % 7) as node_id, event_id as seq, cast(round(value * 1000000) as bigint) as ns from events)"
P99 = LAT + """, w as (select *, row_number() over (partition by node_id order by seq desc) as k from lat qualify k <= 100),
p as (select node_id, count(*) as samples, list_sort(list(ns)) as x from w group by node_id),
ms as (select node_id, samples, x[cast(floor((samples - 1) * 0.5) as int) + 1] as p50, x[cast(floor((samples - 1) * 0.99) as int) + 1] as p99 from p)"""
BEATS = """with b as (select concat('node', event_id % 7) as node_id, epoch_us(ts) * 1000 as t from events),
g as (select node_id, t, t - lag(t) over (partition by node_id order by t) as gap, row_number() over (partition by node_id order by t desc) as k from b),
h as (select node_id, max(t) as last_ns, count(gap) as n, avg(gap) as mean_ns, stddev_pop(gap) as sd_ns from g where k <= 100 group by node_id)"""


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _store(spark, d) -> Store:
    return Store(reconcile(fx.kv(spark, d)))


def _keys(spark, d) -> DataFrame:
    return fx.kv(spark, d).select("key").distinct()


def _ring(spark) -> DataFrame:
    return ring.tokens(fx.nodes(spark), 64)


# Store


@query(SURV + " select key, seq, data, clock, is_tombstone from surv where key = 'user:7'")
def kv_get(spark, d):
    return fx.shown(_store(spark, d).get("user:7"))


@query(SURV + " select key, seq, data, clock, is_tombstone from surv where key in (select concat('user:', s_suppkey) from supplier where s_suppkey % 10 = 3)")
def kv_multi_get(spark, d):
    keys = fx.table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.concat(F.lit("user:"), F.col("s_suppkey").cast("string")).alias("key"))
    return fx.shown(_store(spark, d).multi_get(keys))


@query(SURV + " select key, seq, data, clock, is_tombstone from surv where key >= 'user:10' and key < 'user:12'")
def kv_range(spark, d):
    return fx.shown(_store(spark, d).range("user:10", "user:12"))


@query("select distinct concat('user:', cast(user_id as varchar)) as key from events")
def kv_all_keys(spark, d):
    return Store(fx.kv(spark, d)).keys()


@query(SURV + " select key, count(*) as siblings, cast(sum(seq) as bigint) as ids from surv group by key")
def kv_put_reconcile(spark, d):
    rows = fx.kv(spark, d)
    store = Store(reconcile(rows.where("seq % 2 = 0"))).put(rows.where("seq % 2 = 1"))
    return store.versions.groupBy("key").agg(F.count("*").alias("siblings"), F.sum("seq").alias("ids"))


@query(SURV + " select key, count(*) as siblings from surv where key not in (select concat('user:', n_nationkey) from nation) group by key")
def kv_delete(spark, d):
    gone = fx.table(spark, d, "nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"))
    return _store(spark, d).delete(gone).versions.groupBy("key").agg(F.count("*").alias("siblings"))


@query(KV + " select key, count(*) as live, cast(sum(seq) as bigint) as ids from kv where not is_tombstone group by key")
def kv_live_values(spark, d):
    return Store(fx.kv(spark, d), "log").range("user:", "user;").groupBy("key").agg(F.count("*").alias("live"), F.sum("seq").alias("ids"))


@query("select concat('user:', cast(user_id as varchar)) as key, count(*) as live from events where event_type != 'error' group by user_id")
def kv_log_delete(spark, d):
    return _log_delete(spark, d, _keys(spark, d))


def _log_delete(spark, d, keys: DataFrame) -> DataFrame:
    store = Store(fx.kv(spark, d).drop("node_id", "value"), "log")
    return store.delete(keys, F.lit("2024-06-01")).multi_get(keys).groupBy("key").agg(F.count("*").alias("live"))


# Clocks


@query(KV + " select seq, concat_ws(',', case when n0 > 0 then concat('node0=', n0) end, concat('node1=', n1 + 1), case when n2 > 0 then concat('node2=', n2) end) as clock from kv")
def clock_increment(spark, d):
    return fx.kv(spark, d).select("seq", clock.render(clock.increment(F.col("versions"), "node1")).alias("clock"))


PAIRS = KV + ", pr as (select key, seq, n0, n1, n2, lag(n0) over w as m0, lag(n1) over w as m1, lag(n2) over w as m2 from kv window w as (partition by key order by seq))"


def _pairs(spark, d):
    return fx.kv(spark, d).withColumn("before", F.lag("versions").over(Window.partitionBy("key").orderBy("seq")))


@query(PAIRS + """ select key, seq, case when m0 is null then 'concurrent' when n0 = m0 and n1 = m1 and n2 = m2 then 'equal' when n0 >= m0 and n1 >= m1 and n2 >= m2 then 'after'
when n0 <= m0 and n1 <= m1 and n2 <= m2 then 'before' else 'concurrent' end as ordering from pr""")
def clock_compare(spark, d):
    return _pairs(spark, d).select("key", "seq", clock.compare(F.col("versions"), F.col("before")).alias("ordering"))


@query(KV + """, t as (select key, max(n0) as a, max(n1) as b, max(n2) as c from kv group by key)
select key, concat_ws(',', case when a > 0 then concat('node0=', a) end, case when b > 0 then concat('node1=', b) end, case when c > 0 then concat('node2=', c) end) as context from t""")
def clock_merge(spark, d):
    return contexts(fx.kv(spark, d)).select("key", clock.render(F.col("context")).alias("context"))


@query(KV + """, x as (select seq, unnest([{'v': n0, 'n': 'node0'}, {'v': n1, 'n': 'node1'}, {'v': n2, 'n': 'node2'}]) as s from kv),
y as (select seq, s.v as v, s.n as n, row_number() over (partition by seq order by s.v desc, s.n desc) as k from x where s.v > 0)
select seq, string_agg(concat(n, '=', v), ',' order by n) as clock from y where k <= 2 group by seq""")
def clock_prune(spark, d):
    return fx.kv(spark, d).select("seq", clock.render(clock.prune(F.col("versions"), 2)).alias("clock"))


@query(PAIRS + " select key, seq, coalesce(n0 = m0 and n1 = m1 and n2 = m2, false) as same from pr")
def clock_equals(spark, d):
    return _pairs(spark, d).select("key", "seq", clock.equals(F.col("versions"), F.col("before")).alias("same"))


@query(PAIRS + """, g as (select seq, greatest(n0, coalesce(m0, 0)) as a, greatest(n1, coalesce(m1, 0)) as b, greatest(n2, coalesce(m2, 0)) as c from pr)
select seq, concat_ws(',', case when a > 0 then concat('node0=', a) end, case when b > 0 then concat('node1=', b) end, case when c > 0 then concat('node2=', c) end) as merged from g""")
def clock_merge_pairs(spark, d):
    """By merge() and merge_all() alike; the first version of a key has no clock before it."""
    rows = _pairs(spark, d)
    two, many = clock.merge(F.col("versions"), F.col("before")), clock.merge_all(F.array("versions", F.coalesce("before", clock.new_clock())))
    return rows.select("seq", F.when(clock.equals(two, many), clock.render(two)).alias("merged"))


@query(KV + ", pr as (select seq, data, clock, is_tombstone as gone, lag(data) over w as d, lag(clock) over w as c, lag(is_tombstone) over w as g from kv window w as (partition by key order by seq)) select seq, data is not distinct from d and clock = c and gone = g as same from pr where c is not null")
def same_version(spark, d):
    back = Window.partitionBy("key").orderBy("seq")
    me = F.struct("data", "versions", "is_tombstone")
    rows = fx.kv(spark, d).select("seq", me.alias("me"), F.lag(me).over(back).alias("before")).where("before is not null")
    return rows.select("seq", predicates.same_version(F.col("me"), F.col("before")).alias("same"))


# Reconciliation


@query(SURV + " select key, count(*) as siblings, count(*) filter (where is_tombstone) as tombs, cast(sum(seq) as bigint) as ids from surv group by key")
def reconcile_versions(spark, d):
    rows = reconcile(fx.kv(spark, d))
    return rows.groupBy("key").agg(F.count("*").alias("siblings"), F.count_if("is_tombstone").alias("tombs"), F.sum("seq").alias("ids"))


QUERIES["reconcile"] = QUERIES.pop("reconcile_versions")
ORACLE_SQL["reconcile"] = ORACLE_SQL.pop("reconcile_versions")


@query(REPL + f""", two as (select * from rep where node_id in ('node0', 'node1')), s as (select * from two a where not exists (select 1 from two b where b.key = a.key and {STRICT}))
select key, count(*) as siblings, count(distinct clock) as concurrent, count(*) > 1 as diverged, count(distinct clock) > 1 as truly_diverged from s group by key""")
def divergence(spark, d):
    two = fx.replicas(fx.kv(spark, d)).where("node_id in ('node0', 'node1')")
    return quorum.divergence(reconcile(two), "key")


@query(KV + " select key, max(seq) as seq, arg_max(data, seq) as data from kv where (key, ts) in (select (key, max(ts)) from kv group by key) group by key")
def lww(spark, d):
    return last_write_wins(fx.kv(spark, d)).select("key", "seq", "data")


@query(SURV + " select key, string_agg(data, '+' order by seq) as data from surv group by key")
def app_reconcile(spark, d):
    return reconcile_with(reconcile(fx.kv(spark, d)), "+".join)


@query("""with c as (select o_custkey % 100 as k, o_orderkey, o_custkey, concat('p', l_partkey) as item from orders join lineitem on l_orderkey = o_orderkey),
i as (select distinct k, item from c), u as (select k, cast(arg_max(o_custkey, o_orderkey) as varchar) as u from c group by k)
select concat('cart:', k) as key, concat('{"user_id":"', any_value(u), '","items":[', string_agg(concat('"', item, '"'), ',' order by item), ']}') as data from i join u using (k) group by k""")
def cart_merge(spark, d):
    return _carts(spark, d, fx.table(spark, d, "orders"))


def _carts(spark, d, orders: DataFrame) -> DataFrame:
    lines = orders.join(fx.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    carts = lines.groupBy("o_orderkey", "o_custkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("items"))
    data = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("user_id"), "items"))
    return merge_carts(carts.select(F.concat(F.lit("cart:"), (F.col("o_custkey") % 100).cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), data.alias("data")))


# Ring


@query(RING + " select position, node_id from ring")
def ring_tokens(spark, d):
    return _ring(spark)


@query(RINGED + " select key, position, node_id from co")
def ring_coordinator(spark, d):
    return ring.coordinators(_keys(spark, d), _ring(spark)).select("key", "position", "node_id")


@query(WALK + " select co.key, co.position, string_agg(node_id, ',' order by rank) as nodes from co join pl on pl.position = co.token group by co.key, co.position")
def preference_list(spark, d):
    rows = ring.preference_lists(_keys(spark, d), _ring(spark), 3)
    return rows.select("key", "position", F.array_join("nodes", ",").alias("nodes"))


@query(RINGED + """, n as (select nd.node_id, count(co.key) as n_keys from nd left join co using (node_id) group by nd.node_id)
select node_id, n_keys, round((n_keys - (select avg(n_keys) from n)) / (select avg(n_keys) from n) * 100, 6) as deviation from n""")
def ring_load(spark, d):
    return ring.load(_keys(spark, d), _ring(spark)).select("node_id", "n_keys", F.round("deviation", 6).alias("deviation"))


@query(RING.replace("group by position)", "where node_id != 'node3' group by position)") + """, co as (select ks.key, coalesce(r.node_id, (select arg_min(node_id, position) from ring)) as node_id from ks asof left join ring r on ks.position <= r.position)
select key, node_id from co""")
def ring_remove(spark, d):
    return ring.coordinators(_keys(spark, d), ring.without(_ring(spark), "node3")).select("key", "node_id")


@query(RING + " select node_id, coalesce(lag(position) over (order by position), (select max(position) from ring)) as start, position as stop from ring")
def ring_ranges(spark, d):
    return ring.ranges(_ring(spark))


@query(RING + " select node_id, count(*) as tokens from ring group by node_id")
def ring_stats(spark, d):
    return ring.stats(_ring(spark))


@query(WALK + " select pl.node_id, pl.rank, count(*) as n_keys from co join pl on pl.position = co.token group by pl.node_id, pl.rank")
def placement(spark, d):
    return ring.placement(_keys(spark, d), _ring(spark), 3).groupBy("node_id", "rank").agg(F.count("*").alias("n_keys"))


@query(RINGED + """, rg as (select coalesce(lag(position) over (order by position), (select max(position) from ring)) as start, position as stop, node_id from ring)
select stop, count(*) as n_keys from ks join rg on (start < stop and ks.position > start and ks.position <= stop) or (start >= stop and (ks.position > start or ks.position <= stop)) where node_id = 'node4' group by stop""")
def range_keys(spark, d):
    own = ring.ranges(_ring(spark)).where("node_id = 'node4'")
    return repair.keys_in_ranges(_keys(spark, d), own).groupBy("stop").agg(F.count("*").alias("n_keys"))


# Quorum


@query(RESP + """, a as (select req_id, count(*) filter (where ok and n_values > 0) as answers from rs group by req_id)
select req_id, answers, case when answers >= 2 then 'ok' when answers = 0 then 'timeout' else 'quorum_failed' end as status from a""")
def quorum_get(spark, d):
    return quorum.read_status(fx.responses(spark, d), 2)


@query(RESP + REPL.replace("with e as", ", e as", 1) + f""", f as (select *, row_number() over (partition by req_id order by arrival_ns, node_id) as k from rs where ok and n_values > 0),
g as (select * from f where k <= 2 and req_id in (select req_id from f where k = 2)), v as (select g.req_id, rep.* from g join rep on rep.key = g.key and rep.node_id = g.node_id),
s as (select * from v a where not exists (select 1 from v b where b.req_id = a.req_id and {STRICT})), c as (select req_id, max(n0) as a, max(n1) as b, max(n2) as c from v group by req_id)
select req_id, count(*) as n_values, count(distinct clock) as n_clocks, cast(sum(seq) as bigint) as ids, any_value(concat_ws(',', case when c.a > 0 then concat('node0=', c.a) end, case when c.b > 0 then concat('node1=', c.b) end, case when c.c > 0 then concat('node2=', c.c) end)) as context
from s join c using (req_id) group by req_id""")
def quorum_get_values(spark, d):
    return _values(spark, d, fx.responses(spark, d))


def _values(spark, d, responses: DataFrame) -> DataFrame:
    asked = saved(quorum.reads(responses, 2), "asked")
    got, context = quorum.read_sets(asked, fx.replicas(fx.kv(spark, d)).select("key", "node_id", "seq", "versions"))
    counts = got.groupBy("asked").agg(F.count("*").alias("n_values"), F.count_distinct(clock.render(F.col("versions"))).alias("n_clocks"), F.sum("seq").alias("ids"))
    found = counts.join(context, "asked").withColumn("context", clock.render(F.col("context")))
    return asked.join(found, "asked").select("req_id", "n_values", "n_clocks", "ids", "context")


@query(RESP + """, a as (select req_id, count(*) filter (where ok) as acks, count(*) filter (where not ok) as failures from rs group by req_id)
select req_id, acks, failures, case when acks >= 2 then 'ok' when failures = 3 then 'all_failed' when acks = 0 then 'timeout' else 'quorum_failed' end as status,
case when acks >= 2 or failures = 3 then 'ok' when acks = 0 then 'timeout' else 'quorum_failed' end as ref_status from a""")
def quorum_put(spark, d):
    return quorum.write_status(fx.responses(spark, d), 2)


@query(KV + """ select key, seq, concat_ws(',', case when n0 + (node_id = 'node0')::int > 0 then concat('node0=', n0 + (node_id = 'node0')::int) end, case when n1 + (node_id = 'node1')::int > 0 then concat('node1=', n1 + (node_id = 'node1')::int) end,
case when n2 + (node_id = 'node2')::int > 0 then concat('node2=', n2 + (node_id = 'node2')::int) end) as clock, true as is_tombstone from kv""")
def quorum_delete(spark, d):
    return _deleted(fx.kv(spark, d))


def _deleted(versions: DataFrame) -> DataFrame:
    asks = versions.withColumn("context", F.col("versions"))
    rows = quorum.written_versions(asks, 10, tombstone=True)
    return rows.where("data is null").select("key", "seq", clock.render(F.col("versions")).alias("clock"), "is_tombstone")


HOLD = ", hold as (select distinct key, concat('node', r) as node_id from kv, (select unnest([0, 1, 2]) as r))"
DUE = LATEST + HOLD + f", due as (select h.key, h.node_id, a.seq, a.clock from hold h join latest a using (key) where not exists (select 1 from rep b where b.key = h.key and b.node_id = h.node_id and {COVER}))"


def _holders(spark, d):
    return _keys(spark, d).select("key", F.explode(F.array(*[F.lit(f"node{i}") for i in range(fx.REPLICAS)])).alias("node_id"))


@query(DUE + " select key, node_id, count(*) as missing from due group by key, node_id")
def stale_replicas(spark, d):
    return repair.stale_replicas(fx.replicas(fx.kv(spark, d)), _holders(spark, d))


@query(DUE + " select key, node_id, seq, clock from due")
def read_repair(spark, d):
    rows = repair.repairs(fx.replicas(fx.kv(spark, d)), _holders(spark, d))
    return rows.select("key", "node_id", "seq", clock.render(F.col("versions")).alias("clock"))


HINT = RESP + """, fl as (select req_id, key, node_id as for_node, row_number() over (partition by req_id order by node_id) - 1 as i from rs where not ok),
wl as (select req_id, node_id as holder, row_number() over (partition by req_id order by node_id) - 1 as j, count(*) over (partition by req_id) as n from rs where ok),
hn as (select fl.req_id, fl.key, holder, for_node from fl join wl on fl.req_id = wl.req_id and j = i % n)"""


@query(HINT + " select req_id, key, holder, for_node from hn")
def hints_store(spark, d):
    return quorum.hints(fx.responses(spark, d))


def _up(spark):
    return spark.createDataFrame([("node0", 0), ("node1", 2)], "node_id string, status int")


@query(HINT + " select for_node = 'node0' as delivered, for_node, count(*) as hints from hn group by for_node")
def hints_deliver(spark, d):
    done, kept = repair.deliver(quorum.hints(fx.responses(spark, d)), _up(spark))
    rows = done.withColumn("delivered", F.lit(True)).unionByName(kept.withColumn("delivered", F.lit(False)))
    return rows.groupBy("delivered", "for_node").agg(F.count("*").alias("hints"))


@query(HINT + " select holder, count(*) as hints from hn group by holder")
def hint_counts(spark, d):
    return repair.hint_counts(quorum.hints(fx.responses(spark, d)))


@query(WALK + """, up as (select co.key, pl.node_id, row_number() over (partition by co.key order by pl.rank) - 1 as rank from co join pl on pl.position = co.token where cast(substr(pl.node_id, 5) as int) % 4 != 2)
select key, string_agg(node_id, ',' order by rank) as nodes, count(*) as n from up group by key""")
def sloppy_list(spark, d):
    lists = ring.placement(_keys(spark, d), _ring(spark), 3).select("key", "rank", "node_id")
    members = fx.nodes(spark).select("node_id", (F.col("ord") % 4).cast("int").alias("status"))
    rows = quorum.sloppy(lists, members)
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]), ",").alias("nodes"), F.count("*").alias("n"))


@query("select concat('op', event_id % 2) as op, count(*) as requests, count(*) filter (where event_type = 'error') as failures, round(avg(value), 6) as mean_ms, max(value) as max_ms from events group by event_id % 2")
def request_metrics(spark, d):
    e = fx.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("op"), (F.col("event_id") % 2).cast("string")).alias("op"), (F.col("event_type") != "error").alias("ok"), (F.round(F.col("value") * 100) * 10_000).alias("latency_ns"))
    return quorum.request_metrics(rows).select("op", "requests", "failures", F.round("mean_ms", 6).alias("mean_ms"), F.round("max_ms", 2).alias("max_ms"))


@query("""with e as (select concat('user:', cast(user_id as varchar)) as key, props, event_type = 'error' as gone from events)
select key, 'ok' as status, count(distinct case when not gone then props end) + max(gone::int) as n, max(gone::int) as tombs from e group by key""")
def cluster_put_get(spark, d):
    """Blind writes of one coordinator have equal clocks, so that all different ones are siblings; one node of five is down."""
    return _put_get(spark, fx.kv(spark, d))


def _put_get(spark, versions: DataFrame) -> DataFrame:
    members = fx.nodes(spark, 5).select("node_id", "ord", (F.col("ord") == 4).cast("int").alias("status"), F.lit(1).alias("heartbeat"))
    rows = versions.withColumn("context", F.lit(None).cast("map<string,bigint>")).select("key", "seq", "data", "context", "ts", "is_tombstone")
    up, _ = Cluster.start(members).put(rows.where("not is_tombstone"))
    up, _ = up.delete(rows.where("is_tombstone"))
    got, found = up.get(rows.select("key"))
    counts = got.groupBy("key").agg(F.count("*").alias("n"), F.count_if("is_tombstone").alias("tombs"))
    return found.join(counts, "key").select("key", "status", "n", "tombs")


WALK5 = WALK.replace("range(10)", "range(5)").replace("range(64)", "range(256)")
HELD5 = WALK5 + ", hl as (select co.key, pl.node_id from co join pl on pl.position = co.token), ev as (select concat('user:', cast(user_id as varchar)) as key, event_id, props, event_type = 'error' as gone from events)"


def _members5(spark, down: int | None = 4) -> DataFrame:
    status = (F.col("ord") == down).cast("int") if down is not None else F.lit(0)
    return fx.nodes(spark, 5).select("node_id", "ord", status.alias("status"), F.lit(1).cast("long").alias("heartbeat"))


def _written5(spark, d) -> Cluster:
    """All events put or deleted blindly while node4 is down."""
    rows = fx.kv(spark, d).withColumn("context", F.lit(None).cast("map<string,bigint>")).select("key", "seq", "data", "context", "ts", "is_tombstone")
    up, _ = Cluster.start(_members5(spark)).put(rows.where("not is_tombstone"))
    return up.delete(rows.where("is_tombstone"))[0]


def _up5(spark) -> DataFrame:
    return _members5(spark, None).select("node_id", "status")


def _held5(cluster: Cluster) -> DataFrame:
    return cluster.replicas.groupBy("node_id").agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n_values"))


@query(HELD5 + " select node_id, count(distinct key) as n_keys, count(*) as n_values, cast(0 as bigint) as hints from hl join ev using (key) group by node_id")
def cluster_hints(spark, d):
    """Hints are delivered when the node that was down is back: it then has all that it missed, and no hint is left."""
    back = _written5(spark, d).seen(_up5(spark)).hints_delivered()
    left = back.hints.groupBy(F.col("for_node").alias("node_id")).agg(F.count("*").alias("hints"))
    return _held5(back).join(left, "node_id", "left").withColumn("hints", F.coalesce("hints", F.lit(0).cast("long")))


@query(HELD5 + """ select node_id, count(distinct key) as n_keys, case when node_id = 'node4' then count(distinct (key, gone, case when gone then '' else props end)) else count(*) end as n_values
from hl join ev using (key) group by node_id""")
def cluster_repair(spark, d):
    """The node that was down is back without hints: reads repair it with each different version once."""
    up = _written5(spark, d).seen(_up5(spark))
    return _held5(up.read_repaired(_keys(spark, d)))


def _apart5(spark, d) -> Cluster:
    """Replicas of all versions on the nodes that hold them, without those of seq modulo 7 that is the node's number."""
    up = Cluster.start(_members5(spark, None))
    placed = ring.holders(fx.kv(spark, d).withColumnRenamed("node_id", "writer"), up.lists)
    some = placed.where(F.col("seq") % 7 != F.substring("node_id", 5, 9).cast("long"))
    return up._next(replicas=up.replicas.unionByName(reconcile(some, ["node_id", "key"]).select(*up.replicas.columns)))


@query(KV.replace("with e as", WALK5 + ", e as", 1) + f""", hl as (select co.key, pl.node_id from co join pl on pl.position = co.token),
rp as (select kv.* exclude (node_id), hl.node_id from kv join hl using (key) where seq % 7 != cast(substr(hl.node_id, 5) as bigint)),
rs as (select * from rp a where not exists (select 1 from rp b where b.key = a.key and b.node_id = a.node_id and {STRICT})),
sh as (select x.key from hl x join hl y using (key) where x.node_id = 'node0' and y.node_id = 'node1'),
more as (select a.* exclude (node_id), o.other as node_id from rs a join sh using (key) join (values ('node0', 'node1'), ('node1', 'node0')) o(one, other) on o.one = a.node_id
where not exists (select 1 from rs b where b.key = a.key and b.node_id = o.other and {COVER})),
al as (select key, node_id, seq, n0, n1, n2 from rs union all select key, node_id, seq, n0, n1, n2 from more),
sv as (select * from al a where not exists (select 1 from al b where b.key = a.key and b.node_id = a.node_id and {STRICT}))
select node_id, count(distinct key) as n_keys, count(*) as n_values, cast(sum(seq) as bigint) as ids from sv group by node_id""")
def cluster_sync(spark, d):
    """Two nodes exchange what differs in the ranges that both hold; the other nodes stay as they are."""
    done = _apart5(spark, d).synced("node0", "node1")
    return done.replicas.groupBy("node_id").agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n_values"), F.sum("seq").alias("ids"))


@query(WALK5.replace("range(5)", "range(6)") + " select pl.node_id, pl.rank, pl.node_id != 'node2' as ok, count(*) as n_keys from co join pl on pl.position = co.token group by pl.node_id, pl.rank")
def cluster_join(spark, d):
    """A sixth node joins by gossip, which also brings news of node2: keys are asked of the members and ring after that."""
    news = spark.createDataFrame([("node5", 5, 0, 1), ("node2", 2, 1, 7), ("node3", 3, 2, 0)], "node_id string, ord long, status int, heartbeat long")
    asked = Cluster.start(_members5(spark, None)).joined(news)._asked(_keys(spark, d))
    return asked.groupBy("node_id", "rank", "ok").agg(F.count("*").alias("n_keys"))


@query(SURV + " select key, seq, data, clock, is_tombstone from surv where key in (select concat('user:', n_nationkey) from nation)")
def cluster_local(spark, d):
    """What one node holds after it is sent all versions, half of them at a time."""
    rows, some = fx.kv(spark, d), fx.table(spark, d, "nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"))
    up = Cluster.start(_members5(spark))
    for half in (1, 0):
        up = up.local_put("node3", rows.drop("node_id").where(F.col("seq") % 2 == half))
    return fx.shown(up.local_get("node3", some))


@query(REPL + f", a0 as (select * from rep where node_id = 'node0'), s as (select * from kv a where not exists (select 1 from kv b where b.key = a.key and {STRICT})) select key, count(*) as siblings, cast(sum(seq) as bigint) as ids from s group by key")
def hints_apply(spark, d):
    """The versions that node0 lacks reach it as hints."""
    rows = fx.replicas(fx.kv(spark, d))
    missing = fx.kv(spark, d).where("seq % 7 = 0").select("key", "seq", "data", "versions", "ts", "is_tombstone")
    done = repair.apply_hints(rows.where("node_id = 'node0'").select(*missing.columns), missing)
    return done.groupBy("key").agg(F.count("*").alias("siblings"), F.sum("seq").alias("ids"))


@query(REPL + " select distinct key from rep where node_id = 'node0' and seq % 2 = 0 or node_id = 'node1' and seq % 3 = 0")
def full_exchange(spark, d):
    rows = fx.replicas(fx.kv(spark, d))
    return repair.full_exchange(rows.where("node_id = 'node0' and seq % 2 = 0"), rows.where("node_id = 'node1' and seq % 3 = 0"))


@query("""with t as (select s_name as node_id, cast(concat('0x', substr(md5(concat(s_name, x)), 1, 8)) as bigint) as position from supplier, (values ('a'), ('b')) v(x)), r as (select position, max(node_id) as node_id from t group by position)
select position, node_id from r""")
def ring_explicit(spark, d):
    s = fx.table(spark, d, "supplier")
    given = s.select(F.col("s_name").alias("node_id"), F.array(*[position(F.concat("s_name", F.lit(x))) for x in "ab"]).alias("tokens"))
    return ring.explicit_tokens(given)


# Merkle trees and anti-entropy


LEAF = """with lf as (select n_regionkey as tree, n_name as key, sha256(concat(n_name, n_nationkey)) as hash, row_number() over (partition by n_regionkey order by n_name) - 1 as i, count(*) over (partition by n_regionkey) as n from nation)"""


def _leaf_rows(spark, d, damaged: int | None = None):
    value = F.col("n_nationkey").cast("string")
    value = F.when(F.col("n_nationkey") % damaged == 0, F.concat(value, F.lit("x"))).otherwise(value) if damaged else value
    return fx.table(spark, d, "nation").select(F.col("n_regionkey").alias("tree"), F.col("n_name").alias("key"), value.alias("value"))


@query(LEAF + " select tree, i, n, key, hash from lf")
def merkle_leaves(spark, d):
    return merkle.leaves(_leaf_rows(spark, d))


DEPTH = 12


def folded(leaves: str, name: str) -> str:
    """Tables name0 to name12 of the nodes (tree, lo, hi, hash) of each level of the trees of a table of leaves (tree, i, n, hash), the roots first."""
    parts = [f"{name}_0 as (select tree, i, hash, cast(0 as bigint) as lo0, n as hi0 from {leaves})"]
    for k in range(1, DEPTH + 1):
        lo, hi = f"lo{k - 1}", f"hi{k - 1}"
        middle = f"({lo} + ({hi} - {lo}) // 2)"
        parts.append(f"{name}_{k} as (select *, case when {hi} - {lo} <= 1 or i < {middle} then {lo} else {middle} end as lo{k}, case when {hi} - {lo} <= 1 or i >= {middle} then {hi} else {middle} end as hi{k} from {name}_{k - 1})")
    parts.append(f"{name}p as materialized (select * from {name}_{DEPTH})")
    parts.append(f"{name}{DEPTH} as materialized (select tree, i as lo, i + 1 as hi, hash from {name}p)")
    for k in range(DEPTH - 1, -1, -1):
        parts.append(f"""{name}{k} as materialized (select a.tree, a.lo, a.hi, case when a.hi - a.lo = 1 then l.hash else sha256(concat(l.hash, r.hash)) end as hash from (select distinct tree, lo{k} as lo, hi{k} as hi from {name}p) a
join {name}{k + 1} l on l.tree = a.tree and l.lo = a.lo left join {name}{k + 1} r on r.tree = a.tree and a.hi - a.lo > 1 and r.lo = a.lo + (a.hi - a.lo) // 2)""")
    return ", ".join(parts)


def descended(mine: str, theirs: str) -> str:
    """Tables d0 to d12 of the pairs of nodes that differ, by level, of two folded() tables."""
    nodes = lambda name: " union ".join(f"select * from {name}{k}" for k in range(DEPTH + 1))
    parts = [f"an as materialized ({nodes(mine)}), bn as materialized ({nodes(theirs)})"]
    parts.append(f"s0 as (select a.tree, a.lo as la, a.hi as ha, b.lo as lb, b.hi as hb from {mine}0 a join {theirs}0 b using (tree))")
    for k in range(DEPTH + 1):
        if k:
            halves = "select tree, la, la + (ha - la) // 2 as ha, lb, lb + (hb - lb) // 2 as hb from d{0} where ha - la > 1 and hb - lb > 1 union all select tree, la + (ha - la) // 2, ha, lb + (hb - lb) // 2, hb from d{0} where ha - la > 1 and hb - lb > 1"
            parts.append(f"s{k} as ({halves.format(k - 1)})")
        parts.append(f"d{k} as materialized (select s.* from s{k} s join an a on a.tree = s.tree and a.lo = s.la and a.hi = s.ha join bn b on b.tree = s.tree and b.lo = s.lb and b.hi = s.hb where a.hash != b.hash)")
    return ", ".join(parts)


def _event_leaves(name: str, value: str = "props", only: str = "true") -> str:
    return f"""{name} as (select user_id % 40 as tree, cast(event_id as varchar) as key, sha256(concat(cast(event_id as varchar), {value})) as hash, row_number() over (partition by user_id % 40 order by cast(event_id as varchar)) - 1 as i,
count(*) over (partition by user_id % 40) as n from events where {only})"""


def _event_rows(spark, d):
    e = fx.table(spark, d, "events")
    return e.select((F.col("user_id") % 40).alias("tree"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"))


@query("with " + _event_leaves("lf") + ", " + folded("lf", "h") + " select tree, hi as n, hash as root from h0")
def merkle_root(spark, d):
    return merkle.roots(_event_rows(spark, d))


CHANGED = "case when event_id % 97 = 3 then concat(props, 'x') else props end"


@query("with " + _event_leaves("lf", CHANGED) + ", " + _event_leaves("rf", only="event_id % 53 != 7 or user_id % 40 < 20") + ", " + folded("lf", "h") + ", " + folded("rf", "g") + ", " + descended("h", "g")
       + " select x.tree, x.la as i, lf.key from (" + " union all ".join(f"select tree, la from d{k} where ha - la = 1" for k in range(DEPTH + 1)) + ") x join lf on lf.tree = x.tree and lf.i = x.la")
def merkle_descent(spark, d):
    """Trees below 20 have the same keys on both sides; of the others the remote lacks some, so that places are not those of the same keys."""
    rows = _event_rows(spark, d)
    mine = rows.withColumn("value", F.when(F.col("key").cast("long") % 97 == 3, F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return merkle.positional_diff(mine, rows.where("cast(key as long) % 53 != 7 or tree < 20"))


@query("with " + _event_leaves("lf", CHANGED, "event_id % 31 != 4") + ", " + folded("lf", "h") + " select tree, hi as n, hash as root from h0")
def merkle_update_delete(spark, d):
    rows = _event_rows(spark, d)
    changed = rows.where("cast(key as long) % 97 = 3").withColumn("value", F.concat("value", F.lit("x")))
    return merkle.roots(merkle.delete(merkle.update(rows, changed), rows.where("cast(key as long) % 31 = 4")))


@query(LEAF + """, h as (select tree, max(n) as n, max(hash) filter (where i = 0) as a, max(hash) filter (where i = 1) as b, max(hash) filter (where i = 2) as c, max(hash) filter (where i = 3) as d, max(hash) filter (where i = 4) as e from lf group by tree)
select tree, n, sha256(concat(sha256(concat(a, b)), sha256(concat(c, sha256(concat(d, e)))))) as root from h""")
def merkle_root_five(spark, d):
    return merkle.roots(_leaf_rows(spark, d))


@query(LEAF + " select tree, i, key from lf where key in (select n_name from nation where n_nationkey % 6 = 0)")
def merkle_diff(spark, d):
    return merkle.positional_diff(_leaf_rows(spark, d), _leaf_rows(spark, d, 6))


DIG = REPL + """, dg as (select node_id, key, md5(string_agg(h, ',' order by h)) as digest from (select node_id, key, md5(concat_ws('|', coalesce(data, ''), clock, cast(is_tombstone as varchar))) as h from rep) group by node_id, key)"""


@query(DIG + " select key, digest from dg where node_id = 'node0'")
def version_hash(spark, d):
    return repair.key_digests(fx.replicas(fx.kv(spark, d)).where("node_id = 'node0'"))


@query(DIG + """ select key, case when b.digest is null then 'local_only' when a.digest is null then 'remote_only' else 'differs' end as side
from (select * from dg where node_id = 'node0' and substr(key, 6, 1) != '3') a full join (select * from dg where node_id = 'node1' and substr(key, 6, 1) != '4') b using (key) where a.digest is distinct from b.digest""")
def key_diff(spark, d):
    rows = fx.replicas(fx.kv(spark, d))
    mine = rows.where("node_id = 'node0' and substring(key, 6, 1) != '3'")
    theirs = rows.where("node_id = 'node1' and substring(key, 6, 1) != '4'")
    return repair.key_diff(repair.key_digests(mine), repair.key_digests(theirs))


SIDES = REPL + ", a0 as (select * from rep where node_id = 'node0'), b0 as (select * from rep where node_id = 'node1')"


@query(SIDES + f""", pl as (select * from a0 union all select * from b0 a where not exists (select 1 from a0 b where b.key = a.key and {COVER})),
s as (select * from pl a where not exists (select 1 from pl b where b.key = a.key and {STRICT})) select key, count(*) as siblings, cast(sum(seq) as bigint) as ids from s group by key""")
def anti_entropy_pull(spark, d):
    rows = fx.replicas(fx.kv(spark, d))
    return repair.pull(rows.where("node_id = 'node0'"), rows.where("node_id = 'node1'")).groupBy("key").agg(F.count("*").alias("siblings"), F.sum("seq").alias("ids"))


@query(SIDES + f" select key, seq, clock from a0 a where not exists (select 1 from b0 b where b.key = a.key and {COVER})")
def anti_entropy_push(spark, d):
    rows = fx.replicas(fx.kv(spark, d))
    sent = repair.push(rows.where("node_id = 'node0'"), rows.where("node_id = 'node1'"))
    return sent.select("key", "seq", clock.render(F.col("versions")).alias("clock"))


@query(WALK + """, ho as (select co.key, pl.node_id from co join pl on pl.position = co.token where pl.node_id != 'node1' and cast(substr(pl.node_id, 5) as int) % 3 = 0)
select key, arg_min(node_id, (cast(concat('0x', substr(md5(concat(key, '|', node_id)), 1, 8)) as bigint), node_id)) as node_id from ho group by key""")
def select_replica(spark, d):
    members = fx.nodes(spark).select("node_id", (F.col("ord") % 3).cast("int").alias("status"))
    return repair.select_replica(_keys(spark, d), _ring(spark), members, 3, "node1")


# Membership


@query(MEMB + """, u as (select *, 1 as own from (select node_id, address, status, heartbeat from m0) union all select *, 0 from m1)
select node_id, arg_max(address, (heartbeat, own)) as address, arg_max(status, (heartbeat, own)) as status, max(heartbeat) as heartbeat from u group by node_id""")
def gossip_merge(spark, d):
    return membership.merge_members(fx.members(spark, d), fx.members(spark, d, 5).where("cast(substring(node_id, 10) as long) % 4 != 1"))


@query(MEMB + """ select node_id, address, status, heartbeat from m0 where node_id not in (select node_id from m1) union all select node_id, address, status, heartbeat from m1""")
def member_add(spark, d):
    """Members that are set, whatever their heartbeat."""
    return membership.add_member(fx.members(spark, d), fx.members(spark, d, 5).where("cast(substring(node_id, 10) as long) % 4 != 1"))


@query(MEMB + " select node_id, heartbeat from m0 where status = 0 or node_id = 'Supplier#000000002'")
def member_healthy(spark, d):
    return membership.healthy(fx.members(spark, d), "Supplier#000000002").select("node_id", "heartbeat")


@query(MEMB + ", up as (select node_id, row_number() over (order by md5(concat('3|7|', node_id)), node_id) as r, count(*) over () as n from m0 where status = 0) select a.node_id, b.node_id as peer from up a join up b on b.r = a.r % a.n + 1 where a.node_id != b.node_id")
def gossip_pairs(spark, d):
    return membership.gossip_pairs(fx.members(spark, d), 7, seed=3)


@query(MEMB + """ select node_id, concat('{"node_id":"', node_id, '","address":"', address, '","status":', status, ',"heartbeat":', heartbeat, ',"tokens":[', s_suppkey, '],"timestamp":"2024-02-15T00:00:00.000000Z"}') as body from m0""")
def member_wire(spark, d):
    return membership.to_wire(_wired(spark, d))


@query(MEMB + " select node_id, address, status, heartbeat, s_suppkey as token from m0")
def member_wire_back(spark, d):
    back = membership.from_wire(membership.to_wire(_wired(spark, d)))
    return back.select("node_id", "address", "status", "heartbeat", F.col("tokens")[0].alias("token"))


def _wired(spark, d):
    return fx.members(spark, d).withColumn("tokens", F.array(F.substring("node_id", 10, 9).cast("long"))).withColumn("timestamp", F.expr(NOW).cast("timestamp"))


@query("""with c as (select cast(s_suppkey % 2 as int) as status, count(*) as n from supplier group by 1)
select name as status, coalesce(n, 0) as members from (values (0, 'alive'), (1, 'suspected'), (2, 'dead')) t(status, name) left join c using (status)""")
def member_counts(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_name").alias("node_id"), (F.col("s_suppkey") % 2).cast("int").alias("status"))
    return membership.member_counts(s)


@query(BEATS + " select node_id, last_ns, n, round(mean_ns, 3) as mean_ns, round(sd_ns, 0) as sd_ns from h")
def heartbeat_intervals(spark, d):
    rows = membership.intervals(fx.heartbeats(spark, d))
    return rows.select("node_id", "last_ns", "n", F.round("mean_ns", 3).alias("mean_ns"), F.round("sd_ns", 0).alias("sd_ns"))


SILENCE = "(1706745600000000000 + 60000000000 * (cast(substr(node_id, 5) as bigint) * 7))"
PHI = BEATS + """, z as (select *, (last_ns + 300000000000 * cast(substr(node_id, 5) as bigint) - last_ns - mean_ns) / (greatest(sd_ns, 1e7) * sqrt(2)) as y from h),
t as (select *, 1 / (1 + 0.3275911 * abs(y)) as t from z),
f as (select *, case when y < 0 then -1 else 1 end * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-y * y)) as erf from t),
p as (select node_id, abs(log10(1 - least(0.5 * (1 + erf), 0.9999))) as phi from f)"""


def _phi(spark, d):
    now = F.col("last_ns") + F.lit(300_000_000_000) * F.substring("node_id", 5, 9).cast("long")
    return membership.phi(membership.intervals(fx.heartbeats(spark, d)), now, 5_000_000_000)


@query(PHI + " select node_id, round(phi, 5) + 0.0 as phi from p")
def phi(spark, d):
    return _phi(spark, d).select("node_id", (F.round("phi", 5) + F.lit(0.0)).alias("phi"))


@query(PHI + " select node_id, cast(case when phi >= 3 then 2 when phi >= 0.5 then 1 else 0 end as int) as new_status from p")
def failure_status(spark, d):
    return membership.with_status(_phi(spark, d), 0.5, 3.0).select("node_id", "new_status")


@query(PHI + " select node_id, cast(0 as int) as new_status from p")
def failure_status_defaults(spark, d):
    """At the default thresholds a node with a history is never suspected, as its phi is cut at 4."""
    return membership.with_status(_phi(spark, d)).select("node_id", "new_status")


@query("""with s as (select concat('node', i) as node_id, i * 300.0 / 600 - 1 as over from range(9) t(i)) select node_id, case when i = 8 then 17 else 4 + over * case when over <= 0 then 4 else 8 end end as phi from (select *, cast(substr(node_id, 5) as int) as i from s)""")
def phi_without_history(spark, d):
    """Nodes with a single heartbeat, and one that was never heard from."""
    beats = fx.heartbeats(spark, d).groupBy("node_id").agg(F.max("arrival_ns").alias("arrival_ns"))
    some = fx.nodes(spark, 9).select("node_id").join(membership.intervals(beats), "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = some.withColumn("last_ns", F.when(F.col("node_id") != "node8", F.coalesce("last_ns", F.lit(0).cast("long"))))
    now = F.col("last_ns") + F.lit(300_000_000_000) * F.substring("node_id", 5, 9).cast("long")
    return membership.phi(some, now, 600_000_000_000).select("node_id", "phi")


@query(PHI + """, f2 as (select node_id, cast(case when phi >= 3 then 2 when phi >= 0.5 then 1 else 0 end as int) as status from p),
c as (select concat('node', i) as node_id, cast(i % 2 as int) as old_status, case when i = 1 then 1 else coalesce(status, 2) end as new_status from range(9) t(i) left join f2 on f2.node_id = concat('node', i))
select node_id, old_status, cast(new_status as int) as new_status from c where old_status != new_status""")
def status_changes(spark, d):
    """Of members of status i modulo 2, as node1 sees them: a member never heard from is dead, and node1 is what it was."""
    members = fx.nodes(spark, 9).select("node_id", (F.col("ord") % 2).cast("int").alias("status"))
    return membership.changes(members, _phi(spark, d), 0.5, 3.0, "node1").select("node_id", "old_status", F.col("new_status").cast("int").alias("new_status"))


@query(PHI + ", f2 as (select node_id, cast(case when phi >= 3 then 2 when phi >= 0.5 then 1 else 0 end as int) as status from p) select node_id from f2 where status = 2")
def nodes_dead(spark, d):
    rows = membership.with_status(_phi(spark, d), 0.5, 3.0).withColumn("status", F.col("new_status"))
    return membership.nodes_of_status(rows, 2).select("node_id")


@query(PHI + ", f2 as (select node_id, cast(case when phi >= 3 then 2 when phi >= 0.5 then 1 else 0 end as int) as status from p) select concat('node', i) as node_id, coalesce(status, 0) as status from range(12) t(i) left join f2 on f2.node_id = concat('node', i)")
def node_status(spark, d):
    """Of nodes that were never heard from, too: they count as alive."""
    return membership.node_status(membership.with_status(_phi(spark, d), 0.5, 3.0), fx.nodes(spark, 12)).select("node_id", "status")


# Telemetry


@query(P99 + " select node_id, samples, p50, p99 from ms")
def node_p99(spark, d):
    return telemetry.latency(fx.latencies(spark, d))


def _lists(spark, d):
    return ring.placement(_keys(spark, d), _ring(spark), 3).select("key", "rank", "node_id")


MS = ", ".join(["lat as (" + LAT.split("as (", 1)[1], P99.split(", w as", 1)[1].join(["w as", ""])])


@query(WALK + ", " + MS + """, x as (select co.key, pl.node_id, pl.rank, p99 from co join pl on pl.position = co.token left join ms using (node_id))
select key, arg_min(node_id, (p99 is null, coalesce(p99, 0), rank)) as node_id from x group by key""")
def select_coordinator(spark, d):
    return telemetry.select_coordinator(_lists(spark, d), telemetry.latency(fx.latencies(spark, d)))


@query(WALK + ", " + MS + """, x as (select co.key, pl.node_id, pl.rank, p99 from co join pl on pl.position = co.token left join ms using (node_id))
select key, node_id, rank, row_number() over (partition by key order by p99 is null, p99, rank) - 1 as new_rank from x""")
def reorder_by_latency(spark, d):
    return telemetry.reorder_by_latency(_lists(spark, d), telemetry.latency(fx.latencies(spark, d))).select("key", "node_id", "rank", "new_rank")


@query(LAT + """, w as (select node_id, seq, list(ns) over (partition by node_id order by seq rows between 999 preceding and current row) as x from lat),
s as (select node_id, seq, len(x) as samples, list_sort(x)[cast(floor((len(x) - 1) * 0.99) as int) + 1] as p99 from w),
g as (select *, list(case when samples < 10 then 0 when p99 > 100000000 then -1 else 1 end) over (partition by node_id order by seq rows between unbounded preceding and current row) as st from s)
select node_id, seq, cast(samples as bigint) as samples, p99, cast(list_reduce(st, lambda a, x: case when x = 0 then a else greatest(1, least(10, a + x)) end, 10) as int) as slots, samples >= 10 and p99 > 100000000 as throttle from g""")
def admission_slots(spark, d):
    """A check behind every sample, with the operator's own window."""
    rows = fx.latencies(spark, d)
    return telemetry.admission(rows, rows.select("node_id", "seq"))


@query(ORACLE_SQL["admission_slots"].rsplit("select node_id, seq", 1)[0].rstrip() + """, al as (select node_id, seq, p99, cast(list_reduce(st, lambda a, x: case when x = 0 then a else greatest(1, least(10, a + x)) end, 10) as int) as slots, samples >= 10 and p99 > 100000000 as throttle from g)
select node_id, arg_max(slots, seq) as slots, cast(10 as int) as max_slots, arg_max(throttle, seq) as throttled, arg_max(p99, seq) as p99 from al group by node_id""")
def admission_stats(spark, d):
    rows = fx.latencies(spark, d)
    return telemetry.admission_stats(telemetry.admission(rows, rows.select("node_id", "seq")))


@query("select 'requests' as metric, concat('{op=\"', event_type, '\",node=\"node', event_id % 3, '\"}') as labels, count(*) as value from events group by event_type, event_id % 3")
def counters(spark, d):
    e = fx.table(spark, d, "events")
    named = telemetry.labels("op", F.col("event_type"), "node", F.concat(F.lit("node"), (F.col("event_id") % 3).cast("string")))
    return telemetry.counters(e.select(F.lit("requests").alias("metric"), named.alias("labels"), F.lit(1).cast("long").alias("value")))


GAUGE = """with c as (select user_id % 20 as s, event_id as seq, event_type = 'signup' as st, cast(round(value * 100) as bigint) as v from events), l as (select s, max(seq) filter (where st) as last from c group by s)"""


@query(GAUGE + " select 'open' as metric, concat('{shard=\"', s, '\"}') as labels, cast(sum(v) as bigint) as value from c join l using (s) where last is null or seq > last or (seq = last and st) group by s")
def gauges(spark, d):
    e = fx.table(spark, d, "events")
    rows = e.select(F.lit("open").alias("metric"), telemetry.labels("shard", F.col("user_id") % 20).alias("labels"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "set").otherwise("add").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return telemetry.gauges(rows)


BUCKETS = ("with b as (select * from (values " + ", ".join(f"({i}, '{b:g}', {b!r})" for i, b in enumerate(telemetry.BOUNDS)) + ", (12, '+Inf', 'infinity'::double)) t(i, le, bound)), v as (select concat('{op=\"', event_type, '\"}') as labels, floor(value * 102.4) / 1024 as x from events), "
           "hg as (select labels, le, i, count(*) filter (where x <= bound) as count, sum(x) as sum, count(*) as total from v, b group by labels, le, i)")  # fmt: skip


def _histogram(spark, d):
    e = fx.table(spark, d, "events")
    return telemetry.histogram(e.select(F.lit("latency").alias("metric"), telemetry.labels("op", F.col("event_type")).alias("labels"), (F.floor(F.col("value") * 102.4) / 1024).alias("value")))


@query(BUCKETS + " select 'latency' as metric, labels, le, count, sum, total from hg")
def histogram(spark, d):
    return _histogram(spark, d).select("metric", "labels", "le", "count", "sum", "total")


@query("""with c as (select concat('{op="', event_type, '"}') as labels, count(*) as n from events group by event_type),
l as (select 0 as r, '' as labels, '# HELP requests_total Requests by operation.' as line union all select 1, '', '# TYPE requests_total counter' union all select 2, labels, concat('requests_total', labels, ' ', n) from c)
select 'requests_total' as metric, cast(row_number() over (order by r, labels) as int) as place, line from l""")
def prometheus_text(spark, d):
    e = fx.table(spark, d, "events").select(F.lit("requests_total").alias("metric"), telemetry.labels("op", F.col("event_type")).alias("labels"), F.lit(1).cast("long").alias("value"))
    series = telemetry.counters(e).withColumn("kind", F.lit("counter"))
    return telemetry.exposition(series, {"requests_total": "Requests by operation."})


@query(BUCKETS + """, x as (select labels, i, concat('latency_bucket', substr(labels, 1, length(labels) - 1), ',le="', le, '"} ', count) as line from hg union all select distinct labels, 13, concat('latency_sum', labels, ' ', case when sum = floor(sum) then cast(cast(sum as bigint) as varchar) else cast(sum as varchar) end) from hg union all select distinct labels, 14, concat('latency_count', labels, ' ', total) from hg)
select 'latency' as metric, cast(row_number() over (order by labels, i) as int) as place, line from x""")
def prometheus_histogram(spark, d):
    return telemetry.histogram_lines(_histogram(spark, d)).select("metric", "place", "line")


COLLECTED = "with s as (select * from (values " + ", ".join(f"({i}, '{m}', '{k}', '{h}')" for i, (m, (k, h)) in enumerate(collector.SERIES.items())) + """) t(nth, metric, form, help)),
b as (select * from (values """ + ", ".join(f"({i}, '{b:g}', {b!r})" for i, b in enumerate(telemetry.BOUNDS)) + """, (12, '+Inf', 'infinity'::double)) t(i, le, bound)),
ev as (select event_id, event_type, floor(value * 102.4) / 1024 as x from events),
v as (select 'request_duration_seconds' as metric, concat('{op="', event_type, '"}') as labels, x from ev union all select 'gossip_duration_seconds', '', x from ev where event_id % 10 = 0),
hg as (select metric, labels, i, le, count(*) filter (where x <= bound) as n, sum(x) as sum, count(*) as total from v, b group by metric, labels, i, le),
q as (select event_id as seq, count(*) filter (where (event_id + r * 5) % 4 != 0 and event_id % 29 != 0 and (event_id * 3 + r) % 4 > 0) as answers from events, (select unnest([0, 1, 2]) as r) group by event_id),
sm as (select 'requests_total' as metric, concat('{op="', event_type, '",status="ok"}') as labels, cast(count(*) as varchar) as value from events group by event_type
union all select 'quorum_total', concat('{type="read",result="', case when answers >= 2 then 'success' else 'failure' end, '"}'), cast(count(*) as varchar) from q group by answers >= 2
union all select 'divergent_versions_total', '', cast(count(*) as varchar) from q where answers > 1
union all select 'cluster_members', concat('{status="', n, '"}'), cast(c as varchar) from (values ('alive', 0), ('suspected', 1), ('dead', 2)) t(n, st) join (select cast(s_suppkey % 3 as int) as st, count(*) as c from supplier group by 1) using (st)),
ln as (select metric, 0 as part, -2 as k, '' as labels, 0 as i, concat('# HELP store_', metric, ' ', help) as line from s union all select metric, 0, -1, '', 0, concat('# TYPE store_', metric, ' ', form) from s
union all select metric, 1, 0, labels, 0, concat('store_', metric, labels, ' ', value) from sm
union all select metric, 1, 0, labels, i, concat('store_', metric, '_bucket', case when labels = '' then '{' else concat(substr(labels, 1, length(labels) - 1), ',') end, 'le="', le, '"} ', n) from hg
union all select distinct metric, 1, 0, labels, 13, concat('store_', metric, '_sum', labels, ' ', case when sum = floor(sum) then cast(cast(sum as bigint) as varchar) else cast(sum as varchar) end) from hg
union all select distinct metric, 1, 0, labels, 14, concat('store_', metric, '_count', labels, ' ', total) from hg)
select concat('store_', metric) as metric, cast(nth as int) as nth, cast(row_number() over (partition by metric order by part, k, labels, i) as int) as place, line from ln join s using (metric)"""


@query(COLLECTED)
def collected_text(spark, d):
    """The text of all series, from requests, rounds of gossip, reads at a quorum and members; the others have a head alone."""
    e = fx.table(spark, d, "events")
    named = lambda rows, metric, labels, kind, value: rows.select(F.lit(metric).alias("metric"), labels.alias("labels"), F.col("event_id").alias("seq"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    x, op = F.floor(F.col("value") * 102.4) / 1024, telemetry.labels("op", F.col("event_type"))
    asked = quorum.read_status(fx.responses(spark, d), 2)
    parts = [
        named(e, "requests_total", telemetry.labels("op", F.col("event_type"), "status", "ok"), "inc", F.lit(1)),
        named(e, "request_duration_seconds", op, "observe", x),
        named(e.where("event_id % 10 = 0"), "gossip_duration_seconds", F.lit(""), "observe", x),
        named(e.where("event_id < 3"), "no_series_of_these", F.lit(""), "inc", F.lit(1)),
        collector.quorum_events(asked, "read", asked.select("req_id", F.col("answers").alias("n_values"))),
        membership.member_counts(fx.members(spark, d)).select(F.lit("cluster_members").alias("metric"), telemetry.labels("status", F.col("status")).alias("labels"), F.lit(0).cast("long").alias("seq"), F.lit("set").alias("kind"), F.col("members").cast("double").alias("value")),
    ]
    return collector.collected(reduce(DataFrame.unionByName, parts))


# Maintenance


@query(KV + f", t as (select key, bool_and(is_tombstone and ts <= {NOW} - interval 7 day) as gone, count(*) as n from kv group by key) select key, n as versions from t where not gone")
def tombstone_sweep(spark, d):
    return _swept(fx.kv(spark, d))


def _swept(versions: DataFrame) -> DataFrame:
    kept, _ = sweep(versions, F.expr(NOW), 7 * DAY_US)
    return kept.groupBy("key").agg(F.count("*").alias("versions"))


@query(KV + f", t as (select key, bool_and(is_tombstone and ts <= {NOW} - interval 7 day) as gone, count(*) as n from kv group by key) select key, n as versions from t where not (gone and key in (select concat('user:', n_nationkey) from nation))")
def tombstone_sweep_keys(spark, d):
    """A sweep of some keys alone, here of versions that are old and dead."""
    some = fx.table(spark, d, "nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"))
    kept, _ = sweep(fx.kv(spark, d), F.expr(NOW), 7 * DAY_US, some)
    return kept.groupBy("key").agg(F.count("*").alias("versions"))


@query(KV + f", t as (select seq, is_tombstone and ts < {NOW} - interval 7 day as expired from kv) select expired, count(*) as versions from t group by expired")
def tombstone_expiry(spark, d):
    rows = fx.kv(spark, d).select(tombstone_expired(F.expr(NOW), 7 * DAY_US).alias("expired"))
    return rows.groupBy("expired").agg(F.count("*").alias("versions"))


LOG = KV + ", lg as (select *, seq // 1000 as segment_id, seq as \"offset\", cast(length(data) + 40 as bigint) as length from kv)"


@query(LOG + f""", k as (select *, row_number() over (partition by key order by ts desc, segment_id, "offset") as n from lg where segment_id < 3 and (select count(distinct segment_id) from lg) >= 3)
select key, seq, segment_id from k where n = 1 and not (is_tombstone and ts < {NOW} - interval 7 day)""")
def segment_compact(spark, d):
    log = fx.log(fx.kv(spark, d))
    old = logs.oldest_segments(log, 3)
    return logs.compact(log.join(F.broadcast(old), "segment_id", "left_semi"), F.expr(NOW), 7 * DAY_US).select("key", "seq", "segment_id")


@query(LOG + ' select key, arg_max(segment_id, (ts, -"offset")) as segment_id, arg_max("offset", (ts, -"offset")) as "offset" from lg group by key')
def index_latest(spark, d):
    return logs.index_latest(logs.index(fx.log(fx.kv(spark, d)))).select("key", "segment_id", "offset")


@query(LOG + ' select key, count(*) as pointers, min("offset") as first_offset, max(segment_id) as last_segment from lg group by key')
def index_build(spark, d):
    rows = logs.index(fx.log(fx.kv(spark, d)))
    return rows.groupBy("key").agg(F.count("*").alias("pointers"), F.min("offset").alias("first_offset"), F.max("segment_id").alias("last_segment"))


@query(LOG + ' select key, count(*) as live from lg where segment_id != 2 and not is_tombstone group by key')
def index_lookup(spark, d):
    log = fx.log(fx.kv(spark, d))
    return logs.lookup(logs.remove_segment(logs.index(log), 2), log).groupBy("key").agg(F.count("*").alias("live"))


@query(KV + " select distinct key from kv")
def log_keys(spark, d):
    """In log mode keys include those of which only tombstones are left."""
    return Store(fx.kv(spark, d).where("is_tombstone").unionByName(fx.kv(spark, d)), "log").keys()


@query(LOG + ' select key, segment_id, "offset" from lg where key not in (select concat(\'user:\', n_nationkey) from nation)')
def index_delete(spark, d):
    gone = fx.table(spark, d, "nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"))
    return logs.delete_keys(logs.index(fx.log(fx.kv(spark, d))), gone).select("key", "segment_id", "offset")


@query(LOG + " select distinct key from lg where key >= 'user:10' and key < 'user:12'")
def index_range(spark, d):
    return logs.keys_of(logs.index(fx.log(fx.kv(spark, d))), "user:10", "user:12")


@query(LOG + " select count(distinct key) as keys, count(*) as pointers from lg")
def index_len(spark, d):
    return logs.size(logs.index(fx.log(fx.kv(spark, d))))


@query(LOG + """, anew as (select key, 99 as segment_id, max("offset") as "offset" from lg where key >= 'user:10' and key < 'user:12' group by key)
select key, segment_id, "offset" from lg where key not in (select key from anew) union all select * from anew""")
def index_set(spark, d):
    pointers = logs.index(fx.log(fx.kv(spark, d)))
    some = pointers.where("key >= 'user:10' and key < 'user:12'").groupBy("key").agg(F.lit(99).cast("long").alias("segment_id"), F.max("offset").alias("offset"), F.max("ts").alias("ts"))
    return logs.set_pointers(pointers, some).select("key", "segment_id", "offset")


@query(LOG + ' select segment_id, count(*) as entries, cast(sum(length) + 32 as bigint) as bytes, min("offset") as first_offset, max("offset") as last_offset from lg group by segment_id')
def segment_stats(spark, d):
    return logs.segment_stats(fx.log(fx.kv(spark, d)))


@query(LOG.replace("with e as", "with recursive e as") + """, r as (select node_id, seq, length, row_number() over (partition by node_id order by seq) as i from lg),
f as (select node_id, i, seq, cast(0 as bigint) as segment_no, cast(32 as bigint) as "offset", 32 + length as size from r where i = 1
union all select r.node_id, r.i, r.seq, f.segment_no + (f.size + r.length > 10000)::int, case when f.size + r.length > 10000 then 32 else f.size end, case when f.size + r.length > 10000 then 32 else f.size end + r.length
from f join r on r.node_id = f.node_id and r.i = f.i + 1)
select node_id, seq, segment_no, "offset" from f""")
def segment_rotate(spark, d):
    return logs.rotate(fx.log(fx.kv(spark, d)).drop("offset"), 10_000, stream="node_id").select("node_id", "seq", "segment_no", "offset")


@query(KV + " select key, data, clock, is_tombstone, cast(epoch_us(ts) as bigint) as us from kv")
def wire_json(spark, d):
    back = wire.from_wire(wire.to_wire(fx.kv(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))))
    return back.select("key", "data", clock.render(F.col("versions")).alias("clock"), "is_tombstone", F.unix_micros("ts").alias("us"))


@query(KV + " select seq, clock, cast(epoch_us(ts) as bigint) as us from kv")
def clock_json(spark, d):
    back = fx.kv(spark, d).select("seq", clock.from_json(clock.to_json(F.col("versions"), F.col("ts").cast("timestamp"))).alias("c"))
    return back.select("seq", clock.render(F.col("c.versions")).alias("clock"), F.unix_micros("c.timestamp").alias("us"))


# Resilience


@query("""select attempt, least(500.0::double, 100.0 * pow(2, attempt)) as wait_ms, sum(least(500.0::double, 100.0 * pow(2, attempt))) over (order by attempt) as total_ms from range(6) t(attempt)""")
def backoff_schedule(spark, d):
    return resilience.backoff(spark, resilience.RetryConfig(retries=6, max_ms=500.0))


@query("""with a as (select event_id // 5 as req_id, event_id % 5 as attempt, event_type = 'purchase' as ok, case event_type when 'view' then 'timeout' when 'click' then 'unreachable' when 'signup' then 'circuit_open' when 'error' then 'server_error' end as error from events),
s as (select req_id, coalesce(min(attempt) filter (where ok or coalesce(error not in ('timeout', 'unreachable', 'circuit_open'), true)), max(attempt)) as attempt from a where attempt <= 3 group by req_id)
select req_id, attempt + 1 as tries, ok, error from a join s using (req_id, attempt)""")
def retry_outcomes(spark, d):
    e = fx.table(spark, d, "events")
    code = F.when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "click", "unreachable").when(F.col("event_type") == "signup", "circuit_open").when(F.col("event_type") == "error", "server_error")
    return resilience.retry_outcomes(e.select(F.expr("event_id div 5").alias("req_id"), (F.col("event_id") % 5).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), code.alias("error")))


@query("""with a as (select event_id // 5 as req_id, event_id % 5 as attempt from events), w as (select req_id, attempt, 100 * pow(2, attempt) as base, cast(concat('0x', substr(md5(concat_ws('|', '5', req_id, attempt)), 1, 8)) as bigint) / 4294967296.0::double as u from a)
select req_id, attempt, round(greatest(0.0::double, least(500.0::double, base + (u * 2 - 1) * base * 0.2::double)), 6) as wait_ms from w""")
def backoff_jitter(spark, d):
    e = fx.table(spark, d, "events").select(F.expr("event_id div 5").alias("req_id"), (F.col("event_id") % 5).alias("attempt"))
    return resilience.waits(e, resilience.RetryConfig(max_ms=500.0), seed=5).select("req_id", "attempt", F.round("wait_ms", 6).alias("wait_ms"))


@query("""with recursive a as (select event_id // 5 as req_id, event_id % 5 as attempt, event_type = 'purchase' as ok, case event_type when 'view' then 'timeout' when 'click' then 'unreachable' when 'signup' then 'circuit_open' when 'error' then 'server_error' end as error, ts from events),
s as (select req_id, coalesce(min(attempt) filter (where ok or coalesce(error not in ('timeout', 'unreachable', 'circuit_open'), true)), max(attempt)) as attempt, min(ts) as t from a where attempt <= 3 group by req_id),
o as (select req_id, concat('10.0.1.', req_id % 9) as address, epoch_us(t) * 1000 as ts_ns, attempt + 1 as tries, ok, case when not ok then error end as error, row_number() over (partition by req_id % 9 order by t, req_id) as i from a join s using (req_id, attempt)),
r as (select distinct address, cast(0 as bigint) as i, cast(null as bigint) as req_id, false as allowed, false as ok, cast(0 as bigint) as tries, cast(null as varchar) as error, 'closed' as state, 0 as failures, 0 as successes, 0 as probes, cast(null as bigint) as last from o
union all select address, i, req_id, allowed, allowed and ok, case when allowed then tries else 0 end, case when allowed then error else 'circuit_open' end,
case when allowed and ok and st = 'half_open' and su >= 1 then 'closed' when allowed and not ok and (st = 'half_open' or failures >= 4) then 'open' else st end,
case when allowed and ok and (st = 'closed' or su >= 1) then 0 when allowed and not ok and st = 'closed' then failures + 1 else failures end,
case when not allowed then su when ok and st = 'half_open' then (su + 1) % 2 when not ok and (st = 'half_open' or failures >= 4) then 0 else su end,
case when not allowed then pr when ok and st = 'half_open' and su >= 1 then 0 when not ok and (st = 'half_open' or failures >= 4) then 0 else pr end, case when allowed and not ok then ts_ns else last end
from (select o.address, o.i, o.req_id, o.ok, o.tries, o.error, o.ts_ns, r.last, r.failures, r.state = 'closed' or r.state = 'open' and o.ts_ns - r.last >= 30000000000 or r.state = 'half_open' and r.probes < 3 as allowed,
case when r.state = 'open' and o.ts_ns - r.last >= 30000000000 then 'half_open' else r.state end as st, case when r.state = 'open' and o.ts_ns - r.last >= 30000000000 then 0 else r.successes end as su,
case when r.state = 'open' and o.ts_ns - r.last >= 30000000000 then 1 when r.state = 'half_open' and r.probes < 3 then r.probes + 1 else r.probes end as pr from r join o on o.address = r.address and o.i = r.i + 1))
select req_id, address, allowed, ok, cast(tries as int) as tries, error, state from r where i > 0""")
def retry_through_breaker(spark, d):
    e = fx.table(spark, d, "events")
    code = F.when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "click", "unreachable").when(F.col("event_type") == "signup", "circuit_open").when(F.col("event_type") == "error", "server_error")
    req = F.expr("event_id div 5")
    rows = e.select(req.alias("req_id"), F.concat(F.lit("10.0.1."), (req % 9).cast("string")).alias("address"), (fx.micros(F.col("ts")) * 1000).alias("ts_ns"), (F.col("event_id") % 5).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), code.alias("error"))
    return resilience.through_breaker(rows.where("attempt <= 3"))


def _breaker_events(spark, d):
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("error", "view"), "failure").when(F.col("event_type") == "purchase", "success").otherwise("allow")
    return e.select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 25).cast("string")).alias("address"), (fx.micros(F.col("ts")) * 1000).alias("ts_ns"), F.col("event_id").alias("seq"), kind.alias("event"))


BREAKER = """with recursive ev as (select concat('10.0.0.', user_id % 25) as address, epoch_us(ts) * 1000 as ts_ns, event_id as seq, case when event_type in ('error', 'view') then 'failure' when event_type = 'purchase' then 'success' else 'allow' end as event,
row_number() over (partition by user_id % 25 order by ts, event_id) as i from events),
r as (select distinct address, cast(0 as bigint) as i, cast(null as bigint) as seq, cast(null as varchar) as event, cast(null as boolean) as allowed, 'closed' as state, 0 as failures, 0 as successes, 0 as probes, cast(null as bigint) as last from ev
union all select e.address, e.i, e.seq, e.event, case when e.event != 'allow' then null when r.state = 'open' then r.last is null or e.ts_ns - r.last >= 3600000000000 when r.state = 'half_open' then r.probes < 3 else true end,
case when e.event = 'allow' and r.state = 'open' and (r.last is null or e.ts_ns - r.last >= 3600000000000) then 'half_open' when e.event = 'success' and r.state = 'half_open' and r.successes >= 1 then 'closed'
when e.event = 'failure' and (r.state = 'half_open' or r.state = 'closed' and r.failures >= 2) then 'open' else r.state end,
case when e.event = 'success' and (r.state = 'closed' or r.state = 'half_open' and r.successes >= 1) then 0 when e.event = 'failure' and r.state = 'closed' then r.failures + 1 else r.failures end,
case when e.event = 'allow' and r.state = 'open' and (r.last is null or e.ts_ns - r.last >= 3600000000000) then 0 when e.event = 'success' and r.state = 'half_open' then (r.successes + 1) % 2 when e.event = 'failure' and (r.state = 'half_open' or r.state = 'closed' and r.failures >= 2) then 0 else r.successes end,
case when e.event = 'allow' and r.state = 'open' and (r.last is null or e.ts_ns - r.last >= 3600000000000) then 1 when e.event = 'allow' and r.state = 'half_open' and r.probes < 3 then r.probes + 1
when e.event = 'success' and r.state = 'half_open' and r.successes >= 1 or e.event = 'failure' and (r.state = 'half_open' or r.state = 'closed' and r.failures >= 2) then 0 else r.probes end,
case when e.event = 'failure' then e.ts_ns else r.last end from r join ev e on e.address = r.address and e.i = r.i + 1),
st as (select address, seq, event, allowed, state, cast(failures as int) as failures from r where i > 0)"""


@query(BREAKER + " select * from st")
def breaker_states(spark, d):
    return resilience.breaker_states(_breaker_events(spark, d), resilience.BreakerConfig(failures_to_open=3, reset_ns=3_600_000_000_000))


@query(BREAKER + " select address, arg_max(state, seq) as state, arg_max(failures, seq) as failures, count(*) filter (where not allowed) as rejected from st group by address")
def breaker_stats(spark, d):
    return resilience.breaker_stats(breaker_states(spark, d))


@query(BREAKER + " select address, 'closed' as state, cast(0 as int) as failures, count(*) filter (where not allowed) as rejected from st group by address")
def breaker_reset_all(spark, d):
    """The breakers of all addresses after all of them are reset at the end."""
    events = _breaker_events(spark, d)
    resets = resilience.resets(events, F.lit(1 << 62), F.lit(1 << 62))
    return resilience.breaker_stats(resilience.breaker_states(events.unionByName(resets), resilience.BreakerConfig(failures_to_open=3, reset_ns=3_600_000_000_000)))


# Streams and files: both go through tables in the shared folder


@query(SURV + " select key, seq, clock, is_tombstone from surv")
def stream_reconcile(spark, d):
    from causalframe.plans.streams import run_reconcile

    return run_reconcile(fx.kv(spark, d)).select("key", "seq", "clock", "is_tombstone")


@query(KV + " select key, data, clock, is_tombstone, epoch_us(ts) * 1000 as ts_ns from kv")
def segment_roundtrip(spark, d):
    return _roundtrip(fx.kv(spark, d))


def _roundtrip(versions: DataFrame) -> DataFrame:
    from causalframe.plans.streams import through_segments

    rows = versions.select("key", "data", "versions", (fx.micros(F.col("ts")) * 1000).alias("ts_ns"), "is_tombstone")
    back = through_segments(rows)
    return back.select("key", F.col("data").cast("string").alias("data"), clock.render(F.col("versions")).alias("clock"), "is_tombstone", "ts_ns")


def _segments(spark, d) -> str:
    """A folder with the log of all versions, one writer's after another's, in segments of 16 KB."""
    from causalframe.sources.segments import write_segments

    path, rows = shared_path(spark, "log"), fx.kv(spark, d).select("key", "seq", "data", "versions", (fx.micros(F.col("ts")) * 1000).alias("ts_ns"), "is_tombstone", "node_id")
    rows, first = saved(rows, "rows"), 1  # clocks are counted once, not by each writer's one task
    for n in range(fx.REPLICAS):
        first = write_segments(rows.where(F.col("node_id") == f"node{n}").coalesce(1).sortWithinPartitions("seq"), path, 16 << 10, first)
    return path


@query(KV + " select key, count(*) as pointers, max(cast(epoch_us(ts) as bigint)) as last_us from kv group by key")
def log_recover(spark, d):
    """The index of a folder of segments, of which one more is corrupt."""
    from causalframe.sources.segments import recover, segment_name
    from causalframe.sources.shared import filesystem

    path = _segments(spark, d)
    store, folder = filesystem(path)
    with store.open_output_stream(f"{folder}/{segment_name(1 << 40)}") as out:
        out.write(b"no segment of this kind, but long enough to have a header")
    found = recover(spark, path)
    assert found.next_id == (1 << 40) + 1 and [r["segment_id"] for r in found.corrupt.collect()] == [1 << 40]
    return found.index.groupBy("key").agg(F.count("*").alias("pointers"), F.max(F.unix_micros("ts")).alias("last_us"))


@query(KV.replace("with e as", "with recursive e as") + """, r as (select node_id, seq, 25 + strlen(key) + strlen(data) + 15 * ((n0 > 0)::int + (n1 > 0)::int + (n2 > 0)::int) as length, row_number() over (partition by node_id order by seq) as i from kv),
f as (select node_id, i, 0 as segment_no, 32 + length as size from r where i = 1
union all select r.node_id, r.i, f.segment_no + (f.size + r.length > 16384)::int, case when f.size + r.length > 16384 then 32 else f.size end + r.length from f join r on r.node_id = f.node_id and r.i = f.i + 1)
select cast(row_number() over (order by node_id, segment_no) as bigint) as segment_id, count(*) as entries, false as corrupt from f group by node_id, segment_no""")
def log_validate(spark, d):
    """The segments of three writers, by number: how many entries each has, and whether all can be read."""
    from causalframe.sources.segments import validate

    return validate(spark, _segments(spark, d))


@query(KV + " select seq, key, data, clock, is_tombstone from kv")
def log_read_at(spark, d):
    """Every entry by a ranged read at its pointer. A key's n-th version of a time is told by its clock."""
    from causalframe.sources.segments import read_at, recover

    path = _segments(spark, d)
    back = read_at(path, recover(spark, path).index)
    shown = fx.kv(spark, d).select("seq", F.col("key").alias("k"), clock.render(F.col("versions")).alias("c"), (fx.micros(F.col("ts")) * 1000).alias("t"), F.col("data").alias("x"))
    rows = back.where("not corrupt").select("key", F.col("data").cast("string").alias("data"), clock.render(F.col("versions")).alias("clock"), "is_tombstone", "ts_ns")
    return rows.join(shown, (F.col("k") == F.col("key")) & (F.col("c") == F.col("clock")) & (F.col("t") == F.col("ts_ns")) & (F.col("x") == F.col("data"))).select("seq", "key", "data", "clock", "is_tombstone")


@query(KV + f""", k as (select *, max(ts) over (partition by key) as newest from kv)
select key, count(distinct case when ts = newest and not (is_tombstone and ts < {NOW} - interval 7 day) then (ts, data) end) > 0 as kept from k group by key""")
def log_compact_files(spark, d):
    """Segments are merged, oldest first, until fewer than three of the first are left: of each key what is newest stays."""
    from causalframe.sources.segments import compact_files, read_segments, segment_files

    path = _segments(spark, d)
    count = segment_files(spark, path).count()
    compact_files(spark, path, F.expr(NOW), 7 * DAY_US, k=count, segment_bytes=1 << 20)
    left = read_segments(spark, path).select("key").distinct().withColumn("kept", F.lit(True))
    return _keys(spark, d).join(left, "key", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
