"""The order-dependent operators on streams, with state by key, and what the batch operators share with streams as they are."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causalframe.operators.resilience import OUTPUT, Breaker, BreakerConfig
from causalframe.schema import ALIVE, DEAD, SUSPECTED

SURVIVORS = "key string, seq long, data string, clock string, is_tombstone boolean, siblings int"


def _beaten(a: dict, b: dict) -> bool:
    """Whether clock a is strictly before b."""
    return all(b.get(k, 0) >= v for k, v in a.items()) and any(v > a.get(k, 0) for k, v in b.items())


def maximal(rows: list[tuple]) -> list[tuple]:
    """Rows whose clock, the third field, no other one's is strictly after."""
    return [r for r in rows if not any(_beaten(r[2], o[2]) for o in rows)]


def reconcile_stream(versions: DataFrame) -> DataFrame:
    """The surviving versions of each key that a batch touches; a key's state is its siblings alone. Output mode: update."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [(s, d, dict(c), t) for s, d, c, t in json.loads(state.get[0])] if state.exists else []
        for part in parts:
            rows = maximal(rows + [(int(r.seq), r.data, json.loads(r.clock), bool(r.is_tombstone)) for r in part.itertuples()])
        state.update((json.dumps(rows),))
        yield pd.DataFrame([(key[0], s, d, ",".join(f"{k}={v}" for k, v in sorted(c.items())), t, len(rows)) for s, d, c, t in rows], columns=["key", "seq", "data", "clock", "is_tombstone", "siblings"])

    rows = versions.select("key", "seq", "data", F.to_json("versions").alias("clock"), "is_tombstone")
    return rows.groupBy("key").applyInPandasWithState(step, SURVIVORS, "rows string", "update", GroupStateTimeout.NoTimeout)


def breaker_stream(events: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """breaker_states() on a stream; the state is the machine's five numbers. Output mode: append."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Breaker(config, state.get) if state.exists else Breaker(config)
        batch = pd.concat(list(parts)).sort_values(["ts_ns", "seq"])
        out = [(r.address, r.seq, r.event, machine.feed(r.event, r.ts_ns), machine.state, machine.failures) for r in batch.itertuples()]
        state.update(machine.saved())
        yield pd.DataFrame(out, columns=["address", "seq", "event", "allowed", "state", "failures"])

    saved = "state string, failures int, successes int, probes int, last_failure long"
    return events.groupBy("address").applyInPandasWithState(step, OUTPUT, saved, "append", GroupStateTimeout.NoTimeout)


def detector_stream(heartbeats: DataFrame, timeout_ms: int, suspect: float = 8.0, dead: float = 16.0) -> DataFrame:
    """node_id and status changes by silence: suspected at 1.5 timeouts and dead at 2.5, alive at a heartbeat. Output mode: update."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        if state.hasTimedOut:
            new = SUSPECTED if old == ALIVE else DEAD
        else:
            for _ in parts:
                pass
            new = ALIVE
        state.update((new,))
        if new != DEAD:
            wait = (dead if new == SUSPECTED else suspect) / suspect
            state.setTimeoutDuration(max(1, int(timeout_ms * (1.5 if new == ALIVE else wait / 2))))
        if new != old:
            yield pd.DataFrame([(key[0], new)], columns=["node_id", "status"])

    return heartbeats.groupBy("node_id").applyInPandasWithState(step, "node_id string, status int", "status int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def deduplicated(rows: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each key's first row within the watermark, which starts at the epoch: rows at or before that are late, as Spark has it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def request_rates(log: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """op, window and requests in tumbling windows of event time."""
    counts = log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "op").agg(F.count("*").alias("requests"))
    return counts.select("op", F.col("w.start").alias("start"), "requests")


def sessions(rows: DataFrame, time: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end and writes of the sessions of each key."""
    counts = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "key").agg(F.count("*").alias("writes"))
    return counts.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "writes")
