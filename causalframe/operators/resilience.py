"""Retries and circuit breakers as data."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.functions.predicates import retryable

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass(frozen=True)
class BreakerConfig:
    failures_to_open: int = 5
    successes_to_close: int = 2
    half_open_requests: int = 3
    reset_ns: int = 30_000_000_000


@dataclass(frozen=True)
class RetryConfig:
    retries: int = 3
    initial_ms: float = 100.0
    multiplier: float = 2.0
    max_ms: float = 5_000.0
    jitter: float = 0.2


def jittered(wait_ms: Column, draw: Column, config: RetryConfig = RetryConfig()) -> Column:
    """A wait moved by up to its share config.jitter either way, as draw (0 to 1) says, then cut to be from 0 to config.max_ms."""
    moved = wait_ms + (draw * 2 - 1) * wait_ms * F.lit(config.jitter)
    return F.greatest(F.lit(0.0), F.least(F.lit(config.max_ms), moved))


def waits(attempts: DataFrame, config: RetryConfig = RetryConfig(), seed: int = 0) -> DataFrame:
    """attempts (req_id, attempt from 0) with wait_ms, the jittered wait behind each; chance is a seeded hash of both, so that reruns agree."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "req_id", "attempt")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return attempts.withColumn("wait_ms", jittered(F.lit(config.initial_ms) * F.pow(F.lit(config.multiplier), F.col("attempt")), draw, config))


def backoff(spark: SparkSession, config: RetryConfig = RetryConfig()) -> DataFrame:
    """attempt (from 0), wait_ms, total_ms: the waits between attempts, without jitter."""
    wait = F.least(F.lit(config.max_ms), F.lit(config.initial_ms) * F.pow(F.lit(config.multiplier), F.col("id")))
    rows = spark.range(config.retries).select(F.col("id").alias("attempt"), F.greatest(F.lit(0.0), wait).alias("wait_ms"))
    waits = [max(0.0, min(config.max_ms, config.initial_ms * config.multiplier**i)) for i in range(config.retries)]
    total = F.aggregate(F.slice(F.array(*[F.lit(w) for w in waits] or [F.lit(0.0)]), F.lit(1), F.col("attempt").cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("total_ms", total)


def retry_outcomes(attempts: DataFrame, config: RetryConfig = RetryConfig()) -> DataFrame:
    """req_id, tries, ok, error: what retrying comes to. attempts: req_id, attempt (from 0), ok, error code.

    It stops at the first success, the first error that is not retryable, or after retries + 1 attempts.
    """
    used = attempts.where(F.col("attempt") <= config.retries)
    stops = F.col("ok") | ~retryable(F.col("error"))
    last = used.groupBy("req_id").agg(F.coalesce(F.min(F.when(stops, F.col("attempt"))), F.max("attempt")).alias("attempt"))
    return used.join(last, ["req_id", "attempt"]).select("req_id", (F.col("attempt") + 1).alias("tries"), "ok", F.when(~F.col("ok"), F.col("error")).alias("error"))


class Breaker:
    """The state machine of one address; feed() takes events in order of time."""

    def __init__(self, config: BreakerConfig = BreakerConfig(), state: tuple = (CLOSED, 0, 0, 0, None)):
        self.config = config
        self.state, self.failures, self.successes, self.probes, self.last_failure = state

    def saved(self) -> tuple:
        return self.state, self.failures, self.successes, self.probes, self.last_failure

    def feed(self, event: str, ts_ns: int) -> bool | None:
        """Whether a request may go, for allow; None for the other events."""
        c = self.config
        if event == "allow":
            if self.state == OPEN and (self.last_failure is None or ts_ns - self.last_failure >= c.reset_ns):
                self.state, self.successes, self.probes = HALF_OPEN, 0, 1
                return True
            if self.state == HALF_OPEN and self.probes < c.half_open_requests:
                self.probes += 1
                return True
            return self.state == CLOSED
        if event == "success":
            if self.state == CLOSED:
                self.failures = 0
            elif self.state == HALF_OPEN:
                self.successes += 1
                if self.successes >= c.successes_to_close:
                    self.state, self.failures, self.successes, self.probes = CLOSED, 0, 0, 0
        elif event == "failure":
            self.last_failure = ts_ns
            if self.state == CLOSED:
                self.failures += 1
            if self.state == HALF_OPEN or self.state == CLOSED and self.failures >= c.failures_to_open:
                self.state, self.successes, self.probes = OPEN, 0, 0
        elif event == "reset":
            self.state, self.failures, self.successes, self.probes = CLOSED, 0, 0, 0
        return None


OUTPUT = "address string, seq long, event string, allowed boolean, state string, failures int"


def breaker_states(events: DataFrame, config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """address, seq, event, allowed, state, failures after each event. events: address, ts_ns, seq, event.

    The machine needs an address's events in order; rows of one address stream through one task, sorted by Spark, with
    only the machine's few numbers held.
    """

    def run(parts):
        address, machine = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.address != address:
                    address, machine = row.address, Breaker(config)
                out.append((row.address, row.seq, row.event, machine.feed(row.event, row.ts_ns), machine.state, machine.failures))
            yield pd.DataFrame(out, columns=["address", "seq", "event", "allowed", "state", "failures"])

    rows = events.select("address", "ts_ns", "seq", "event").where("address is not null")
    return rows.repartition("address").sortWithinPartitions("address", "ts_ns", "seq").mapInPandas(run, OUTPUT)


def resets(events: DataFrame, ts_ns: Column, seq: Column) -> DataFrame:
    """An event that resets the breaker of each address of events, at a time and place: what resetting all of them feeds."""
    at = events.select("address").distinct().where("address is not null")
    return at.select("address", ts_ns.cast("long").alias("ts_ns"), seq.cast("long").alias("seq"), F.lit("reset").alias("event"))


def breaker_stats(states: DataFrame) -> DataFrame:
    """address, state and failures now, and requests rejected."""
    last = states.groupBy("address").agg(F.max_by(F.struct("state", "failures"), "seq").alias("last"), F.count_if(~F.coalesce("allowed", F.lit(True))).alias("rejected"))
    return last.select("address", "last.state", "last.failures", "rejected")


EXECUTED = "req_id long, address string, allowed boolean, ok boolean, tries int, error string, state string"


def through_breaker(attempts: DataFrame, retry: RetryConfig = RetryConfig(), config: BreakerConfig = BreakerConfig()) -> DataFrame:
    """req_id, address, allowed, ok, tries, error and state after it of requests that are retried behind their address's breaker.

    attempts: req_id, address, ts_ns (the same for all of a request), attempt, ok, error. The breaker is asked once, before
    the first attempt, and told what retrying came to; a request that it refuses makes no attempt and fails as
    circuit_open. Requests of an address stream through one task in order of time and id.
    """

    def run(parts):
        address, machine = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.address != address:
                    address, machine = row.address, Breaker(config)
                allowed = machine.feed("allow", row.ts_ns)
                if allowed:
                    machine.feed("success" if row.ok else "failure", row.ts_ns)
                out.append((row.req_id, address, allowed, allowed and row.ok, row.tries if allowed else 0, row.error if allowed else "circuit_open", machine.state))
            yield pd.DataFrame(out, columns=["req_id", "address", "allowed", "ok", "tries", "error", "state"])

    asked = attempts.groupBy("req_id").agg(F.min("address").alias("address"), F.min("ts_ns").alias("ts_ns"))
    rows = retry_outcomes(attempts, retry).join(asked, "req_id").where("address is not null")
    rows = rows.select("req_id", "address", "ts_ns", "ok", F.col("tries").cast("int").alias("tries"), "error")
    return rows.repartition("address").sortWithinPartitions("address", "ts_ns", "req_id").mapInPandas(run, EXECUTED)
