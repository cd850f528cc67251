"""Predicates over versions, members and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causalframe.functions import clock
from causalframe.schema import ALIVE, DEAD

RETRYABLE = ("unreachable", "timeout", "circuit_open")


def key_in(key: Column, start: str, end: str) -> Column:
    """Half-open range of keys, by bytes; comparisons with literals reach the scan."""
    return (key >= start) & (key < end)


def live() -> Column:
    return ~F.col("is_tombstone")


def tombstone_expired(now: Column, ttl_us: int, ts: Column | None = None, inclusive: bool = False) -> Column:
    """A tombstone of no clock or one older than ttl; inclusive as the sweep over whole keys has it."""
    ts = F.col("ts") if ts is None else ts
    cutoff = now - F.expr(f"interval {ttl_us} microseconds")
    old = ts <= cutoff if inclusive else ts < cutoff
    return F.col("is_tombstone") & (ts.isNull() | old)


def same_version(a: Column, b: Column) -> Column:
    """Payload, clock and tombstone flag are the same; a and b are structs of data, versions, is_tombstone."""
    return a["data"].eqNullSafe(b["data"]) & clock.equals(a["versions"], b["versions"]) & (a["is_tombstone"] == b["is_tombstone"])


def member_alive() -> Column:
    return F.col("status") == ALIVE


def not_dead(self_id: str | None = None) -> Column:
    """Members that are not dead; the node itself always counts."""
    kept = F.col("status") != DEAD
    return kept | (F.col("node_id") == self_id) if self_id is not None else kept


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def circuit_breaker_error(code: Column) -> Column:
    return F.coalesce(code == "circuit_open", F.lit(False))
