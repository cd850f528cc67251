"""Schemas of the tables that operators read."""

from __future__ import annotations

VERSIONS = "key string, seq long, data string, versions map<string,bigint>, ts timestamp, is_tombstone boolean"
MEMBERS = "node_id string, address string, status int, heartbeat long, tokens array<bigint>, ts timestamp"
HINTS = "holder string, for_node string, key string, data string, versions map<string,bigint>, ts timestamp"
LOG_ENTRIES = "segment_id long, offset long, length long, key string, data binary, versions map<string,bigint>, ts_ns long, is_tombstone boolean, corrupt boolean"
RESPONSES = "req_id long, op string, key string, node_id string, arrival_ns long, ok boolean, n_values int"
BREAKER_EVENTS = "address string, ts_ns long, seq long, event string"

ALIVE, SUSPECTED, DEAD = 0, 1, 2
BEFORE, AFTER, EQUAL, CONCURRENT = "before", "after", "equal", "concurrent"
