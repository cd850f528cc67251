"""Queries over whole tables: no row of the source is left out before the operator."""

import pytest
from compare import spark_rows

from causalframe.plans import catalog
from causalframe.plans import fixtures as fx
from conftest import SMALL


def test_every_request_is_read(spark):
    answers = catalog.QUERIES["quorum_get"](spark, SMALL).where("status = 'ok'").select("req_id").collect()
    got = catalog.QUERIES["quorum_get_values"](spark, SMALL).select("req_id").collect()
    assert {r["req_id"] for r in got} == {r["req_id"] for r in answers} and len(got) > 900


def test_every_version_is_swept(spark):
    versions = fx.kv(spark, SMALL).select("key", "is_tombstone", "ts").collect()
    limit = spark.sql(f"select {catalog.NOW} - interval 7 days as t").first()["t"]
    want = {}
    for r in versions:
        want.setdefault(r["key"], []).append(r["is_tombstone"] and r["ts"] <= limit)
    kept = {r["key"]: r["versions"] for r in catalog.QUERIES["tombstone_sweep"](spark, SMALL).collect()}
    assert kept == {k: len(v) for k, v in want.items() if not all(v)}


#: The number of rows that each gives over all of sf0.001: 1,000 events of 15 users by 7 nodes, 100 carts.
ALL = {"segment_roundtrip": 1000, "quorum_delete": 1000, "admission_slots": 1000, "kv_log_delete": 15, "cart_merge": 100, "phi": 7, "failure_status": 7}


@pytest.mark.parametrize("name", sorted(ALL))
def test_every_row_reaches_the_operator(spark, name):
    assert sum(spark_rows(catalog.QUERIES[name + ""](spark, SMALL))[1].values()) == ALL[name]
