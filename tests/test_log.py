import os

import pytest
from pyspark.sql import functions as F

from causalframe.operators import log as logs
from causalframe.sources import wire
from causalframe.sources.codec import Corrupt, Entry, entries, pack_entry, pack_header, unpack_entry, unpack_header
from causalframe.sources.segments import next_segment_id, read_segments, segment_files, segment_name, validate, versions_of, write_segments


def test_codec():
    e = Entry("kéy", b"\x00data", {"n1": 3, "n2": 2**63}, 1_700_000_000_000_000_001, True)
    raw = pack_entry(e)
    assert unpack_entry(raw) == (e, len(raw)) and unpack_header(pack_header(7, 2)) == (7, 2)
    for i in range(len(raw)):
        with pytest.raises(Corrupt):
            unpack_entry(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :])
    for bad in (b"", pack_header(1, 1)[:-1], b"x" * 32):
        with pytest.raises(Corrupt):
            unpack_header(bad)
    whole = pack_header(1, 2) + raw + raw[:-1]
    got = list(entries(whole))
    assert got[0][:2] == (32, len(raw)) and got[1][2] is None
    with pytest.raises(Corrupt):
        list(entries(whole, strict=True))
    with pytest.raises(ValueError):
        pack_entry(Entry("k" * 70_000))


def test_segments_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("data"), F.map_from_arrays(F.array(F.lit("n")), F.array(F.col("id"))).alias("versions"), (F.col("id") * 1000).alias("ts_ns"), (F.col("id") % 7 == 0).alias("is_tombstone"))
    write_segments(rows.repartition(3), path, segment_bytes=4096)
    back = read_segments(spark, path)
    assert back.count() == 500 and back.where("corrupt").count() == 0
    assert {(r["key"], r["versions"]["n"], r["ts_ns"], r["is_tombstone"]) for r in back.collect()} == {(f"k{i}", i, i * 1000, i % 7 == 0) for i in range(500)}
    files = segment_files(spark, path)
    assert files.count() > 5 and files.agg(F.max("bytes")).first()[0] <= 4096
    assert next_segment_id(spark, path) == files.agg(F.max("segment_id")).first()[0] + 1
    assert versions_of(back).count() == 500
    first = sorted(p for p in os.listdir(tmp_path / "log") if p.endswith(".lss"))[0]
    with open(tmp_path / "log" / first, "r+b") as f:
        f.seek(-1, os.SEEK_END)
        last = f.read(1)
        f.seek(-1, os.SEEK_END)
        f.write(bytes([last[0] ^ 255]))
    assert validate(spark, path).where("corrupt").count() == 1
    assert read_segments(spark, path).where("corrupt").count() == 1
    assert read_segments(spark, path, strict=True).count() < 499
    assert segment_name(255) == "seg-00000000000000ff.lss"


def _log(spark):
    rows = [(1, 32, 50, "k", 1, False), (1, 82, 50, "j", 5, True), (2, 32, 50, "k", 3, False), (3, 32, 50, "k", 3, False)]
    df = spark.createDataFrame(rows, "segment_id long, offset long, length long, key string, t long, is_tombstone boolean")
    return df.withColumn("ts", F.timestamp_seconds("t")).withColumn("versions", F.create_map(F.lit("n"), F.col("t"))).drop("t")


def test_index(spark):
    log = _log(spark)
    p = logs.index(log)
    assert {(r["key"], r["segment_id"]) for r in logs.index_latest(p).collect()} == {("k", 2), ("j", 1)}
    assert logs.remove_segment(p, 1).count() == 2
    assert logs.lookup(p, log).count() == 3
    anew = p.where("key = 'k' and segment_id = 3")
    assert logs.set_pointers(p, anew).count() == 2
    stats = {r["segment_id"]: (r["entries"], r["bytes"]) for r in logs.segment_stats(log).collect()}
    assert stats == {1: (2, 132), 2: (1, 82), 3: (1, 82)}


def test_compaction(spark):
    log, now = _log(spark), F.timestamp_seconds(F.lit(1000))
    assert {(r["key"], r["segment_id"]) for r in logs.compact(log, now, 10**8).collect()} == {("k", 2)}
    assert {(r["key"], r["segment_id"]) for r in logs.compact(log, now, 10**12, "causal").collect()} == {("k", 2), ("k", 3), ("j", 1)}
    assert logs.oldest_segments(log, 3).count() == 3 and logs.oldest_segments(log, 4).count() == 0
    old = logs.oldest_segments(log, 2)
    assert logs.replace_segments(log, log.where("false"), old).count() == 1
    with pytest.raises(ValueError):
        logs.compact(log, now, 1, "newest")


def test_wire(spark):
    rows = spark.createDataFrame([("k", "vé", {"n": 1}, False), ("t", None, {}, True)], "key string, data string, versions map<string,bigint>, is_tombstone boolean").withColumn("ts", F.lit("2024-01-01 00:00:01.5").cast("timestamp"))
    back = {r["key"]: r for r in wire.from_wire(wire.to_wire(rows)).collect()}
    assert back["k"]["data"] == "vé" and back["k"]["versions"] == {"n": 1} and back["t"]["data"] is None and back["t"]["is_tombstone"]
    assert wire.from_wire(spark.createDataFrame([("k", "{")], "key string, value string")).first()["data"] is None
