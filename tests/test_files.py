"""Log segments as files: what recovery trusts, what is refused, and what compaction leaves."""

import pytest
from pyspark.sql import functions as F

from causalframe.config import DAY_US
from causalframe.sources.codec import HEADER_SIZE
from causalframe.sources.segments import compact_files, next_segment_id, read_at, read_segments, recover, segment_files, segment_name, write_segments

ENTRY = "key string, data string, versions map<string,bigint>, ts_ns long, is_tombstone boolean"
DAY_NS = DAY_US * 1000


def rows(spark, *entries):
    return spark.createDataFrame([(k, d, {"n": n}, t, gone) for n, (k, d, t, gone) in enumerate(entries, 1)], ENTRY).coalesce(1)


def test_recovery_of_a_corrupt_tail(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    write_segments(rows(spark, *[(f"k{i}", "x" * 20, i, False) for i in range(9)]), path, 250)
    ids = sorted(r["segment_id"] for r in segment_files(spark, path).collect())
    assert len(ids) > 2
    torn = tmp_path / "log" / segment_name(ids[-1])
    torn.write_bytes(torn.read_bytes()[:-5])
    (tmp_path / "log" / segment_name(ids[-1] + 7)).write_bytes(b"junk")
    found = recover(spark, path)
    assert {r["segment_id"] for r in found.corrupt.collect()} == {ids[-1], ids[-1] + 7} and found.next_id == ids[-1] + 8
    assert {r["segment_id"] for r in found.index.collect()} == set(ids[:-1])
    assert sum(r["corrupt"] for r in read_segments(spark, path).collect()) == 2
    back = read_at(path, found.index).collect()
    assert {(r["segment_id"], r["offset"], r["key"]) for r in back} == {(r["segment_id"], r["offset"], r["key"]) for r in found.index.collect()} and not any(r["corrupt"] for r in back)
    wrong = read_at(path, spark.createDataFrame([(ids[0], HEADER_SIZE + 3), (ids[0], 10_000), (ids[0], -1)], "segment_id long, offset long")).collect()
    assert [r["corrupt"] for r in wrong] == [True] * 3


def test_known_ids_are_refused_and_null_keys_left_out(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_segments(rows(spark, ("a", "1", 1, False), (None, "2", 2, False), ("b", None, None, None)), path)
    before = {r["path"]: r["bytes"] for r in segment_files(spark, path).collect()}
    assert sorted((r["key"], bytes(r["data"]), r["ts_ns"] > 1, r["is_tombstone"]) for r in read_segments(spark, path).collect()) == [("a", b"1", False, False), ("b", b"", True, False)]
    with pytest.raises(Exception, match="there already"):
        write_segments(rows(spark, ("c", "3", 3, False)), path)
    assert {r["path"]: r["bytes"] for r in segment_files(spark, path).collect()} == before and len(list((tmp_path / "log").iterdir())) == len(before)
    write_segments(rows(spark, ("c", "3", 3, False)), path, first_id=next_segment_id(spark, path))
    assert read_segments(spark, path).count() == 3


def test_compaction_of_the_oldest(spark, tmp_path):
    path, now = f"{tmp_path}/log", F.lit("1970-02-01").cast("timestamp")
    for n, part in enumerate(([("a", "old", 1, False), ("b", "b1", 5, False)], [("a", "new", 9, False), ("gone", None, 2, True)], [("late", None, 30 * DAY_NS, True)], [("a", "last", 20, False)])):
        write_segments(rows(spark, *part), path, first_id=n + 1)
    assert compact_files(spark, path, now, 7 * DAY_US, k=5).count() == 0
    assert sorted(r["segment_id"] for r in compact_files(spark, path, now, 7 * DAY_US).collect()) == [1, 2, 3]
    left = read_segments(spark, path).collect()
    assert sorted((r["key"], bytes(r["data"])) for r in left) == [("a", b"last"), ("a", b"new"), ("b", b"b1"), ("late", b"")]
    assert min(r["segment_id"] for r in left) == 4 and recover(spark, path).corrupt.count() == 0


def test_rotation_starts_anew_at_the_entry_that_does_not_fit(spark):
    from causalframe.operators.log import rotate

    sizes = [600] * 6 + [10, 300, 5000, 20, 948]
    got = rotate(spark.createDataFrame([(i, n, "w") for i, n in enumerate(sizes)], "seq long, length long, writer string"), 1000, stream="writer").orderBy("seq").collect()
    want, segment, size = [], 0, 32
    for n in sizes:
        if size > 32 and size + n > 1000:
            segment, size = segment + 1, 32
        want.append((segment, size))
        size += n
    assert [(r["segment_no"], r["offset"]) for r in got] == want and [w[0] for w in want[:6]] == [0, 1, 2, 3, 4, 5]
    assert rotate(spark.createDataFrame([(1, 5)], "seq long, length long"), 100).first()["offset"] == 32


def test_descent_of_unequal_trees(spark):
    from causalframe.operators.merkle import positional_diff

    side = lambda pairs: spark.createDataFrame([("t", k, v) for k, v in pairs], "tree string, key string, value string")
    four = [(f"k{i}", str(i)) for i in range(4)]
    five = [*four[:3], ("k3", "x"), ("k4", "4")]
    assert [r["key"] for r in positional_diff(side(four), side(five)).collect()] == ["k3"]
    assert positional_diff(side(four), side(four)).count() == 0
    assert positional_diff(side(four), side([]).where("false")).count() == 0
