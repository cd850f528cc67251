"""SimHash fingerprints of whole texts, and the groups that links of few differing bits make.

Links are found by pigeonhole blocks: 64 bits are cut into max_bits + r blocks, so two fingerprints that differ
in at most max_bits bits agree on some r whole blocks. Each fingerprint is posted once for each choice of r blocks,
rows that share a posting are compared by Hamming distance, and nothing else is compared. Any r is exact; r grows
with the number of distinct fingerprints so that a posting holds few unrelated ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.components import connected_components
from causalframe.llm.scratch import fresh, table, written
from causalframe.llm.scratch import small as broadcast_if_small

BITS = 64
SEED = 42
STEP = 1 << 16


def simhash(text: bytes | None, width: int = 4, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Shingles of width words keep their repeats;
    fewer words make one shingle; no words give zero. A bit is set if it is set in over half the shingle hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    count = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, STEP):
        block = b"".join([digest(line[s : e - 1], seed) for s, e in zip(starts[at : at + STEP], last[at : at + STEP])])
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) for each row of docs; fp is the SimHash as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([simhash(t.as_py(), width, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    chosen = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, fp long")


def blocks_for(count: int, max_bits: int = 4, crowd: int = 16) -> int:
    """The number r of blocks that must agree: the least for which chance puts at most crowd fingerprints in a posting."""
    r = 1
    while r < 8 and count >> (BITS * r // (max_bits + r)) > crowd:
        r += 1
    return r


def postings(fps: DataFrame, r: int, max_bits: int = 4, fp: str = "fp") -> DataFrame:
    """(key, fp): one row for each choice of r of the max_bits + r blocks, with the bits of those blocks as the key."""
    parts = max_bits + r
    cuts = [BITS * i // parts for i in range(parts + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(parts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [sum(masks[i] for i in c) for c in combinations(range(parts), r)]
    assert len(chosen) == comb(parts, r)
    keys = F.array(*[F.xxhash64(F.lit(n), F.col(fp).bitwiseAND(F.lit(signed(m)))) for n, m in enumerate(chosen)])
    return fps.select(F.explode(keys).alias("key"), F.col(fp).alias("fp"))


def _tree(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that spans the links among fps, by breadth-first search over one row of distances at a time."""
    left, a, b = np.ones(len(fps), bool), [], []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits]
            left[near] = False
            queue.extend(near.tolist())
            a.append(np.full(len(near), fps[at]))
            b.append(fps[near])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: all of them in runs of at most small rows, a spanning forest in longer ones."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for run in np.flatnonzero(size > small):
        x, y = _tree(fps[edge[run] : edge[run + 1]], max_bits)
        a.append(x)
        b.append(y)
    keep = np.repeat((size <= small) & (size > 1), size)
    keys, fps = keys[keep], fps[keep]
    for shift in range(1, min(small, len(keys))):
        near = (keys[shift:] == keys[:-shift]) & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= max_bits)
        a.append(fps[:-shift][near])
        b.append(fps[shift:][near])
    return np.concatenate(a), np.concatenate(b)


def whole_runs(batches: Iterator[pa.RecordBatch], find: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """find(columns) over rows sorted by the first column, of which equal values are never dealt to two calls."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        last = held[-1][0][-1]
        if held[0][0][0] == last:  # one run so far, and it may go on
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        end = int(np.searchsorted(columns[0], last, "left"))
        yield find(*[c[:end] for c in columns])
        held = [[c[end:] for c in columns]]
    if held:
        yield find(*[np.concatenate(c) for c in zip(*held)])


def close_pairs(units: DataFrame, max_bits: int = 4, small: int = 24) -> DataFrame:
    """(a, b) links that connect whatever the rows (key, fp) of one key connect. Rows of one key meet in one task."""

    def find(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _links(keys, fps.view(np.uint64), max_bits, small)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = units.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: whole_runs(batches, find), "a long, b long")


def parted(rows: DataFrame, weights: DataFrame, key: str, item: str, weight: str, limit: int) -> DataFrame:
    """rows with key, named key, replaced so that no value has items of more than about limit together.

    weights: key and weight, of every value over limit at least. Such a value's items are cut into chunks of half the
    limit by their hash, and each pair of chunks is a value of its own, so that every two items still share one.
    """
    hot = weights.where(F.col(weight) > limit).select(F.col(key).alias("of"), F.ceil(F.col(weight) * 2 / F.lit(limit)).cast("long").alias("parts"))
    hot = written(hot.repartition(8), "crowded")  # a row for over limit items
    rows = rows.withColumnRenamed(key, "key")
    if hot.isEmpty():
        return rows
    hot = broadcast_if_small(hot)
    cold = rows.join(hot, rows["key"] == hot["of"], "left_anti")
    units = rows.join(hot, rows["key"] == hot["of"]).withColumn("c", F.pmod(F.xxhash64(item), F.col("parts")))
    units = units.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return cold.unionByName(units.withColumn("key", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))).select(*rows.columns))


def near_links(fps: DataFrame, max_bits: int = 4, crowded: int = 8192, blocks: int | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs of fps at most max_bits apart. fps: distinct longs in fp.

    A posting of over crowded rows is cut into pairs of chunks, so no task holds more than about crowded rows of it.
    """
    r = blocks or blocks_for(fps.count(), max_bits)
    keys = postings(fps, r, max_bits)
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    return close_pairs(parted(keys, counts, "key", "fp", "n", crowded), max_bits).distinct()


def near_groups(docs: DataFrame, max_bits: int = 4, width: int = 4, seed: int = SEED, crowded: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the least doc_id that links reach, the row's own included. Rows of equal fingerprints, those of
    empty or null texts too, are linked; they are one node of the graph, however many they are. Repeated rows stay. A
    null doc_id is never the least; a group of only such rows has a null component_id. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, width, seed), "fps")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    labels = connected_components(near_links(firsts.select("fp"), max_bits, crowded)).withColumnRenamed("node", "fp")
    group = labels.join(firsts, "fp").groupBy("label").agg(F.min("first").alias("least"))
    named = firsts.join(labels.join(group, "label").select("fp", "label", "least"), "fp", "left")
    named = named.select("fp", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """The rows of docs that firsts() chooses of the groups of near_groups; the columns of docs."""
    rows, name = hashed(docs)
    fps = written(fingerprints(rows, key=name), "fps")
    labels = connected_components(near_links(fps.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    marks = fps.join(labels, "fp", "left").select(F.col(f"`{name}`").alias("row"), F.coalesce("label", "fp").alias("label"))
    ids = rows.select(F.col(f"`{name}`").alias("row"), "doc_id").distinct()
    return firsts(rows, name, marks.join(ids, "row"))


def hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of all columns, and that column's name."""
    name = fresh(docs, "row")
    return docs.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), name


def firsts(rows: DataFrame, name: str, marks: DataFrame) -> DataFrame:
    """One row of rows for each label of marks (row, doc_id, label; row is the hash that rows has as name), without name.

    It is the row of the least doc_id, nulls last, and of several with it the one of the least hash of its columns; of
    rows that are equal in all columns one stays. Rows that share a doc_id, or have none, are told apart by the hash.
    """
    marks = written(marks.select("row", "doc_id", "label"), "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = marks.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    judged = marks.join(first.where("n > 1"), "label").select("row", (F.col("row") == F.col("first.row")).alias("stays"))
    judged = written(judged.groupBy("row").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")), "judged")
    mark = F.col("row").alias(name)
    kept = rows.join(broadcast_if_small(judged.where("not stays").select(mark)), name, "left_anti")
    repeated = judged.where("stays and n > 1").select(mark)
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        kept = kept.join(repeated, name, "left_anti").unionByName(kept.join(repeated, name, "left_semi").dropDuplicates([name]))
    return kept.drop(name)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, links of at most 4 differing bits."""
    return near_groups(table(spark, sf_dir, "documents"))
