"""SimHash near-duplicates at a similarity: fingerprint blocks propose pairs, Hamming distance and then the exact Jaccard similarity of shingle sets decide.

Two sets at Jaccard similarity s have a cosine of 2s / (1 + s) or a little more, so their SimHash bits agree with
probability 1 - acos(cosine) / pi: 0.85 at 0.8. 64 bits do not tell that from chance sharply enough, and their pigeonhole blocks at that many
differing bits are four bits wide. So fingerprints are longer here: 128 bits to measure the distance by, and n blocks of b bits to meet in.
Fingerprints that differ in fewer than n bits of the blocks share a block for certain; those at similarity s miss each
other with chance (1 - 0.85 ** b) ** n, for which n is set: 0.001 at 0.8, and less above. b grows with the logarithm of
the number of documents, so that a posting holds few unrelated ones.

Rows that share a block are compared by Hamming distance. What is within the radius, three standard deviations beyond
the wanted similarity, makes loose groups, and only inside these are shingle sets compared, exactly. A node is one set
of shingles, so equal sets are one node however many documents have them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.components import connected_components
from causalframe.llm.scratch import small, tidy, written
from causalframe.llm.simhash import firsts, hashed, parted, whole_runs

SCREEN = 128
SEED = 42
MISS = 0.001
STEP = 1 << 14
_WORD = re.compile(r"[^\W_]+")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles, ascending. Words are runs of letters and digits, lower-cased.

    Fewer words than width make one shingle; no words make none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter((digest(w.encode("utf-8", "replace"), SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    whole = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + each[i : len(each) - width + 1 + i]
    return np.unique(whole * np.uint64(0x9FB21C651E98DF25))


def layout(count: int, least: float = 0.8, miss: float = MISS, crowd_bits: int = 6) -> tuple[int, int, int]:
    """(bits of a block, number of blocks, Hamming radius of SCREEN bits) for count documents and the similarity least."""
    agree = 1 - math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    bits = max(8, count.bit_length() - crowd_bits)
    blocks = math.ceil(math.log(miss) / math.log1p(-(agree**bits))) if agree < 1 else 1
    return bits, blocks, math.ceil(SCREEN * (1 - agree) + 3 * math.sqrt(SCREEN * agree * (1 - agree)))


def _salts(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    pairs = rng.integers(0, 1 << 63, (n_words, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return pairs[:, 0], pairs[:, 1]


def signature(own: np.ndarray, salts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The SimHash of a set of hashes, as many 64-bit words as salts has. A bit is set if it is set in over half of them."""
    by, off = salts
    ones = np.zeros(64 * len(by), np.int64)
    for at in range(0, len(own), STEP):
        x = own[at : at + STEP, None] * by + off
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        for row in range(0, len(bits), 255):
            ones += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own)).view(np.uint64)


def _marked(docs: DataFrame, row: str, width: int, n_words: int) -> DataFrame:
    """row, doc_id, node (a hash of the set), n (its size) and fp (its signature) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(n_words)
        for batch in batches:
            nodes, sizes, fps = [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(signature(own, salts))
            flat = np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * n_words), pa.array(flat))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "n", "fp"])

    chosen = docs.select(F.col(f"`{row}`").alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), f"row long, doc_id {kind}, node long, n long, fp array<long>")


def postings(nodes: DataFrame, bits: int, blocks: int) -> DataFrame:
    """(key, node, s0, s1): for each block of each row of nodes (node, fp) its number and bits, and the bits to measure by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        name = np.arange(blocks, dtype=np.uint64) << np.uint64(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cut = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)[:, SCREEN : SCREEN + bits * blocks]
                keys = (cut.reshape(part.num_rows, blocks, bits) * value).sum(axis=2, dtype=np.uint64) + name
                node = part.column(0).to_numpy(zero_copy_only=False)
                columns = [keys.ravel().view(np.int64), *[np.repeat(c, blocks) for c in (node, fps[:, 0], fps[:, 1])]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "s0", "s1"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, s0 long, s1 long")


def _stars(pairs: np.ndarray, count: int) -> list[tuple[int, int]]:
    """(least, member) of the components that pairs make of the numbers below count."""
    up = list(range(count))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [(root, i) for i in np.unique(pairs).tolist() if (root := find(i)) != i]


def _forest(s0: np.ndarray, s1: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(least, member) of the components of links of at most radius bits, by breadth-first search, one row of distances at a time."""
    left, edges = np.ones(len(s0), bool), []
    for root in range(len(s0)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            far = np.bitwise_count(s0[rest] ^ s0[at]).astype(np.int32) + np.bitwise_count(s1[rest] ^ s1[at])
            near = rest[far <= radius]
            left[near] = False
            queue.extend(near.tolist())
            edges.extend((root, i) for i in near.tolist())
    return edges


def loose_links(posts: DataFrame, radius: int, small_run: int = 512) -> DataFrame:
    """(a, b): the least node of each component that links of at most radius bits make among the rows of one key, and a member.

    Rows of one key meet in one task. Components of many keys mostly have the same least nodes, so that a large group
    gives a few links a node, whatever the number of keys.
    """

    def find(keys: np.ndarray, node: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> pa.RecordBatch:
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            x, y = s0[lo:hi], s1[lo:hi]
            if hi - lo <= small_run:
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
                i, j = i[i < j], j[i < j]
                near = np.bitwise_count(x[i] ^ x[j]).astype(np.int32) + np.bitwise_count(y[i] ^ y[j]) <= radius
                links = _stars(np.stack([i[near], j[near]], axis=1), hi - lo) if near.any() else []
            else:
                links = _forest(x, y, radius)
            if links:
                out.append(node[lo:hi][np.array(links)])
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return posts.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda batches: whole_runs(batches, find), "a long, b long").distinct()


def similar(own: list[np.ndarray], least: float, names: list[int | None] | None = None) -> list[tuple[int, int]]:
    """(first, member) of the components that pairs of sets of similarity least or more make. Sets: of different hashes, none empty.

    With names, only sets without a name are compared with all: links of two named ones are known or found elsewhere. Sets of
    one name are one component already, so a link to the first of them stands for links to the others.
    """
    sizes = np.array([len(o) for o in own])
    values, codes = np.unique(np.concatenate(own), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    codes = codes.astype(np.int32)
    have, left, edges = np.zeros(len(values), np.uint8), np.ones(len(own), bool), []
    named = np.array([n is not None for n in names or [None] * len(own)])
    index = np.arange(len(own))  # of the sets that codes, starts and sizes still hold
    for root in np.flatnonzero(~named).tolist():
        queue, met = [root] if left[root] else [], set()
        left[root] = False
        while queue:
            at = queue.pop()
            live = left[index]
            if not live.any():
                break
            if 2 * live.sum() < len(index):
                index, kept = index[live], np.repeat(live, sizes)
                codes, sizes = codes[kept], sizes[live]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            mine = np.searchsorted(values, own[at])
            have[mine] = 1
            common = np.add.reduceat(have[codes], starts, dtype=np.int64)
            have[mine] = 0
            near = index[(common >= least * (sizes + len(mine) - common) - 1e-9) & left[index]]
            free = near[~named[near]].tolist()
            left[free] = False
            queue.extend(free)
            edges.extend((root, i) for i in free)
            for i in near[named[near]].tolist():
                if names[i] not in met:
                    met.add(names[i])
                    edges.append((root, i))
    return edges


def _linked(units: DataFrame, least: float) -> DataFrame:
    """(a, b) of similar() for the rows (key, node, name, own) of each key; a node that a key has with and without a name has none."""

    def links(nodes: list[int], names: list[int | None], own: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(nodes[i], nodes[j]) for i, j in similar(own, least, names)] if len(nodes) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, names, own, found = None, [], [], [], []
        for batch in batches:
            ends = np.asarray(batch.column(3).offsets)
            flat = batch.column(3).values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (key, node, name) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)])):
                if key != unit:
                    found += links(nodes, names, own)
                    unit, nodes, names, own = key, [], [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    names.append(name)
                    own.append(flat[ends[i] : ends[i + 1]].copy())
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found + links(nodes, names, own))

    rows = units.select("key", "node", "name", "own").repartition("key").sortWithinPartitions("key", "node", F.col("name").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def exact_links(sets: DataFrame, least: float, limit: int = 1 << 18) -> DataFrame:
    """(a, b): links of similarity least or more that connect what the sets of one label connect. sets: label, node, own.

    A label of over limit hashes is cut into chunks, so that no task holds more than about limit hashes and two sets at
    once. Chunks are linked by themselves first, which gives components their names. The largest of a label is its core, of which nothing
    is compared with itself again; only what is not in it is compared with every chunk, and gives one link to each component.
    So a group that is mostly one component is linear work, and no pair is left out.
    """
    root = F.lit(None).cast("long").alias("name")
    parts = lambda w: F.ceil(w * 2 / F.lit(limit)).cast("long")
    chunk = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    whole = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    weights = sets.groupBy("label").agg(F.sum(F.size("own")).alias("w")).where(F.col("w") > limit)
    weights = written(weights.select(F.col("label").alias("of"), parts(F.col("w")).alias("parts")).repartition(8), "crowded")
    if weights.isEmpty():
        return _linked(sets.select(F.col("label").alias("key"), "node", root, "own"), least)
    hot = small(weights)
    cold = sets.join(hot, F.col("label") == F.col("of"), "left_anti").select(F.col("label").alias("key"), "node", root, "own")
    big = sets.join(hot, F.col("label") == F.col("of")).select("label", "node", "own", "parts", chunk(F.col("parts"), 0).alias("chunk"))
    within = written(_linked(cold.unionByName(big.select(F.xxhash64("label", "chunk").alias("key"), "node", root, "own")), least), "within")

    names = connected_components(within).select(F.col("node").alias("one"), F.col("label").alias("name"))
    named = big.join(names, F.col("node") == F.col("one"), "left").withColumn("name", F.coalesce("name", "node")).drop("one")
    named = written(named, "named")
    counts = named.groupBy("label", "name").agg(F.count("*").alias("n"), F.sum(F.size("own")).alias("w"))
    core = counts.groupBy("label").agg(F.max_by("name", F.struct("n", "name")).alias("core"), F.sum("w").alias("all"), F.max_by("w", F.struct("n", "name")).alias("held"))
    core = written(core.select(F.col("label").alias("of"), "core", parts(F.col("all") - F.col("held")).alias("rests")).repartition(8), "core")
    named = named.join(small(core), F.col("label") == F.col("of"))
    rest = named.where("name != core").withColumn("l", chunk(F.col("rests"), 1)).withColumn("c", F.explode(whole(F.col("parts"))))
    others = named.where("rests > 0").withColumn("l", F.explode(whole(F.col("rests")))).withColumn("c", F.col("chunk"))
    key = F.xxhash64("label", "l", "c").alias("key")
    across = _linked(rest.select(key, "node", root, "own").unionByName(others.select(key, "node", "name", "own")), least)
    return within.unionByName(across).distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def grouped(docs: DataFrame, row: str, least: float = 0.8, width: int = 5, crowded: int = 8192, limit: int = 1 << 18) -> DataFrame:
    """row, doc_id, node and label for each row of docs: rows of one label are one group. row: a column, a hash of the row."""
    bits, blocks, radius = layout(docs.count(), least)
    marks = written(_marked(docs, row, width, -(-(SCREEN + bits * blocks) // 64)), "marks")
    nodes = marks.where("n > 0").groupBy("node").agg(F.first("fp").alias("fp"))
    posts = written(postings(nodes, bits, blocks), "posts")
    counts = posts.groupBy("key").agg(F.count("*").alias("n"))
    loose = loose_links(parted(posts, counts, "key", "node", "n", crowded), radius)
    loose = written(connected_components(written(loose, "loose")), "loose")

    chosen = marks.join(loose, "node").groupBy("node", "label").agg(F.min("row").alias("row"))
    chosen = written(chosen.select("label", "node", F.col("row").alias("of_row")), "chosen")
    texts = docs.select(F.col(f"`{row}`").alias("row"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(chosen), F.col("row") == F.col("of_row")).select("label", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                own = pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in part.column(2)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own], ["label", "node", "own"])

    own = written(texts.mapInArrow(tidy(sets), "label long, node long, own array<long>"), "sets")
    labels = connected_components(written(exact_links(own, least, limit), "links"))
    return marks.select("row", "doc_id", "node").join(labels, "node", "left").select("row", "doc_id", "node", F.coalesce("label", "node").alias("label"))


def near_groups(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id and component_id for each row of docs: the least doc_id that links of similarity least or more reach.

    Texts without words, null and empty ones too, are one group. Repeated rows stay. A null doc_id is never the least;
    a group of only such rows has a null component_id. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    marks = written(grouped(rows, "row", least, width), "grouped")
    return marks.join(marks.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """One row of docs for each group of near_groups, chosen as simhash.firsts() says; the columns of docs."""
    rows, name = hashed(docs)
    return firsts(rows, name, grouped(rows, name, least, width))
