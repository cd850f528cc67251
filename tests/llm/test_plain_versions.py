"""Operators against plain versions of what they compute, and cases in which rows or texts were once lost."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from causalframe.llm import queries
from conftest import MID, SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "one", "b"), (5, "one two three four five six", "b"), (5, "one two three four five six", "b"), (None, "no id here at all, none", None), (7, "x " * 30_000, "a"), (8, "ONE two", "b")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_of_a_whole_table(spark):
    table = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_simhash(r["text"]) for r in table}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    linked = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4).tolist() if b > a]
    want = components(ids, linked)
    got = queries.QUERIES["op1_simhash"](spark, MID).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids} and len(got) == len(table)


def plain_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_groups(rows):
    """Least id of each row's group by all pairs that share a shingle. rows: id, text."""
    sets, where = {i: plain_set(t) for i, t in rows}, defaultdict(list)
    for i, own in sets.items():
        for s in own:
            where[s].append(i)
    empty = [i for i, own in sets.items() if not own]
    linked, common = [(empty[0], i) for i in empty[1:]], Counter()
    for holders in where.values():
        common.update((a, b) for k, a in enumerate(holders) for b in holders[k + 1 :])
    linked += [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    return components(sets, linked)


def test_near_groups_of_a_whole_table(spark):
    from causalframe.llm.neardup import near_groups

    table = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    want = plain_groups([(r["doc_id"], r["text"]) for r in table.collect()])
    assert len(set(want.values())) < len(want)
    assert {r["doc_id"]: r["component_id"] for r in near_groups(table).collect()} == want


def test_a_large_group_of_near_copies(spark):
    """Copies edited more and more: chunks of nodes, crowded postings, and groups that chains make."""
    from causalframe.llm.neardup import grouped

    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(16)):
            copy[at] = f"v{rng.randrange(100_000)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10_000)}" for _ in range(100))) for i in range(100)]
    want = plain_groups(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text"))
    for crowded, limit in ((8192, 1 << 18), (16, 2000)):
        got = {r["doc_id"]: r["label"] for r in grouped(table, "row", crowded=crowded, limit=limit).collect()}
        first = {}
        for i in sorted(got):
            first.setdefault(got[i], i)
        assert {i: first[label] for i, label in got.items()} == want


@pytest.mark.parametrize("module", ["simhash", "neardup"])
def test_one_row_of_each_group_stays(spark, module):
    first_of_groups = __import__(f"causalframe.llm.{module}", fromlist=["x"]).first_of_groups
    rng = random.Random(1)
    x, y, z = (" ".join(f"{n}{rng.randrange(500)}" for _ in range(60)) for n in "xyz")
    rows = docs(spark, [(3, x, "s"), (5, x, "s"), (5, y, "s"), (7, y, "s"), (None, z, "s"), (None, z, "s"), (None, x, "s")]).withColumn("row", F.lit("clash")).withColumn("label", F.lit("clash"))
    kept = first_of_groups(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(3, x), (5, y), (0, z)])
    assert first_of_groups(rows.where("false")).count() == 0


def test_words_of_odd_white_space(spark):
    from causalframe.llm.mixing import n_words

    texts = ["word \x85", "a b  ", " ", " a\tb\x0b\x0c\r\nc ", "", " \n", None, "a\xa0b", "\x1c a"]
    plain = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", n_words(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
    n_words_of = lambda t: spark.createDataFrame([(t,)], "t string").select(n_words(F.col("t"))).first()[0]
    n_words_of("warm up")
    start = time.time()
    assert n_words_of("a" + " " * 1_000_000 + "b") == 2 and time.time() - start < 5


def test_lexicon(spark):
    """Log-odds with Dirichlet priors of words and beginnings, counted plainly."""
    from causalframe.llm.toxicity import SCALE, TOP, WORD, lexicon

    rng = random.Random(2)
    bad = [f"foul{i}" for i in range(6)]
    rows = [(" ".join(rng.choices([f"w{j}" for j in range(80)] + (bad if i % 3 == 0 else []), k=60)), int(i % 3 == 0)) for i in range(120)]
    counts, whole = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    for text, mark in rows:
        words = set(WORD.findall(text.lower()))
        counts[mark].update(words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) > n})
        whole[mark] += len(words)
    want = {}
    for unit in counts[1]:
        y, n = counts[1][unit], counts[0][unit]
        a = 0.5 + 1000.0 * (y + n) / (whole[0] + whole[1])
        odds = lambda k, total: math.log((k + a) / (total + 1000.0 - k - a))  # noqa: E731, B023
        delta = odds(y, whole[1]) - odds(n, whole[0])
        if y >= 3 and delta / math.sqrt(1 / (y + a) + 1 / (n + a)) >= 1.0 and delta >= 0.5:
            want[unit] = max(1, min(TOP, round(SCALE * delta)))
    got, rate = lexicon(spark.createDataFrame(rows, "text string, toxic int"), least_z=1.0, least_odds=0.5)
    assert got == want and set(bad) <= set(got) and rate > 0


def test_toxic_scores(spark):
    """Scores of whole texts from segments found by all pairs of positions."""
    from causalframe.llm.toxicity import SCALE, ToxicModel, scores

    model = ToxicModel({"foul": 12, "badw*": 9, "mean": 5}, 0.4, (-4.0, 1.0, 2.0))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["foul", "badword", "mean", "x", "y", "z", "good"], k=rng.randrange(0, 30)))) for i in range(60)]

    def segments(line):
        spans = [(sum(line[a:b]), -(b - a), -a, a, b) for a in range(len(line)) for b in range(a + 1, len(line) + 1)]
        if not spans or max(spans)[0] <= 0:
            return []
        s, _, _, a, b = max(spans)
        return [*segments(line[:a]), s, *segments(line[b:])]

    got = {r["doc_id"]: r for r in scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        words = text.split()
        line = [{"foul": 12, "badword": 9, "mean": 5}.get(w, -3) for w in words]
        found = segments(line)
        assert sorted(p["score"] * SCALE for p in got[i]["passages"]) == sorted(found)
        excess = sorted((0.4 * s - math.log(max(len(words), 1)) for s in found), reverse=True)
        best, total, most = max([0.0, *excess]), 0.0, 0.0
        for r, x in enumerate(excess, 1):
            total += x + math.log(r)
            most = max(most, total)
        z = -4.0 + math.log1p(best) + 2.0 * math.log1p(most)
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_vectors_and_pooling(spark):
    """Neighbour sums, pooled features and the network, one token at a time."""
    from causalframe.llm import quality as q

    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma", "7", "delta!", "x_y"], k=rng.randrange(1, 40))) for _ in range(12)] + ["", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bucket = lambda t: zlib.crc32(t.encode()) % q.BUCKETS
    places, signs = q.index_vectors()
    sums = defaultdict(lambda: np.zeros(q.WIDTH, np.int64))
    for text in texts:
        ids = [bucket(t) for t in q.TOKEN.findall(text or "")]
        for i, b in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for m in range(q.MARKS):
                        sums[b][places[ids[j], m]] += signs[ids[j], m]
    got = {r["bucket"]: [r[f"d{i}"] for i in range(q.WIDTH)] for r in q._neighbours(table).collect()}
    assert got == {b: v.tolist() for b, v in sums.items() if v.any()}
    vectors = q.word_vectors(table)
    rows = np.stack([q.pooled(t, vectors) for t in texts])
    for text, row in zip(texts, rows):
        ids = [bucket(t) for t in q.TOKEN.findall(text or "")]
        if not ids:
            assert not row.any()
            continue
        each = [vectors[i].astype(float) for i in ids]
        mean = sum(each) / len(ids)
        assert np.allclose(row[: q.WIDTH], mean, atol=1e-4)
        assert np.allclose(row[q.WIDTH : 2 * q.WIDTH] ** 2, sum(v * v for v in each) / len(ids) - mean**2, atol=1e-3)
        near = sum(float(a @ b) for a, b in zip(each, each[1:])) / len(ids)
        tail = [near, float(mean @ mean), sum(a == b for a, b in zip(ids, ids[1:])) / len(ids), len(set(ids)) / len(ids), math.log1p(len(ids)), len(text) / len(ids) / 10]
        assert np.allclose(row[2 * q.WIDTH :], tail, atol=1e-3)
    layers = (np.ones((q.N_FEATURES, 3)) * 0.1, np.array([0.1, -0.2, 0.0]), np.array([[1.0], [-2.0], [0.5]]), np.array([0.3]))
    model = q.QualityModel(vectors, np.zeros(q.N_FEATURES), np.ones(q.N_FEATURES), layers, 2.0)
    for r in q.scores(table, model).collect():
        hidden = [max(0.0, sum(float(v) * 0.1 for v in rows[r["doc_id"]]) + b) for b in (0.1, -0.2, 0.0)]
        z = (hidden[0] - 2 * hidden[1] + 0.5 * hidden[2] + 0.3) / 2.0
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-4


def test_warc_odd_rows(spark):
    """Clashing names, nulls, empty and long bodies, and repeated rows."""
    from causalframe.llm.warc import audit, in_files, record

    pages = spark.createDataFrame([(1, "u", "x"), (2, None, None), (3, "v", ""), (4, "w", "y" * 2_000_000), (5, "a", "b"), (5, "a", "b"), (None, None, "z")], "page_id long, url string, html string")
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"))
    for name in ("file", "place", "offset", "ordinal", "before"):
        rows = rows.withColumn(name, F.lit(-1))
    for name in ("n", "w", "_part", "__part", "_n0", "start", "_first"):
        rows = rows.withColumn(name, F.lit("kept"))
    layout = in_files(rows, ["page_id"], 3)
    assert layout.count() == 7 and layout.where("n = 'kept' and w = 'kept' and _part = 'kept' and __part = 'kept' and _n0 = 'kept' and start = 'kept' and _first = 'kept'").count() == 7
    got = layout.orderBy("file", "place").collect()
    assert [(r["file"], r["place"]) for r in got] == [(i // 3, i % 3) for i in range(7)] and got[0]["page_id"] is None
    assert all(b["offset"] == a["offset"] + a["length"] for a, b in zip(got, got[1:]) if a["file"] == b["file"])
    changed = layout.withColumn("digest", F.when(F.col("page_id") == 4, F.lit("other")).otherwise(F.col("digest")))
    assert [(r["kind"], r["digest"] != r["replica_digest"]) for r in audit(layout, changed).collect()] == [("damaged", True)]
    assert in_files(rows.where("false"), ["page_id"]).count() == 0


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_against_plain_versions(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = table.collect()
    stage = dict(corpus_pipeline.STAGES)
    verdicts = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op10_toxicity"](spark, SMALL).collect()}
    assert texts_of(stage["toxicity"](spark, table, SMALL)) == Counter((r["doc_id"], r["text"]) for r in rows if not verdicts[r["doc_id"]])
    want = set(plain_groups([(r["doc_id"], r["text"]) for r in rows]).values())
    assert texts_of(stage["near duplicates"](spark, table, SMALL)) == Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] in want)

    def item_set(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    items = [item_set(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    own = {r["doc_id"]: item_set(r["text"]) for r in rows}
    dirty = {i for i, s in own.items() if any(len(s & item) >= math.ceil(0.8 * len(item) - 1e-9) for item in items)}
    assert dirty and texts_of(stage["decontamination"](spark, table, SMALL)) == Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in dirty)
    mixed = texts_of(stage["mixing"](spark, table, SMALL))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in queries.QUERIES["op4_mixing"](spark, SMALL).collect()}
    assert mixed == Counter({(r["doc_id"], r["text"]): n for r in rows if (n := taken[r["doc_id"]][0] // taken[r["doc_id"]][1] if taken[r["doc_id"]][1] else 1)})


def test_stages_of_odd_tables(spark):
    """Nulls, repeats, long texts, clashing columns and no rows pass every stage."""
    odd = docs(spark, ODD)
    for clash in ("row", "label", "node", "row_key", "mark", "one", "size", "own", "class", "copies", "score", "fp"):
        odd = odd.withColumn(clash, F.lit("clash"))
    kept, empty = odd, odd.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept, empty = stage(spark, kept, SMALL), stage(spark, empty, SMALL)
        assert kept.columns == odd.columns and empty.columns == odd.columns and empty.count() == 0, name
    tokens = corpus_pipeline.STAGES[-1][1]
    assert tokens(spark, kept, SMALL).count() == kept.count() > 0 and tokens(spark, empty, SMALL).count() == 0


def test_whole_pipeline_runs_twice_alike(spark):
    got = [sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2)]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == max(r[1] + r[2] for r in got[0])
