import random
import re

from pyspark.sql import functions as F

from causalframe.llm import neardup

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _first(rows, least=0.8):
    """Least id of each row's group, by all pairs."""
    sets, up = {i: _set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or len(a & b) >= least * len(a | b) - 1e-9):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_of_many_bits(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(80, 700))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice((0, 0.01, 0.02, 0.03)))):
                copy[at] = f"e{rng.randrange(9)}"
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one two"), (i + 3, "Two, one"), (i + 4, "ONE two!")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC)
    want = _first(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_groups(docs).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_chains_and_odd_rows(spark):
    words = [f"w{i}" for i in range(200)]
    chain = [(k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(12)]  # neighbours are alike, the ends are not
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in chain], DOC)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_groups(docs).collect()} == _first(chain)
    assert neardup.near_groups(docs.where("false")).count() == 0
    odd = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert neardup.first_of_groups(odd).where("doc_id is not null").count() == len(set(_first(chain).values()))
