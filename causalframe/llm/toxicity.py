"""Toxic passages as maximal-scoring segments of token log-odds.

Learning: log-odds of words and of word beginnings between toxic and other labelled documents, with Dirichlet priors
(Monroe, Colaresi and Quinn 2008); those that are significant make the lexicon. Scanning: every word scores its
log-odds, or a small penalty if it has none, and one linear pass finds all maximal segments (Ruzzo and Tompa 1999).
Aggregation: segment scores are set against what chance gives in a text of that length, by extreme-value sum
statistics (Karlin and Altschul 1990, 1993), and a logistic map of these gives a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.labelled import fold, sample, with_texts
from causalframe.llm.scratch import table, tidy, written

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are counted beside whole words.
STEMS = (4, 5)
#: Scores are whole numbers of quarters of a unit of log-odds.
SCALE = 4
PENALTY = 3
TOP = 63


@dataclass
class ToxicModel:
    """lexicon: score by word, or by beginning with a * behind it. rate: lambda of the extreme-value law."""

    lexicon: dict[str, int] = field(default_factory=dict)
    rate: float = 0.25
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0)
    heads: frozenset[str] = frozenset()

    def __post_init__(self):
        self.heads = frozenset(w.rstrip("*")[: STEMS[0]] for w in self.lexicon)


def segments(scores: list[tuple[int, int]], length: int, penalty: int = PENALTY) -> list[tuple[int, int, int]]:
    """All maximal-scoring segments (start, end, score) of a text of length words; end is exclusive.

    scores: (position, positive score) in ascending order; all other words score -penalty.
    """
    total, at = 0, 0
    found: list[list[int]] = []  # start, end, total before, total after, index of the last segment with a smaller total before
    for place, score in scores:
        total -= penalty * (place - at)
        at = place + 1
        item = [place, at, total, total + score, -1]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item[0], item[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after, _ in found]


def passages(text: str | None, model: ToxicModel) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of words of a text, and its maximal segments."""
    words = WORD.findall((text or "").lower())
    head, heads, get = STEMS[0], model.heads, model.lexicon.get
    hits = []
    for at in [i for i, w in enumerate(words) if w[:head] in heads]:
        w = words[at]
        score = max(get(w, 0), *(get(w[:n] + "*", 0) if len(w) > n else 0 for n in STEMS))
        if score > 0:
            hits.append((at, score))
    return len(words), segments(hits, len(words))


def statistics(length: int, found: list[tuple[int, int, int]], rate: float) -> tuple[float, float, int]:
    """Of a text: the best segment and the best sum of segments in excess of chance, in nats; how many are significant."""
    chance = math.log(max(length, 1))
    excess = sorted((rate * s - chance for _, _, s in found), reverse=True)
    best, total, most = 0.0, 0.0, 0.0
    for r, x in enumerate(excess, 1):
        total += x + math.log(r)
        most = max(most, total)
    if excess:
        best = max(0.0, excess[0])
    return best, most, sum(x > 3 for x in excess)


def _features(best: float, total: float) -> tuple[float, float, float]:
    return 1.0, math.log1p(best), math.log1p(total)


def probability(length: int, found: list[tuple[int, int, int]], model: ToxicModel) -> float:
    best, total, _ = statistics(length, found, model.rate)
    z = sum(w * x for w, x in zip(model.weights, _features(best, total)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counts(texts: DataFrame, mark: str) -> DataFrame:
    """(unit, toxic, other): in how many texts of either kind each word and each beginning is. Units are pre-summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def out():
            units = list(sums[0].keys() | sums[1].keys())
            rows = [units, [sums[1][u] for u in units], [sums[0][u] for u in units]]
            for c in sums:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["unit", "toxic", "other"])

        for batch in batches:
            for text, bad in zip(batch.column(0), batch.column(1)):
                words = set(WORD.findall((text.as_py() or "").lower()))
                into = sums[int(bad.as_py() > 0)]
                into.update(words)
                into.update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
                into[""] += len(words)
                if len(sums[0]) + len(sums[1]) > 100_000:
                    yield out()
        yield out()

    rows = texts.select("text", F.col(mark).cast("int")).mapInArrow(tidy(run), "unit string, toxic long, other long")
    return rows.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(texts: DataFrame, mark: str = "toxic", prior: float = 0.5, strength: float = 1000.0, least_z: float = 3.0, least_odds: float = 4.0) -> tuple[dict[str, int], float]:
    """Scores of the units whose log-odds are significantly toxic and no less than least_odds, and the rate of the extreme-value law.

    Each unit's Dirichlet prior is prior plus strength times its share of all counts. texts is a bounded sample, and so are the units in it.
    """
    counts = written(_counts(texts, mark), "toxic-counts")
    whole = counts.where("unit = ''").first()
    if not whole or not whole["toxic"] or not whole["other"]:
        return {}, 0.25
    t, o = float(whole["toxic"]), float(whole["other"])
    a = prior + strength * (F.col("toxic") + F.col("other")) / (t + o)
    odds = lambda y, n: F.log((y + a) / (n + strength - y - a))
    delta = odds(F.col("toxic"), t) - odds(F.col("other"), o)
    z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    top = counts.where("unit != '' and toxic >= 3").select("unit", "other", delta.alias("delta"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("delta") >= least_odds))
    rows = top.orderBy("unit").collect()
    scores = {r["unit"]: max(1, min(TOP, round(SCALE * r["delta"]))) for r in rows}
    chance = np.zeros(TOP + 1)
    for r in rows:
        chance[scores[r["unit"]]] += r["other"]
    return scores, _rate((chance + (np.bincount(list(scores.values()), minlength=TOP + 1) > 0)) / o)


def _rate(chance: np.ndarray, penalty: int = PENALTY) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the scores that other words have by chance."""
    values = np.arange(len(chance))
    rest = max(1e-9, 1 - chance.sum())
    low, high = 1e-4, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        grown = rest * math.exp(-mid * penalty) + float(chance @ np.exp(mid * values))
        low, high = (mid, high) if grown < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = 24_000) -> ToxicModel:
    """A model from at most limit labelled documents outside the fold 0. Without both kinds of label it finds nothing."""
    texts = with_texts(docs, written(sample(labels, "toxic", fold(F.col("doc_id"), folds) == 0, limit), "toxic-sample"))
    scores, rate = lexicon(texts)
    model = ToxicModel(scores, rate)
    if not scores:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(*passages(t.as_py(), model), model.rate)[:2] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(1)], ["best", "total", "toxic"])

    got = texts.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(run), "best double, total double, toxic int").toPandas()
    x = np.array([_features(b, t) for b, t in zip(got["best"], got["total"])])
    model.weights = _logistic(x, (got["toxic"].to_numpy() > 0).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    order = np.lexsort((*x.T, y))  # sums then do not depend on the order in which rows came
    x, y, w = x[order], y[order], np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, n_passages and passages (start, end, score in log-odds) for each row of docs.

    Positions count words. A null or empty text has no passage and the score of such texts. Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score, count, spans = [], [], []
            for text in batch.column(1):
                length, found = passages(text.as_py(), model)
                score.append(probability(length, found, model))
                count.append(statistics(length, found, model.rate)[2])
                spans.append([{"start": s, "end": e, "score": v / SCALE} for s, e, v in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int32()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "n_passages", "passages"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, score double, n_passages int, passages array<struct<start:int,end:int,score:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least; the columns of docs. Texts pass through the scoring and need no join."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [probability(*passages(t.as_py(), model), model) < least for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents. Labels of the held-out fold, crc32 of the id modulo 5 = 0, are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = scores(docs, model)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
