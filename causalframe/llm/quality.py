"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated temperature.

Every token has a sparse random index vector, fixed by the hash of its bucket; its word vector is that, plus the sum of
the index vectors of its neighbours over the whole corpus (Kanerva, Kristoferson and Holst 2000). A document is the
mean of its tokens' vectors, their spread, and how alike neighbours are. Sums over the corpus are whole numbers, so
they do not depend on the order of rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm.labelled import fold, sample, with_texts
from causalframe.llm.scratch import table, written

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS = 8192
WIDTH = 64
MARKS = 2
REACH = 2
STEP = 1 << 15
_buckets: dict[str, int] = {}


def token_ids(text: str | None) -> np.ndarray:
    """The bucket of each token: runs of letters in their case, of digits, of other marks. Buckets are remembered within bounds."""
    if len(_buckets) > 400_000:
        _buckets.clear()
    out = []
    for t in TOKEN.findall(text or ""):
        b = _buckets.get(t)
        if b is None:
            b = _buckets[t] = zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS
        out.append(b)
    return np.array(out, np.int32)


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), MARKS of each for every bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, MARKS)), rng.choice([-1, 1], (BUCKETS, MARKS))


def _neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, d0, d1, ...) sums of neighbours' index vectors over all texts; each task sends one row a bucket at most."""
    names = [f"d{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH, np.int64)

        def add(ids: np.ndarray, owner: np.ndarray) -> None:
            for step in range(1, REACH + 1):
                if len(ids) <= step:
                    continue
                same = owner[step:] == owner[:-step]
                left, right = ids[:-step][same], ids[step:][same]
                for word, near in ((left, right), (right, left)):
                    for m in range(MARKS):
                        total[:] += np.bincount(word * WIDTH + places[near, m], weights=signs[near, m], minlength=BUCKETS * WIDTH).astype(np.int64)

        for batch in batches:
            held, owner, size = [], [], 0
            for n, text in enumerate(batch.column(0)):
                ids = token_ids(text.as_py()).astype(np.int64)
                held.append(ids)
                owner.append(np.full(len(ids), n))
                size += len(ids)
                if size > 8 * STEP:
                    add(np.concatenate(held), np.concatenate(owner))
                    held, owner, size = [], [], 0
            if held:
                add(np.concatenate(held), np.concatenate(owner))
        total = total.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, i]) for i in range(WIDTH)]], ["bucket", *names])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A BUCKETS x WIDTH array: 2 MB, whatever the corpus."""
    rows = written(_neighbours(docs), "neighbours").toPandas()
    context = np.zeros((BUCKETS, WIDTH))
    if len(rows):
        context[rows["bucket"].to_numpy()] = rows[[f"d{i}" for i in range(WIDTH)]].to_numpy()
    context = np.sign(context) * np.log1p(np.abs(context))
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, WIDTH))
    for m in range(MARKS):
        np.add.at(own, (np.arange(BUCKETS), places[:, m]), signs[:, m] / math.sqrt(MARKS))
    return (own + context).astype(np.float32)


N_FEATURES = 2 * WIDTH + 6


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's tokens; how alike neighbours are; shares of kinds of characters; length. Zeros if it has none."""
    text = text or ""
    ids = token_ids(text)
    out = np.zeros(N_FEATURES, np.float32)
    if not len(ids):
        return out
    total, square, near = np.zeros(WIDTH), np.zeros(WIDTH), 0.0
    for at in range(0, len(ids), STEP):
        v = vectors[ids[at : at + STEP + 1]]
        near += float(np.einsum("ij,ij->", v[1:], v[:-1]))
        v = v[:STEP]
        total += v.sum(axis=0)
        square += np.einsum("ij,ij->j", v, v)
    mean = total / len(ids)
    out[:WIDTH] = mean
    out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(0, square / len(ids) - mean**2))
    repeats = float(np.count_nonzero(ids[1:] == ids[:-1])) / len(ids)
    out[2 * WIDTH :] = (near / len(ids), float(mean @ mean), repeats, len(np.unique(ids)) / len(ids), math.log1p(len(ids)), len(text) / len(ids) / 10)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(0, (x - self.mean) / self.scale @ a + b) @ c[:, 0] + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> QualityModel:
    """Adam on the log loss of four fifths of the rows; the other fifth sets the temperature and which epoch is kept."""
    rng = np.random.default_rng(seed)
    order = np.lexsort((*x.T[:8], y))  # then rows' order does not matter
    order = order[rng.permutation(len(order))]
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    own = len(x) // 5
    layers = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, 1)), np.zeros(1)]
    model = QualityModel(vectors, mean, scale, tuple(layers))
    if len(x) < 10 or len(set(y.tolist())) < 2:
        model.layers = (layers[0] * 0, layers[1], layers[2], np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1))]))
        return model
    z = (x - mean) / scale
    held, z_in, y_in = (z[:own], y[:own]), z[own:], y[own:]
    m, v, t, best = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0, None
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z_in)), max(1, len(z_in) // 128)):
            a, b, c, d = layers
            h = np.maximum(0, z_in[rows] @ a + b)
            g = (1 / (1 + np.exp(-np.clip(h @ c[:, 0] + d[0], -30, 30))) - y_in[rows])[:, None] / len(rows)
            gh = (g @ c.T) * (h > 0)
            grads = [z_in[rows].T @ gh + 1e-4 * a, gh.sum(axis=0), h.T @ g + 1e-4 * c, g.sum(axis=0)]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                layers[i] = layers[i] - 0.002 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        a, b, c, d = layers
        loss = _log_loss(np.maximum(0, held[0] @ a + b) @ c[:, 0] + d[0], held[1])
        if best is None or loss < best[0]:
            best = (loss, tuple(p.copy() for p in layers))
    model.layers = best[1]
    logits = model.logits(x[:own])
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda k: _log_loss(logits / k, held[1])))
    return model


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _pool(texts: DataFrame, vectors: np.ndarray, mark: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t.as_py(), shared.value) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float32())), batch.column(1)], ["x", "y"])

    return texts.select("text", F.col(mark).cast("int")).mapInArrow(run, "x array<float>, y int")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, limit: int = 20_000) -> QualityModel:
    """Word vectors from every text; the network from at most limit labelled documents outside the held-out fold."""
    vectors = word_vectors(docs)
    chosen = written(sample(labels, "quality", fold(F.col("doc_id"), folds) == held_out, limit), "quality-sample")
    rows = _pool(with_texts(docs, chosen), vectors, "quality").toPandas()
    x = np.stack(rows["x"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, N_FEATURES))
    if not len(x):
        return QualityModel(vectors, np.zeros(N_FEATURES), np.ones(N_FEATURES), (np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)))
    return train(x, (rows["y"].to_numpy() > 0).astype(float), vectors)


def scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for each row of docs. Null and empty texts have the score of no tokens; repeated rows stay; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [pooled(t.as_py(), model.vectors) for t in batch.column(1)]
            score = model.score(np.stack(rows).astype(np.float64)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents. Labels of the held-out fold, crc32 of the id modulo 4 = 2, are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
