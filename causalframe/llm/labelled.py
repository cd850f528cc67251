"""Labelled rows for the two classifiers: a bounded sample of ids, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold (null)."""
    return F.crc32(key.cast("string")) % folds


def sample(labels: DataFrame, mark: str, held_out: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, mark) for at most limit labelled rows outside the held-out fold, those of the least key hash.

    Rows with a null key or mark are no labels; a key with several marks takes the largest. limit bounds what may be
    broadcast or gathered from here on.
    """
    clean = labels.where(F.col(key).isNotNull() & F.col(mark).isNotNull() & ~held_out)
    clean = clean.groupBy(key).agg(F.max(mark).alias(mark))
    return clean.orderBy(F.xxhash64(key), key).limit(limit)


def with_texts(docs: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, mark) of the chosen ids, which sample() bounds, so that they are broadcast to where the texts are."""
    return docs.select(key, "text").join(F.broadcast(chosen), key)
