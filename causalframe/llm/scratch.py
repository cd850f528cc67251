"""Tables of the input and in between, and names and memory that operators must not take from others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from causalframe.sources.shared import filesystem, saved, shared_path, small

__all__ = ["filesystem", "fresh", "new_path", "small", "table", "tidy", "written"]

new_path, written = shared_path, saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator], Iterator[pa.RecordBatch]]) -> Callable[[Iterator], Iterator[pa.RecordBatch]]:
    """run; at its end, memory that Arrow keeps for later is given back, as a Python worker outlives its tasks."""

    def tidied(batches: Iterator) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
