"""Tables in the folder that the cluster shares, which cut lineage and outlive executors.

Lineage is cut by writing a table, never by localCheckpoint: the copy outlives any executor. The folder is
the one named by spark.checkpoint.dir; where that is unset, a local-mode session gets one of its own and any
other session is refused, as a machine-local folder would not be seen by its executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; where that is unset, and the session is local, in a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="causalframe-")
    return f"{found.rstrip('/')}/causalframe/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path, schema = shared_path(df.sparkSession, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked for broadcasting if it is counted to have at most rows rows, of a few values each, and for a merge join if not."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path, and the path in it."""
    path = uri.removeprefix("file:")
    return fs.FileSystem.from_uri("file:///" + path.lstrip("/") if path.startswith("/") else uri)
