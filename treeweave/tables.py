"""Cutting lineage, and broadcasting what is known to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of requests up to this many rows is broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors read, ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation of what led to it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` is counted to have no more than ``rows`` rows."""
    rows = SMALL if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is."""
    return F.broadcast(df) if is_small(df, rows) else df
