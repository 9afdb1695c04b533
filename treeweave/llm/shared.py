"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``; a local one only where it is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors and is not computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python by ``rows`` rather than by Spark's default of 10,000, unless the session has a setting of its own: a batch is held several times over."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the remainder 2 is held out from training."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    """True where the id's remainder is 2; a null id has no remainder and is not held out."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


_HELD: dict[str, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` made for ``key`` in this Python worker. Workers outlive operators, so only the last one asked for is kept."""
    if _HELD.get("key") != key:
        _HELD.clear()
        release()
        _HELD["value"] = make()
        _HELD["key"] = key
    return _HELD["value"]


def let_go() -> None:
    """Forget what an earlier operator left in this Python worker."""
    if _HELD:
        _HELD.clear()
        release()


def release() -> None:
    """Give memory that Python no longer uses back to the system, where its C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
