"""Shared plumbing of the training-data operators: shared-folder tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed lookup table (a few dozen bytes a row) may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local session gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that this process has cut and not removed.
_made: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This ends its lineage: a lost executor costs a re-read, not the work above the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were cut in the block when it ends, save the last one, which holds what the block was for."""
    first = len(_made)
    yield
    for path in _made[first:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[first:-1]


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``table`` for broadcast if it has at most ``rows`` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
