"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder, read back: what stands above it is worked out once, and a lost executor costs a re-read."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_here, "made", None) is not None:
        _here.made.append(path)
    rows.write.partitionBy(*partitions).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that this thread writes by ``written`` in the block when it ends; what they were for must be stored by then.

    Outside such a block they stay until the folder is cleared, since results are read from them.
    """
    outer, _here.made = getattr(_here, "made", None), []
    try:
        yield
    finally:
        made, _here.made = _here.made, outer
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows up to which a keyed lookup table may be broadcast.
BROADCAST_ROWS = 200_000


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, marked for broadcast if it has at most ``rows`` rows."""
    return table.hint("broadcast") if table.limit(rows + 1).count() <= rows else table
