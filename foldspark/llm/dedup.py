"""Exact duplicates by a content sort.

Normalised texts are range-partitioned by splitters that Spark samples, sorted externally inside each range, and every
row is compared in full with its neighbour. A range is cut at (first bytes, digest, doc_id), so what is sampled for a
splitter is a few dozen bytes whatever the text's length, and a text that a third of all rows share is spread over as
many ranges as its rows need. Runs that reach the edge of a range are joined to those beyond it by a table of at most
two rows a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import cut
from foldspark.llm.words import text_bytes

#: Bytes of a text that splitters compare before its digest decides.
HEAD = 32
_KEYED = "doc_id long, n long, head binary, sha binary, body binary"
_RUNS = "doc_id long, sha binary, keep_id long, group_size long, kept boolean, part int, side int, tail boolean"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the normalised text, its first bytes and digest; ``n`` tells repeated rows of a task apart."""
    seen = 0
    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        low = data.copy()
        low[(low >= 65) & (low <= 90)] += 32
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        body = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low)])
        columns = [
            b.column("doc_id"), pa.array(np.arange(seen, seen + b.num_rows)), pa.array([low[i : min(i + HEAD, j)].tobytes() for i, j in spans], pa.binary()),
            pa.array([hashlib.sha256(low[i:j]).digest() for i, j in spans], pa.binary()), body,
        ]
        seen += b.num_rows
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "head", "sha", "body"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to runs of equal texts: whole ones are settled here, those at the range's edges are marked (side 0 and 1).

    Of a run that is still open, ids are held, one text and no other row.
    """
    part, names = TaskContext.get().partitionId(), ["doc_id", "sha", "keep_id", "group_size", "kept", "part", "side", "tail"]
    ids: list[pa.Array] = []
    last = sha = None
    first = True

    def whole(doc_id: pa.Array, shas: pa.Array, ends: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        """Rows of settled runs: ``ends`` is the place of each row's last neighbour."""
        at = np.arange(len(ends))
        none = pa.nulls(len(ends), pa.int32())
        return pa.RecordBatch.from_arrays([doc_id, shas, doc_id.take(pa.array(ends)), pa.array(sizes), pa.array(at == ends), none, none, pa.nulls(len(ends), pa.bool_())], names=names)

    def close(at_end: bool) -> Iterator[pa.RecordBatch]:
        """The open run, ``at_end`` of the range or before."""
        own = pa.concat_arrays(ids)
        n = len(own)
        same = pa.array([sha], pa.binary()).take(pa.array(np.zeros(n, np.int64)))
        if not first and not at_end:
            yield whole(own, same, np.full(n, n - 1), np.full(n, n))
            return
        tail = pa.array(np.arange(n) == n - 1)
        yield pa.RecordBatch.from_arrays([own, same, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, 0 if first else 1, np.int32)), tail], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        doc_id, body, n = b.column("doc_id"), b.column("body"), b.num_rows
        begins = np.ones(n, bool)
        begins[1:] = ~pc.equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = last is None or body[0].as_py() != last
        starts = np.flatnonzero(begins)
        goes_on = int(starts[0]) if len(starts) else n  # rows that belong to the open run
        if goes_on:
            ids.append(doc_id[:goes_on])
        if len(starts):
            if ids:
                yield from close(False)
                first = False
            if first and len(starts) > 1:  # the range's first run begins and ends in this batch
                ids, sha = [doc_id[: starts[1]]], b.column("sha")[0].as_py()
                yield from close(False)
                first, starts = False, starts[1:]
            a, z = int(starts[0]), int(starts[-1])
            if z > a:
                lengths = np.diff(starts)
                yield whole(doc_id[a:z], b.column("sha")[a:z], np.repeat(starts[1:] - a - 1, lengths), np.repeat(lengths, lengths))
            ids, sha = [doc_id[z:]], b.column("sha")[z].as_py()
        last = body[n - 1].as_py()
    if ids:
        yield from close(True)


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text; other columns are left alone).

    Texts are equal if they are the same bytes after lower-casing A-Z; null counts as empty, and empty texts are a
    group. ``keep`` says whose row stays, the ``largest`` or the ``smallest`` doc_id; a null id is the last to stay. Of
    rows that repeat id and text just one stays. An empty table gives an empty result. Rows of one text that lie in
    several ranges meet by its digest, rows inside a range by all their bytes.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    by_id = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_keys, _KEYED)
    ranged = keyed.repartitionByRange("head", "sha", by_id, "n").drop("n").sortWithinPartitions("head", "sha", by_id)
    rows = cut(ranged.mapInArrow(_runs, _RUNS), "exact-runs")
    # at most two rows a range
    edges = rows.where("side is not null").groupBy("part", "side").agg(F.first("sha").alias("sha"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("tail"), F.struct("doc_id"))).alias("last"))
    place = Window.orderBy("part", "side")
    edges = edges.withColumn("new", F.when(F.col("sha") == F.lag("sha").over(place), 0).otherwise(1)).withColumn("chain", F.sum("new").over(place))
    whole = Window.partitionBy("chain").orderBy("part", "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.last(F.struct("part", "side")).over(whole)
    edges = edges.select("part", "side", F.last("last").over(whole)["doc_id"].alias("_keep"), F.sum("n").over(whole).alias("_size"), (F.struct("part", "side") == end).alias("_ends"))
    inner = F.col("side").isNull()
    return rows.join(F.broadcast(edges), ["part", "side"], "left").select(
        "doc_id", F.when(inner, F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"), F.when(inner, F.col("group_size")).otherwise(F.col("_size")).alias("group_size"),
        F.when(inner, F.col("kept")).otherwise(F.col("tail") & F.col("_ends")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; the row with the largest doc_id stays. Odd rows: see ``exact_groups``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_content_sort": op11_content_sort}
SQL = {
    "op11_content_sort": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
""",
}
