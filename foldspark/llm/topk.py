"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout: a chunk holds one row of numbers per dimension. For a block of queries, distances are
accumulated block of dimensions by block of dimensions; after each, a candidate stays only if its partial score plus
the most that the remaining dimensions can add (the product of both remaining lengths) can still reach the query's
k-th best score so far. Survivors are compacted before the next block. Queries are dealt in blocks of fixed size, so
that what a task holds does not grow with the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of a chunk, chunks of a share, queries of a block, dimensions accumulated at a time, vectors that give each query its first bound.
CHUNK, SHARE, QUERY_BLOCK, DIMS, SEEDS = 4096, 4, 1024, 16, 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_PACKED = "dim int, ids binary, keys binary, m binary"


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, x as double; whole doubles, of any size.

    Vectors that are null or hold a null or non-finite component, or one that is no longer finite when scaled, and rows
    with a null vec_id, take no part. Vectors of different lengths are never compared.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") * scale)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # F.floor gives a long; from 2**53 on a double is whole already
    floor = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable).select("vec_id", F.size("v").alias("dim"), floor.alias("v"))


def _pack(size: int):
    """Rows (vec_id, key, dim, v) to chunks of one dimension: ids, keys, and the matrix with a row per dimension, of 16-bit numbers where they fit."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        count: dict[int, int] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            ids, keys, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            count.pop(dim)
            for at in range(0, len(ids), size):
                m = rows[at : at + size].T
                narrow = np.abs(m).max(initial=0) < 1 << 15
                m = np.ascontiguousarray(m, dtype=np.int16 if narrow else np.float64)
                columns = [pa.array([x[at : at + size].tobytes()], pa.binary()) for x in (ids, keys)]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns, pa.array([m.tobytes()], pa.binary())], names=["dim", "ids", "keys", "m"])

        for b in batches:
            ids, keys, dims = (b.column(n).to_numpy() for n in ("vec_id", "key", "dim"))
            flat, first = b.column("v").flatten().to_numpy(), np.cumsum(dims) - dims
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                held.setdefault(d, []).append((ids[at], keys[at], flat[first[at][:, None] + np.arange(d)]))
                count[d] = count.get(d, 0) + len(at)
                if count[d] >= size or sum(count.values()) >= 4 * size:
                    yield from out(max(count, key=count.get))
        while held:
            yield from out(next(iter(held)))

    return chunks


def _matrix(dim: int, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.int16 if len(m) == 2 * dim * len(i) else np.float64).astype(np.float64).reshape(dim, len(i))


def _rest(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """For each cut, the length of every vector over the dimensions from there on."""
    square = np.cumsum((m * m)[::-1], axis=0)[::-1]
    return [np.sqrt(square[c]) if c < len(m) else np.zeros(m.shape[1]) for c in cuts]


def search_block(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place, ids, scores) of up to ``k`` best candidates that reach ``floor``, ties included as the smaller ids win them."""
    dim = len(c)
    exact = dim * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < 2.0**53
    if not exact:  # beyond doubles: whole numbers of any size
        q, c = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(c)
    cuts = list(range(min(DIMS, dim), dim, DIMS)) + [dim] if exact else [dim]
    first = q[: cuts[0]].T @ c[: cuts[0]] if dim else np.zeros((len(qids), len(cids)))
    if exact:
        rest_q, rest_c = _rest(q, cuts), _rest(c, cuts)
    for j in range(len(qids)):
        alive, part = np.arange(len(cids)), first[j]
        for n, at in enumerate(cuts):
            if n:
                part = part + q[cuts[n - 1] : at, j] @ c[cuts[n - 1] : at, alive]
            if exact and at < dim:
                keep = part + rest_q[n][j] * rest_c[n][alive] * (1 + 1e-9) + 1e-6 >= floor[j]
                alive, part = alive[keep], part[keep]
        other = cids[alive] != qids[j]
        ids, score = cids[alive][other], part[other]
        if exact:
            keep = score >= floor[j]
            ids, score = ids[keep], score[keep].astype(np.int64)
        else:
            score = np.array([min(max(x, _LEAST), _MOST) for x in score], dtype=np.int64)
        if len(ids) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[near], score[near]
        best = sorted(range(len(ids)), key=lambda i: (-int(score[i]), ids[i]))[:k]
        yield j, ids[best], score[best]


def _seeded(seeds: list[tuple[int, list[float]]], k: int):
    """Blocks of queries, each with the k-th best score of each query among ``seeds``: what others must reach from the first chunk on."""
    by: dict[int, list] = {}
    for i, v in seeds:
        by.setdefault(len(v), []).append((i, v))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors = []
            for dim, ids, m in zip(*(b.column(n).to_pylist() for n in ("dim", "ids", "m")), strict=True):
                qi, q = _matrix(dim, ids, m)
                floor = np.full(len(qi), -np.inf)
                if dim in by:
                    c = np.array([v for _, v in by[dim]], dtype=np.float64).reshape(len(by[dim]), dim).T
                    for j, best, score in search_block(qi, q, np.array([i for i, _ in by[dim]], dtype=np.int64), c, k, floor.copy()):
                        if len(best) == k and abs(int(score[-1])) < 1 << 53:
                            floor[j] = score[-1]
                floors.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.binary())], names=[*b.schema.names, "floor"])

    return blocks


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with every other row, ties to the smaller vec_id.

    ``candidates`` and ``queries`` are results of ``quantize``. A row is no candidate for queries with its own vec_id;
    repeated rows are candidates each. Query rows equal in id and vector are one query; different vectors of one id are
    queries of their own, each with ranks from 1. A score beyond 64 bits counts as the nearest 64-bit number.
    """
    packed = candidates.withColumn("key", F.lit(0).cast("long")).mapInArrow(_pack(CHUNK), _PACKED)
    queries = queries.dropDuplicates(["vec_id", "v"]).withColumn("key", F.xxhash64("v"))
    blocks = queries.repartition(max(1, math.ceil(queries.count() / QUERY_BLOCK))).mapInArrow(_pack(QUERY_BLOCK), _PACKED)
    seeds = [(r.vec_id, r.v) for r in candidates.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "v").limit(SEEDS).collect()]
    blocks = blocks.mapInArrow(_seeded(seeds, k), f"{_PACKED}, floor binary")
    # a set of queries against all rows, in blocks: chunks are dealt over shares, and each share gets every block
    shares = max(1, math.ceil(candidates.count() / (SHARE * CHUNK)))
    blocks = blocks.select("dim", F.col("ids").alias("qids"), F.col("keys").alias("qkeys"), F.col("m").alias("qm"), "floor", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    pairs = packed.drop("keys").withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).join(blocks, ["dim", "share"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # the k-th best score so far of a block's queries; the last few blocks
        for b in batches:
            for dim, ids, m, qids, qkeys, qm, least in zip(*(b.column(n).to_pylist() for n in ("dim", "ids", "m", "qids", "qkeys", "qm", "floor")), strict=True):
                (ci, c), (qi, q), keys = _matrix(dim, ids, m), _matrix(dim, qids, qm), np.frombuffer(qkeys, np.int64)
                if len(known) > 64:
                    known.clear()
                floor = known.setdefault(qids + qkeys, np.frombuffer(least, np.float64).copy())
                found = []
                for j, best, score in search_block(qi, q, ci, c, k, floor):
                    found.append((np.full(len(best), qi[j]), np.full(len(best), keys[j]), best, score))
                    if len(best) == k and score[-1] > floor[j] and abs(int(score[-1])) < 1 << 53:
                        floor[j] = score[-1]
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["query_id", "key", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, key long, vec_id long, score long")
    # the bitwise complement turns the order round and, unlike the negative, is there for every long
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id"))), 1, k)
    # two steps: lists of a query are cut to k within 16 salts before they meet
    salted = found.groupBy("query_id", "key", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).agg(best.alias("best"))
    merged = salted.select("query_id", "key", F.explode("best").alias("b")).groupBy("query_id", "key").agg(F.slice(F.sort_array(F.collect_list("b")), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.bitwise_not("b.less").alias("score"))


def op10_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every row whose vec_id is divisible by 50."""
    vectors = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


QUERIES = {"op10_branch_and_bound": op10_branch_and_bound}
SQL = {
    "op10_branch_and_bound": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
