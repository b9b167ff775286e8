"""Product codes of vectors, with a VA-file to find each part's nearest codebook entry.

Vectors of whole numbers are cut into parts; each part position has a codebook of at most 64 entries. The coordinates of
the entries are quantised to cells of a few bits. For a part to encode, two tables per coordinate give the least and the
most that any entry of a cell can add to its distance; sums over the cells of an entry bound its distance from both
sides, and only entries whose lower bound does not exceed the least upper bound are measured, in whole numbers.

Codebooks are refined in rounds: tasks give out sums by entry and position, Spark adds them up, and what reaches the
driver is the codebook, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import cut, sized

#: Parts of a vector, entries of a part's codebook, rounds, bits of a cell, rows encoded at once.
PARTS, ENTRIES, ROUNDS, BITS, BLOCK = 16, 64, 2, 4, 2048
_MOST = (1 << 63) - 1
#: A codebook for each vector length: for each part an array (entries, width).
Books = dict[int, list[np.ndarray]]


def bounds_of_parts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Consecutive parts, equal where ``dim`` is a multiple of ``parts``; else the first ones are one longer."""
    each, more = divmod(dim, parts)
    ends = np.cumsum([each + (n < more) for n in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def whole_numbers(vectors: pa.Array, scale: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * x)) of each vector length; vectors that are null or hold a component that is null, not finite, or not finite when scaled are left out."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(scale * flat[first[rows][:, None] + np.arange(dim)])
        good = np.isfinite(v).all(axis=1)
        yield rows[good], _exact(v[good])


def _exact(v: np.ndarray) -> np.ndarray:
    """64-bit numbers where sums of squares stay within them, else whole numbers of any size."""
    if np.abs(v).max(initial=0) < 1 << 20:
        return v.astype(np.int64)
    return np.vectorize(int, otypes=[object])(v) if v.size else v.astype(object)


class Cells:
    """The cells of one codebook's coordinates: for coordinate j, entries of cell c lie within low[j][c] and high[j][c]."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries, n = entries, len(entries)
        self.cell, self.low, self.high = [], [], []
        for column in entries.T:
            ranks = np.argsort(column, kind="stable")
            cell = np.empty(n, np.int64)
            cell[ranks] = np.arange(n) * min(n, 1 << bits) // max(n, 1)  # as many entries in each
            groups = [column[cell == c] for c in range(min(n, 1 << bits))]
            self.cell.append(cell)
            self.low.append(np.array([g.min() for g in groups], dtype=entries.dtype))
            self.high.append(np.array([g.max() for g in groups], dtype=entries.dtype))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance, pairs measured) of each row of ``q``; ties to the lower entry."""
        n, k = len(q), len(self.entries)
        wide = object if q.dtype == object or self.entries.dtype == object else np.int64
        least, most = np.zeros((n, k), wide), np.zeros((n, k), wide)
        for j, cell in enumerate(self.cell):
            x = q[:, j : j + 1]
            below, above = self.low[j] - x, x - self.high[j]
            outside = np.maximum(np.maximum(below, above), 0)
            across = np.maximum(np.abs(below), np.abs(above))
            least += (outside * outside)[:, cell]
            most += (across * across)[:, cell]
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        gap = q[row] - self.entries[entry]
        measured = (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(row), wide)
        # rows come in order, entries within a row too: a stable sort by distance puts the first of the nearest first
        order = np.lexsort((entry, measured, row)) if wide is not object else np.array(sorted(range(len(row)), key=lambda i: (row[i], measured[i], entry[i])), dtype=np.int64)
        best = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
        return entry[best], measured[best], len(row)


def assign(v: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of entries and of squared distances."""
    codes, errors = np.zeros((len(v), len(cells)), np.int64), np.zeros((len(v), len(cells)), object if v.dtype == object else np.int64)
    at = bounds_of_parts(v.shape[1], len(cells))
    for n in range(0, len(v), BLOCK):
        for p, (a, b) in enumerate(at):
            codes[n : n + BLOCK, p], e, _ = cells[p].nearest(v[n : n + BLOCK, a:b])
            if errors.dtype != object and e.dtype == object:
                errors = errors.astype(object)
            errors[n : n + BLOCK, p] = e
    return codes, errors


def _sums(books: Books):
    """Rows (dim, part, entry, at, total, n) of a task: sums over the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {dim: [Cells(b) for b in own] for dim, own in books.items()}
        totals = {dim: ([np.zeros(b.shape, object) for b in own], [np.zeros(len(b), np.int64) for b in own]) for dim, own in books.items()}
        for batch in batches:
            for _, v in whole_numbers(batch.column("embedding")):
                if not len(v):
                    continue
                dim = v.shape[1]
                codes, _ = assign(v, cells[dim])
                for p, (a, b) in enumerate(bounds_of_parts(dim, len(cells[dim]))):
                    part = np.zeros(totals[dim][0][p].shape, v.dtype)
                    np.add.at(part, codes[:, p], v[:, a:b])
                    totals[dim][0][p] = totals[dim][0][p] + part.astype(object)
                    totals[dim][1][p] += np.bincount(codes[:, p], minlength=len(part))
        out = [
            (dim, p, e, at, Decimal(int(total[e, at])), int(counts[p][e]))
            for dim, (sums, counts) in totals.items() for p, total in enumerate(sums) for e in range(len(total)) if counts[p][e] for at in range(total.shape[1])
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "part", "entry", "at", "total", "n"])

    return run


def first_books(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Books:
    """For each vector length, the parts of the vectors with the smallest ids: ``entries`` rows each reach the driver. Null ids come last."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, v in whole_numbers(b.column("embedding")):
                # as text: whole numbers of any size
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), v.shape[1], np.int32)), pa.array([" ".join(map(str, r)) for r in v.tolist()], pa.string())], names=["vec_id", "dim", "v"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(kept, "vec_id long, dim int, v string")
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v"))
    found: dict[int, list] = {}
    for r in rows.withColumn("place", place).where(F.col("place") <= entries).orderBy("dim", "place").collect():
        found.setdefault(r.dim, []).append([int(x) for x in r.v.split()])
    books = {}
    for dim, own in found.items():
        m = _exact(np.array(own, dtype=object).reshape(len(own), dim))
        books[dim] = [m[:, a:b] for a, b in bounds_of_parts(dim, parts)]
    return books


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> Books:
    """Codebooks after ``rounds`` of assigning all parts and moving each used entry to the floor of its parts' mean."""
    books = first_books(vectors, entries, parts)
    for _ in range(rounds if books else 0):
        sums = vectors.select("embedding").mapInArrow(_sums(books), "dim int, part int, entry int, at int, total decimal(38, 0), n long")
        moved = {dim: [b.astype(object) for b in own] for dim, own in books.items()}
        for r in sums.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.dim][r.part][r.entry, r["at"]] = int(r.total) // r.n
        books = {dim: [_exact(b) for b in own] for dim, own in moved.items()}
    return books


def digest(own: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in own for e in b.tolist() for x in e).encode()).hexdigest()


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): codes as two hex digits a part; an error beyond 64 bits counts as the largest number."""
    digests = {dim: digest(own) for dim, own in books.items()}
    label = vectors.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {dim: [Cells(b) for b in own] for dim, own in books.items()}
        for batch in batches:
            for rows, v in whole_numbers(batch.column("embedding")):
                if not len(v):
                    continue
                codes, errors = assign(v, cells[v.shape[1]])
                at, hexed = pa.array(rows), codes.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([r.tobytes().hex() for r in hexed], pa.string()),
                        pa.array([min(int(x), _MOST) for x in errors.sum(axis=1)], pa.int64()), pa.array([digests[v.shape[1]]] * len(rows), pa.string()),
                    ],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label.simpleString()}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label; other columns are left alone).

    Vectors that are null or hold null or non-finite components take no part; each of several vector lengths has its own
    codebooks; fewer than 64 vectors make a smaller codebook; repeated rows are rows like others, and of rows that repeat
    an id the lesser vector as text begins the codebook. A null vec_id comes after all others; null labels are one label.
    An empty table gives an empty result. ``label_error`` stops at 64 bits.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = cut(encode(own, train(own, rounds)), "vector-codes")
    # a row for each label, summed before it is shuffled; a label that many rows have is split where the join is
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38, 0)")), F.lit(_MOST).cast("decimal(38, 0)")).cast("long").alias("label_error"))
    return rows.join(sized(sums), F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable ``embeddings``: 16 parts, 64 entries, 2 rounds. Odd rows: see ``compress``."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(books: str) -> str:
    return f"""SELECT x.vec_id, x.p, CAST(min(d * 64 + e) % 64 AS INTEGER) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS d FROM x JOIN {books} b ON b.p = x.p) x GROUP BY ALL"""


def _moved(books: str, assigned: str) -> str:
    return f"""SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS v FROM (
    SELECT a.p, a.e, j, CAST(sum(x.v[j]) AS BIGINT) AS s, count(*) AS n FROM {assigned} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS j) GROUP BY ALL) GROUP BY ALL) m
  ON m.p = b.p AND m.e = b.e"""


QUERIES = {"op12_va_file": op12_va_file}
SQL = {
    "op12_va_file": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < 64),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN k USING (vec_id), s
""",
}
