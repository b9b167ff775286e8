"""Best-two-fit packing of tokenized documents into sequences of fixed length.

What fits where depends on lengths alone, and there are at most ``capacity`` of them. So the plan is made from the
histogram of lengths: a sequence is filled greedily, largest first; then, while it helps, its smallest piece gives way
to the two unpacked pieces that fill its expanded gap most tightly. The pattern found is used for as many sequences as
the histogram allows. Pieces then find their places by their rank among the pieces of their length. The plan's size is
bounded by ``capacity``, not by the data; ranks come from salted groups and a table of their offsets, with as many
groups to a length as it has pieces for. A piece of full length is a sequence of its own and needs no rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.bpe import encoder
from foldspark.llm.common import cut, sized

CAPACITY = 2048
#: Pieces of one length that are ranked in one group, as many as one task sorts with ease; the table of offsets has at most CAPACITY + pieces / PER_GROUP rows.
PER_GROUP = 250_000
VOCABULARY = "byte_bpe_50k"
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and one end id, cut into pieces of ``capacity`` if there are more.

    Of a document that is cut, the first piece takes the remainder. A null or empty text is one piece of the end id.
    """
    tokenizer, ranks = tokenizer or public_tokenizers.path(f"{VOCABULARY}.json"), ranks or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = []
                for i, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for piece, b in enumerate(range(first, len(ids) + 1, capacity)):
                        a = max(0, b - capacity)
                        out.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns: (lengths of a sequence's pieces, number of such sequences), using up ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    there = sum(1 << n for n in left)  # bit n: pieces of length n are left
    patterns = []

    def largest(most: int, mask: int) -> int:
        return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int, by: int) -> None:
        nonlocal there
        left[n] -= by
        there = there | 1 << n if left[n] else there & ~(1 << n)

    while there:
        items, gap = [], capacity
        while gap and (n := largest(gap, there)) > 0:
            by = min(left[n], gap // n)
            take(n, by)
            items += [n] * by
            gap -= n * by
        while gap and there:
            small = items[-1]
            room, best = gap + small, (small, 0, 0)
            a = largest(room - 1, there)
            while a > 0 and 2 * a > best[0] and best[0] < room:
                b = largest(min(a, room - a), there)
                if b == a and left[a] < 2:
                    b = largest(a - 1, there)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(a - 1, there)
            if best[0] <= small:
                break
            items.pop()
            take(small, -1)
            for n in best[1:]:
                take(n, 1)
            items = sorted([*items, *best[1:]], reverse=True)
            gap = room - best[0]
        need = Counter(items)
        more = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            if more:
                take(n, more * c)
        patterns.append((items, 1 + more))
    return patterns


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Arrays sorted by key = length << 40 | first rank: key, places a sequence has for the length, first sequence, where its offsets are; and the offsets."""
    used: Counter = Counter()
    rows, offsets, sequence = [], [], 0
    for items, times in patterns:
        at, by = 0, {}
        for n in items:
            by.setdefault(n, []).append(at)
            at += n
        for n, own in by.items():
            rows.append((n << 40 | used[n], len(own), sequence, len(offsets)))
            offsets += own
            used[n] += times * len(own)
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return (*table.T, np.array(offsets, dtype=np.int64))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP) -> DataFrame:
    """``pieces`` (any columns, with length) with sequence_id and offset. Pieces of one length are interchangeable; an empty table stays empty.

    ``pieces`` must be a stored table, as it is read several times and all reads must see the same rows. Sequences of
    one full piece have negative ids.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return full
    salts = spark.createDataFrame([(n, 1 + c // per_group) for n, c in sorted(counts.items())], "length int, salts long")
    salted = pieces.where(F.col("length") < capacity).join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), "salts").cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")), "pack-groups")
    key, each, first, where, offsets = _places(plan(counts, capacity))
    columns = pieces.columns
    shared = spark.sparkContext.broadcast((key, each, first, where, offsets))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(sized(groups.select("length", "salt", "base")), ["length", "salt"])
    ranked = ranked.select(*columns, (F.col("rank") + F.col("base")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, each, first, where, offsets = shared.value
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            row = np.searchsorted(key, length << 40 | rank, "right") - 1
            rank = rank - (key[row] & ((1 << 40) - 1))
            sequence, offset = first[row] + rank // each[row], offsets[where[row] + rank % each[row]]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all rows.

    Null and empty texts are one piece; a text of any length is cut only beyond ``capacity``; null ids stay null and
    repeated rows are packed each; pieces of one length take places in order of id and piece; an empty table gives an
    empty result. Other columns are left alone.
    """
    pieces = cut(token_pieces(docs, capacity), "pack-pieces")
    return pack(pieces, capacity).withColumn("length", F.col("length").cast("long"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens; odd rows as ``pack_documents`` states."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_best_two_fit": op9_best_two_fit}
SQL: dict[str, str] = {}
