"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record hashes to one of ``n_slots`` slots for good; only the map from slots to shards changes. Rebalancing edits
the map: each shard keeps its slots up to an equal share of the bytes and gives up the rest, which go, largest first,
to the least loaded shard. All of it is DataFrame code; the map has ``n_slots`` rows whatever the data's size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import cut, shared_dir

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row; the texts themselves never shuffle.

    A null text counts as empty: size 1, checksum 0; a text of any length is one record. A null doc_id hashes like any
    other value. The slot depends on the id and the text's checksum, so one id that many different rows carry does not
    fill one slot; rows that repeat both are one slot's, whose bytes no map can part. Other columns are left alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_stats(recs: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has rows: map-side sums, at most ``n_slots`` rows a task to shuffle."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: equal runs of slots."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(slot.alias("virtual_slot"), F.floor(slot * n_shards / n_slots).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map for these slot sizes and ``n_shards`` shards.

    Slots of shards that no longer exist are given out; empty slots stay where they are. Ties go by slot number.
    """
    slots = slot_map.join(F.broadcast(stats), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / n_shards
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    slots = slots.withColumn("keeps", (F.col("shard") < n_shards) & (upto <= share))
    kept = F.sum(F.when(F.col("keeps"), F.col("bytes"))).over(Window.partitionBy("shard"))
    free = F.when(~F.col("keeps"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes"))
    one = slots.withColumn("load", kept).agg(F.sort_array(F.collect_list(free)).alias("free"), F.map_from_entries(F.collect_set(F.struct("shard", "load"))).alias("loads"))
    start = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.coalesce(F.try_element_at("loads", s), F.lit(0)).cast("long"))
    least = lambda acc: F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")  # noqa: E731  from 1
    picked = F.aggregate(
        "free",
        F.struct(start.alias("loads"), F.array().cast("array<int>").alias("picks")),
        lambda acc, x: F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == least(acc) - 1, v + x["bytes"]).otherwise(v)).alias("loads"),
            F.concat(acc["picks"], F.array(least(acc) - 1)).alias("picks"),
        ),
        lambda acc: acc["picks"],
    )
    moved = one.select(F.explode(F.arrays_zip("free", picked.alias("picks"))).alias("m")).select(F.col("m.free.virtual_slot").alias("virtual_slot"), F.col("m.picks").alias("to"))
    return slots.join(F.broadcast(moved), "virtual_slot", "left").select("virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Append this version to the stored map; older versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == version)


def shard(recs: DataFrame, stats: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard, and its place there: gapless from 0 in each shard.

    The place is the number of rows in the shard's earlier slots plus the row's number in its slot, so the work is
    spread over all slots, not over the few shards.
    """
    ordered = Window.partitionBy("shard").orderBy("virtual_slot")
    slots = slot_map.join(F.broadcast(stats), "virtual_slot").withColumn("base", F.sum("n_rows").over(ordered) - F.col("n_rows"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return recs.join(F.broadcast(slots.select("virtual_slot", "shard", "base", "version")), "virtual_slot").withColumn("slot", F.col("base") + within - 1)


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7 under the law ``bytes``: shard sizes near equal.

    The map is stored in two versions, the first one and its edit for the slots' bytes, and records follow the latest.
    An empty table gives an empty result; repeated rows are rows like others; ties go by slot, then id, checksum, size.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    recs = cut(records(docs), "shard-records")
    stats = cut(slot_stats(recs).coalesce(1), "shard-slots")
    path = f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    write_map(initial_map(spark, 8), path)
    write_map(rebalance(read_map(spark, path), stats, 8), path)
    return shard(recs, stats, read_map(spark, path)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


QUERIES = {"op1_virtual_slots": op1_virtual_slots}
SQL: dict[str, str] = {}
