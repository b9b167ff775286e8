"""The canonical event log and how tables, files and appends become one.

A log row is an event in its envelope; (checkpoint, event_seq) orders the log. Checkpoints begin at 1: a subscription
from nothing starts at 0 and gets what is strictly greater.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.sources.tables import written
from foldspark.sources.zipped import SPAN, ZippedLines

ENVELOPE = ["checkpoint", "event_seq", "transaction_id", "stream_id", "timestamp_utc", "transaction_headers", "event_headers", "event_type", "body"]
#: Envelope of logs whose bodies are JSON text.
JSON_LOG = (
    "checkpoint bigint, event_seq int, transaction_id string, stream_id string, timestamp_utc timestamp_ntz, "
    "transaction_headers map<string,string>, event_headers map<string,string>, event_type string, body string"
)
_NO_HEADERS = "cast(map() as map<string,string>)"


def transaction_id(own: Column, checkpoint: Column) -> Column:
    """A missing or empty id is the checkpoint's decimal digits."""
    return F.coalesce(F.when(own != "", own), checkpoint.cast("string"))


def make_log(
    df: DataFrame, *, checkpoint: Column, event_type: Column, body: Column, event_seq: Column | None = None, own_id: Column | None = None, stream_id: Column | None = None,
    timestamp: Column | None = None, transaction_headers: Column | None = None, event_headers: Column | None = None,
) -> DataFrame:
    """A log from any table; what is not given is empty. Rows without a type are rejected where they are read, by NULL checks of the maps."""
    none = F.expr(_NO_HEADERS)
    return df.select(
        checkpoint.cast("long").alias("checkpoint"), (F.lit(0) if event_seq is None else event_seq).cast("int").alias("event_seq"),
        transaction_id(F.lit(None).cast("string") if own_id is None else own_id, checkpoint.cast("long")).alias("transaction_id"),
        (F.lit(None) if stream_id is None else stream_id).cast("string").alias("stream_id"), (F.lit(None) if timestamp is None else timestamp).cast("timestamp_ntz").alias("timestamp_utc"),
        F.coalesce(none if transaction_headers is None else transaction_headers, none).alias("transaction_headers"), F.coalesce(none if event_headers is None else event_headers, none).alias("event_headers"),
        event_type.cast("string").alias("event_type"), body.alias("body"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log with a transaction for each event; checkpoints are event_id + 1."""
    return as_events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_events_log(events: DataFrame) -> DataFrame:
    key = F.get_json_object("props", "$.k")
    return make_log(
        events, checkpoint=F.col("event_id") + 1, event_type=F.col("event_type"), stream_id=F.col("user_id").cast("string"), timestamp=F.col("ts"),
        event_headers=F.map_from_arrays(F.array(F.lit("k")), F.array(key)), body=F.struct("event_id", "user_id", "value"),
    )


def after(log: DataFrame, checkpoint: int | None) -> DataFrame:
    """What a subscription from ``checkpoint`` gets: strictly greater ones.

    The filter reaches the scan of a log that stores its checkpoints. Where they are worked out, as in ``events_log``,
    filter the stored column before (``events_after``): Spark does not turn the sum round.
    """
    return log.where(F.col("checkpoint") > (checkpoint or 0))


def events_after(spark: SparkSession, sf_dir: str, checkpoint: int | None) -> DataFrame:
    """``after`` of ``events_log``, by a filter on the stored event_id that the scan takes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") >= (checkpoint or 0))
    return as_events_log(rows)


def is_ahead(log: DataFrame, checkpoint: int | None) -> bool:
    """Whether a subscriber's checkpoint is beyond the log's last one; an empty log ends at 0."""
    return checkpoint is not None and checkpoint > (log.agg(F.max("checkpoint")).first()[0] or 0)


#: Rows of a range, about, and ranges at most: what is worked out over all ranges at once has a row for each.
RANGE_ROWS, RANGES = 10_000, 100_000


def _in_ranges(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` by the order of ``order``, with _range (the partition, in that order) and _at (the row's number in it, from 1); nulls come first.

    Spark samples quantiles and deals rows out by them, so ranges hold about as many rows each however the values lie;
    rows of one value stay together. The table is written, so that all that is derived from it sees the same ranges.
    """
    count = rows.count()
    parts = max(1, min(RANGES, count // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id())
    return written(dealt, "ranges").withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())))


def in_batches(log: DataFrame, size: int) -> DataFrame:
    """``log`` with batch_id: transactions in checkpoint order in batches of ``size``, the last may be short.

    Transactions are numbered over ranges of checkpoints, so no task sees them all: counts of ranges give the offsets.
    """
    if size < 1:
        raise ValueError("a batch holds one transaction at least")
    own = _in_ranges(log.select("checkpoint").distinct(), "checkpoint")
    before = _before(own.groupBy("_range").agg(F.count(F.lit(1)).alias("n")))
    numbered = own.join(before, "_range").withColumn("at", F.col("before") + F.col("_at") - 1)
    return log.join(numbered.select("checkpoint", F.floor(F.col("at") / size).alias("batch_id")), "checkpoint")


def _before(ranges: DataFrame) -> DataFrame:
    """``ranges`` (_range, n, ...; a row for each range) with ``before``: the rows of all earlier ranges."""
    return ranges.withColumn("before", F.sum("n").over(Window.orderBy("_range")) - F.col("n"))


def assign_checkpoints(transactions: DataFrame, order: str, last: int = 0) -> DataFrame:
    """Give transactions whose checkpoint is -1 or null the next ones after ``last``; explicit ones replace the counter, as they come in ``order`` (a column of any type that has an order).

    The counter restarts at each explicit checkpoint, so each transaction is the last explicit one before it plus its
    distance from there. Ranges of ``order`` are worked on by themselves; what a range takes over from those before it,
    the last explicit checkpoint and its distance, comes from a table with a row for each range.
    """
    upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    explicit = F.when(F.col("checkpoint") != -1, F.col("checkpoint"))
    rows = _in_ranges(transactions, order)
    rows = rows.withColumn("_own", F.last(F.when(explicit.isNotNull(), F.struct(explicit.alias("base"), F.col("_at").alias("at"))), ignorenulls=True).over(upto))
    ranges = _before(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.max_by("_own", "_at").alias("own"))).withColumnRenamed("before", "start")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("own").isNotNull(), F.struct(F.col("own.base").alias("base"), (F.col("start") + F.col("own.at")).alias("at")))
    first = F.struct(F.lit(last).cast("long").alias("base"), F.lit(0).cast("long").alias("at"))
    ranges = ranges.select("_range", "start", F.coalesce(F.last(known, ignorenulls=True).over(earlier), first).alias("_before"))
    found = F.coalesce(F.col("_own.base") + F.col("_at") - F.col("_own.at"), F.col("_before.base") + F.col("start") + F.col("_at") - F.col("_before.at"))
    return rows.join(ranges, "_range").withColumn("checkpoint", found.cast("long")).select(*transactions.columns)


def check_order(log: DataFrame, on_disorder: str = "error") -> DataFrame:
    """Reject logs with two events at one place. Order itself is a sort key, so ``sort`` needs no more than that."""
    if on_disorder == "error" and log.groupBy("checkpoint", "event_seq").count().where("count > 1").limit(1).count():
        raise ValueError("two events have the same checkpoint and sequence")
    return log


def read_json_zip(spark: SparkSession, path: str, page_size: int = 100, per_transaction: int = 6, span: int = SPAN) -> DataFrame:
    """JSON lines of the first ``*.json`` entry of each zip as a log: six events a transaction, ``page_size`` transactions a page.

    Page k (from 0) begins at checkpoint k * (page_size + 1) + 1, so one number is skipped between pages. Of several
    zips the pages follow one another in order of path, each file beginning a page of its own. The type is the class
    name in ``$type``, without name space and assembly; no class is made from it. An entry is unpacked as a stream, in
    several tasks if it has more than ``span`` bytes.
    """
    spark.dataSource.register(ZippedLines)
    found = spark.read.format("zipped_lines").option("path", path).option("span", span).load()
    found = found.withColumn("event_type", _class_name(F.col("text")))
    per_page = page_size * per_transaction
    pages = found.groupBy("path").agg(F.ceil((F.max("line") + 1) / per_page).alias("pages"))  # a row for each file
    before = pages.select(F.col("path").alias("_path"), (F.sum("pages").over(Window.orderBy("path")) - F.col("pages")).alias("_page"))
    numbered = found.join(before, F.col("path") == F.col("_path"))
    transaction = F.floor(F.col("line") / per_transaction)
    page = F.col("_page") + F.floor(transaction / page_size)
    return make_log(numbered, checkpoint=page * (page_size + 1) + transaction % page_size + 1, event_seq=F.col("line") % per_transaction, event_type=F.col("event_type"), body=F.col("text"))


def stream_json_zip(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(path, line, event_type, text) of zips as they come. Checkpoints are for the one who appends them to a log: they depend on how many pages the earlier zips have."""
    spark.dataSource.register(ZippedLines)
    found = spark.readStream.format("zipped_lines").option("path", path).option("span", span).load()
    return found.select("path", "line", _class_name(F.col("text")).alias("event_type"), "text")


def _class_name(text: Column) -> Column:
    kind = F.coalesce(F.get_json_object(text, "$['$type']"), F.lit(""))
    return F.element_at(F.split(F.split(kind, ",")[0], "\\."), -1)


@dataclass
class Transaction:
    """A transaction to append; events are (type, body) or (type, body, headers)."""

    events: Iterable[tuple]
    checkpoint: int = -1
    id: str = ""
    stream_id: str | None = None
    timestamp_utc: datetime | None = None
    headers: dict[str, str] = field(default_factory=dict)


class LogStore:
    """An append-only log in a folder of Parquet files, for batch and streaming readers. One writer at a time.

    Each append is a folder named by the last checkpoint in it, ``upto=n``: the log's end is known from names alone, and
    a reader from a checkpoint opens no file of an append that ends before it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._last: int | None = None

    def read(self, after_checkpoint: int | None = None) -> DataFrame:
        log = self.spark.read.schema(f"{JSON_LOG}, upto bigint").parquet(self.path)
        return after(log.where(F.col("upto") > (after_checkpoint or 0)).drop("upto"), after_checkpoint)

    def stream(self, **options: str) -> DataFrame:
        return self.spark.readStream.schema(f"{JSON_LOG}, upto bigint").options(**options).parquet(self.path).drop("upto")

    def last(self) -> int:
        """The last checkpoint, 0 where there is none; from the names of folders, without a job."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/upto=*")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return max((int(s.getPath().getName().partition("=")[2]) for s in found), default=0)

    def wait_for_growth(self, checkpoint: int, timeout: float = 30, poll: float = 0.1) -> bool:
        """Wait until the log goes beyond ``checkpoint``; whether it did in ``timeout`` seconds."""
        end = time.monotonic() + timeout
        while self.last() <= checkpoint:
            if time.monotonic() > end:
                return False
            time.sleep(poll)
        return True

    def write_events(self, *events: tuple) -> int:
        return self.write(Transaction(events))

    def write_with_headers(self, event: tuple, headers: dict[str, str]) -> int:
        """One event with headers of its own (not the transaction's)."""
        return self.write(Transaction([(*event, headers)]))

    def write(self, *transactions: Transaction) -> int:
        """Append; returns the last checkpoint. -1 takes the next number; an explicit one replaces the counter."""
        if self._last is None:
            self._last = self.last()
        rows = []
        for t in transactions:
            self._last = self._last + 1 if t.checkpoint == -1 else t.checkpoint
            for seq, (kind, body, *headers) in enumerate(t.events):
                rows.append((self._last, seq, t.id or str(self._last), t.stream_id or str(uuid.uuid4()), t.timestamp_utc, t.headers, headers[0] if headers else {}, kind, json.dumps(body, default=str)))
        if rows:
            self.spark.createDataFrame(rows, JSON_LOG).coalesce(1).withColumn("upto", F.lit(max(r[0] for r in rows)).cast("long")).write.mode("append").partitionBy("upto").parquet(self.path)
        return self._last
