"""Projections over streams: a subscription with policies for errors, retries and restarts.

Each micro-batch of the log is folded on top of the stored rows of the keys that it concerns, and what it changed is
written as a version of its own named after the batch. A batch that runs again replaces its version, so its effect is
applied once.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.operators.projector import Projector
from foldspark.sources.log import after
from foldspark.sources.tables import scratch, sized
from foldspark.streaming.store import SnapshotStore

log = logging.getLogger(__name__)


class Resolution(Enum):
    ABORT = "abort"
    RETRY = "retry"
    IGNORE = "ignore"


@dataclass
class Info:
    """What a handler is told: the subscription, and the batch and its last checkpoint."""

    id: str
    batch_id: int | None = None
    checkpoint: int | None = None


@dataclass
class SubscriptionOptions:
    """``exception_handler(error, attempts, info)`` decides what an error does; attempts count from 1. Abort is the default.

    ``success_handler(info)`` runs after each batch, under the same policy. ``restart_when_ahead``: if the subscriber is
    ahead of the log, run ``before_restarting(info)`` and start from nothing.
    """

    id: str = "projection"
    exception_handler: Callable[[Exception, int, Info], Resolution] = lambda error, attempts, info: Resolution.ABORT
    success_handler: Callable[[Info], None] = lambda info: None
    restart_when_ahead: bool = False
    before_restarting: Callable[[Info], None] = lambda info: None
    reader_options: dict[str, str] = field(default_factory=dict)


class Dispatcher:
    """Subscribes projectors to a log. ``stream`` makes the streaming log, ``batch`` reads what is there now."""

    def __init__(self, stream: Callable[[dict[str, str]], DataFrame], batch: Callable[[], DataFrame]) -> None:
        if stream is None or batch is None:
            raise ValueError("a streaming and a batch log are needed")
        self.stream, self.batch = stream, batch
        #: The last checkpoint that each subscription has handled here.
        self.handled: dict[str, int] = {}
        self._progress = threading.Condition()

    def handle_batch(self, projector: Projector, store: SnapshotStore, rows: DataFrame, batch_id: int, options: SubscriptionOptions) -> None:
        """One micro-batch under the policy. Ignore keeps what came before the error and goes on with the next batch."""
        rows = rows.persist()  # read once for all projections and attempts
        try:
            self._handle_batch(projector, store, rows, batch_id, options)
        finally:
            rows.unpersist()

    def _handle_batch(self, projector: Projector, store: SnapshotStore, rows: DataFrame, batch_id: int, options: SubscriptionOptions) -> None:
        info, attempts = Info(options.id, batch_id, rows.agg(F.max("checkpoint")).first()[0]), 0
        on_error = "raise"
        while True:
            attempts += 1
            try:
                with scratch(rows.sparkSession):
                    self._project(projector, store, rows, batch_id, on_error)
                if on_error == "raise":
                    options.success_handler(info)
                self._handled(info)
                return
            except Exception as error:
                what = options.exception_handler(error, attempts, info)
                if what is Resolution.ABORT:
                    log.critical("subscription %s is stopped", options.id, exc_info=error)
                    raise
                if what is Resolution.IGNORE:
                    if on_error == "cut":
                        self._handled(info)
                        return
                    on_error = "cut"

    def _project(self, projector: Projector, store: SnapshotStore, rows: DataFrame, batch_id: int, on_error: str) -> None:
        """Fold the batch on the stored rows of its keys and of those that its rules look up, and store what has changed."""
        keys = projector.keys(rows)
        before = {n: s for n, (_, needed) in keys.items() if (s := store.read(n, batch_id, needed)) is not None}
        result = projector.project(rows, before, on_error)
        for name, state in self._states(projector, result):
            own, needed = keys[name]
            if own is None:
                store.write(name, batch_id, state)
                continue
            if needed is own:  # the rows are those of the batch's keys as they are
                touched = lambda found: found
            else:
                touched = lambda found, own=own: found.join(sized(own.select(F.col("key").alias("_key"))), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
            changes = touched(state).withColumn("exists", F.lit(True))
            if name in before:
                left = state.select(F.col("key").alias("_key"))
                gone = touched(before[name]).join(left, F.col("key").eqNullSafe(F.col("_key")), "left_anti")
                changes = changes.unionByName(gone.select("key", *(F.lit(None).cast(t).alias(n) for n, t in state.dtypes if n != "key"), F.lit(False).alias("exists")))
            store.apply(name, batch_id, changes)

    def _handled(self, info: Info) -> None:
        with self._progress:
            self.handled[info.id] = max(self.handled.get(info.id, 0), info.checkpoint or 0)
            self._progress.notify_all()

    def wait_until_checkpoint(self, query: StreamingQuery, checkpoint: int, timeout: float | None = None) -> bool:
        """Wait until the query has handled ``checkpoint``; whether it did in ``timeout`` seconds. Raises what ended the query."""
        end = None if timeout is None else time.monotonic() + timeout
        with self._progress:
            while self.handled.get(query.name, 0) < checkpoint:
                if not query.isActive:
                    if query.exception() is not None:
                        raise query.exception()
                    return False
                if end is not None and time.monotonic() > end:
                    return False
                self._progress.wait(0.1)
        return True

    def _states(self, projector: Projector, result) -> list[tuple[str, DataFrame]]:
        own = [(projector.plan.name, result.state)] if result.state is not None else []
        return [*own, *(x for c in projector.children for x in self._states(c, result.children[c.plan.name]))]

    def subscribe(self, projector: Projector, store: SnapshotStore, checkpoint_dir: str, from_checkpoint: int | None = None, options: SubscriptionOptions | None = None, available_now: bool = True) -> StreamingQuery | None:
        """Start the query. None if a restart was due and its handler said abort.

        Each restart has a progress folder of its own beside ``checkpoint_dir``, named by its number; later
        subscriptions go on in the last one.
        """
        options = options or SubscriptionOptions()
        restarts = self._restarts(store, checkpoint_dir.rstrip("/"))
        if from_checkpoint is not None and options.restart_when_ahead and from_checkpoint > (self.batch().agg(F.max("checkpoint")).first()[0] or 0):
            attempts = 0
            while True:
                attempts += 1
                try:
                    options.before_restarting(Info(options.id))
                    break
                except Exception as error:
                    what = options.exception_handler(error, attempts, Info(options.id))
                    if what is Resolution.ABORT:
                        log.critical("subscription %s cannot restart", options.id, exc_info=error)
                        return None
                    if what is Resolution.IGNORE:
                        break
            store.clear()
            self.handled.pop(options.id, None)
            restarts, from_checkpoint = restarts + 1, None
        if restarts:
            checkpoint_dir = f"{checkpoint_dir.rstrip('/')}-restart-{restarts}"
        rows = after(self.stream(options.reader_options), from_checkpoint)
        writer = rows.writeStream.queryName(options.id).option("checkpointLocation", checkpoint_dir)
        writer = writer.foreachBatch(lambda batch, n: self.handle_batch(projector, store, batch, n, options))
        return (writer.trigger(availableNow=True) if available_now else writer).start()


    @staticmethod
    def _restarts(store: SnapshotStore, checkpoint_dir: str) -> int:
        """The number of the last restart that has begun to read."""
        pattern = store.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir}-restart-*")
        found = pattern.getFileSystem(store.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return max((int(n) for n in (s.getPath().getName().rpartition("-")[2] for s in found) if n.isdigit()), default=0)


def has_subscription(spark: SparkSession, id: str) -> bool:
    """Whether exactly one query of this name runs; two are an error."""
    found = [q for q in spark.streams.active if q.name == id]
    if len(found) > 1:
        raise ValueError(f"{len(found)} subscriptions are called {id}")
    return bool(found)


def catch_up(query: StreamingQuery) -> None:
    """Wait until all that is in the log now has been handled; raises what ended the query."""
    query.processAllAvailable()
    if query.exception() is not None:
        raise query.exception()
