"""Projections whose rows are keyed streaming state: a batch touches only the keys that it has events for.

``Dispatcher`` stores rows in files that anyone can read; here Spark keeps each key's row in its state store and gives
out the rows, or all changes. An error of a policy that throws ends the query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldspark.operators.fold import ORDER, op_rows
from foldspark.plans.event_map import CREATE, CUSTOM, DELETE, THROW, UPDATE, ProjectionPlan


def _add(how: str, old: object, new: object) -> object:
    if how == "count":
        return (old or 0) + (new is not None)
    if new is None:
        return old
    if how == "sum":
        return (old or 0) + new
    return new if old is None else (min(old, new) if how == "min" else max(old, new))


def apply_op(plan: ProjectionPlan, row: dict | None, op: dict) -> dict | None:
    """The row after ``op`` (op, policy, accepts, has_<field>, v_<field>, add_<field>): the policies' truth table."""
    here = row is not None
    kind = op["op"]
    if op["policy"] == THROW and here == (kind == CREATE):
        raise RuntimeError({CREATE: f"Projection {plan.name} with key {op['key']} already exists.", UPDATE: f"Failed to find {plan.name} with key {op['key']}"}.get(kind, f"Could not delete {plan.name} with key {op['key']} because it does not exist"))
    if kind == DELETE:
        return None
    if here if kind == CREATE else not here:
        if not op["accepts"]:
            return row
    new = dict(row) if here else {n: 0 if how in ("sum", "count") else None for n, (_, how) in plan.fields.items()}
    for name, (_, how) in plan.fields.items():
        if op[f"has_{name}"]:
            new[name] = op[f"v_{name}"]
        if how and (op[f"add_{name}"] is not None):
            new[name] = _add(how, new[name], op[f"add_{name}"])
    return new


#: The state store that keyed state of this kind needs; it keeps rows on disk beside the executor and in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPS = ["op", "policy", "accepts"]


class _KeyedRows(StatefulProcessor):
    """The row of a key as a value state, and its last states as a list state where ``keep`` asks for them."""

    def __init__(self, plan: ProjectionPlan, state: str, versions: str, keep: int | None) -> None:
        self.plan, self.state, self.versions, self.keep = plan, state, versions, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.state)
        self.past = handle.getListState("past", self.versions) if self.keep else None

    def _load(self) -> dict | None:
        return dict(zip(self.plan.fields, self.row.get(), strict=True)) if self.row.exists() else None

    def _values(self, row: dict | None) -> tuple:
        return tuple(None if row is None else row[n] for n in self.plan.fields)

    def _named(self, row: dict | None) -> dict:
        return dict(zip(self.plan.fields, self._values(row), strict=True))

    def handleInitialState(self, key: tuple, initial: Row, timers: object) -> None:
        self.row.update(tuple(initial[n] for n in self.plan.fields))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        row = self._load()
        past = [tuple(x) for x in self.past.get()] if self.keep else []
        ops = sorted((r.asDict() for r in rows), key=lambda op: tuple(op[c] for c in ORDER))
        for op in ops:
            here = row is not None
            new = apply_op(self.plan, row, op)
            if self.keep is not None:
                took = here if op["op"] == DELETE else op["accepts"] or here != (op["op"] == CREATE)
                if took:
                    names = ("key", *ORDER, "op")
                    before = [Row(**dict(zip(("checkpoint", "exists", *self.plan.fields), x, strict=True))) for x in past]
                    yield Row(**{c: op[c] for c in names}, exists=new is not None, **self._named(new), past=before)
                    past = [*past, (op["checkpoint"], new is not None, *self._values(new))][-self.keep :] if self.keep else []
            row = new
        if row is None:
            self.row.clear()
        else:
            self.row.update(self._values(row))
        if self.keep and past:  # a key that has had a state has one for good
            self.past.put(past)
        if self.keep is None:
            yield Row(key=ops[0]["key"], exists=row is not None, **self._named(row))

    def close(self) -> None:
        pass


def _run(plan: ProjectionPlan, log: DataFrame, snapshot: DataFrame | None, keep: int | None) -> DataFrame:
    if plan.fields is None or plan.reads_row or plan.children_read:
        raise ValueError("rows as keyed state are for maps with fields whose rules read neither their row nor a child's")
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    fields = plan.fields
    sets = [c for n in fields for c in (F.col(f"set_{n}").isNotNull().alias(f"has_{n}"), F.col(f"set_{n}.v").alias(f"v_{n}"))]
    adds = [f"add_{n}" for n, (_, how) in fields.items() if how]
    ops = op_rows(plan, log).where(F.col("op") != CUSTOM).select("key", *ORDER, *_OPS, *sets, *adds)
    row = ", ".join(f"`{n}` {kind}" for n, (kind, _) in fields.items())
    version = ", ".join(f"`{n}`: {kind}" for n, (kind, _) in fields.items())
    out = f"key {plan.key_type}, exists boolean, {row}"
    if keep is not None:
        out = f"key {plan.key_type}, checkpoint bigint, event_seq int, rule_seq int, op string, exists boolean, {row}, past array<struct<checkpoint: bigint, exists: boolean, {version}>>"
    bare = ProjectionPlan(plan.name, plan.key_type, plan.fields, (), (), plan.registry)  # no columns go to the tasks
    processor = _KeyedRows(bare, row, f"checkpoint bigint, exists boolean, {row}", keep)
    before = None if snapshot is None else snapshot.select(F.col("key").cast(plan.key_type).alias("key"), *(F.col(n).cast(kind).alias(n) for n, (kind, _) in fields.items())).groupBy("key")
    return ops.groupBy("key").transformWithState(processor, out, "update" if keep is None else "append", "none", before)


def stateful(plan: ProjectionPlan, log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """A streaming log as a stream of changed rows (key, exists, fields), in update mode. Events of a key run in order within a batch; batches in theirs.

    ``snapshot`` (key, fields) is what the state begins with, in a query that has no checkpoint yet. A row that is gone
    holds no state. What a key gets in one micro-batch is held to be sorted: ``maxFilesPerTrigger`` bounds it.
    """
    return _run(plan, log, snapshot, None)


def stateful_history(plan: ProjectionPlan, log: DataFrame, snapshot: DataFrame | None = None, keep: int = 0) -> DataFrame:
    """A streaming log as a stream of all changes (key, place, op, exists, fields, past), in append mode: what ``history_rows`` gives for a batch, accumulators included.

    ``past`` has the ``keep`` states that the key had before, the oldest first, carried over batches in state.
    """
    return _run(plan, log, snapshot, keep)
