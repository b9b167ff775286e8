"""Projectors: a plan, its children, and how errors and retries are treated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foldspark.operators import fold
from foldspark.operators.capture import Risks, risks
from foldspark.operators.lookup import as_of, as_of_small
from foldspark.plans.event_map import CONDITION, CUSTOM, DELETE, THROW, ProjectionPlan
from foldspark.sources.tables import written


class ProjectionError(Exception):
    """An error of a projection: where, for which key, in which projection. A field that is set keeps its value."""

    _ONCE = ("projector", "child", "transaction_id", "event", "batch")

    def __init__(self, message: str, projector: str = "", child: str | None = None, transaction_id: str | None = None, event: dict | None = None, batch: tuple[int, int] | None = None) -> None:
        super().__init__(message)
        self.projector, self.child, self.transaction_id, self.event, self.batch = projector, child, transaction_id, event, batch

    def __setattr__(self, name: str, value: object) -> None:
        old = getattr(self, name, None)
        if name in self._ONCE and old not in (None, "") and old != value:
            raise RuntimeError(f"{name} is already set to a different value")
        super().__setattr__(name, value)


@dataclass
class ProjectionResult:
    """``state`` and ``children`` hold the rows up to the first error; the others say what happened."""

    state: DataFrame | None
    error: ProjectionError | None
    flagged: DataFrame | None
    custom_of: Callable[[], DataFrame]
    children: dict[str, ProjectionResult] = field(default_factory=dict)

    @cached_property
    def custom(self) -> DataFrame:
        """The events of custom actions, with the name of each; planned when it is asked for."""
        return self.custom_of()

    @property
    def misses(self) -> DataFrame:
        """Keys of deletes that found nothing, where the map asked to be told."""
        return self.flagged.where((F.col("op") == DELETE) & F.col("missed") & (F.col("policy") == CONDITION)).select("key", *fold.ORDER, "event_type")


def _message(op: str, name: str, key: object) -> str:
    return {
        "create": f"Projection {name} with key {key} already exists.",
        "update": f"Failed to find {name} with key {key}",
        "delete": f"Could not delete {name} with key {key} because it does not exist",
    }[op]


class Projector:
    """Runs a plan over a log. Children see each event before their parent does, and a child's error stops the parent too.

    ``should_retry(error, attempt)`` is asked when a run raises; attempts count from 1. A retried run starts from the
    same log and snapshot, and leaves out the actions that have finished, so nothing is applied twice. Children's
    actions run before their parent's. ``actions`` takes the events of the custom actions that it
    names, as DataFrames, and must name all that the map does unless it is left out (``ProjectionResult.custom`` has
    them then); ``around`` decorates them: it is given the action's name and events and a function that runs the action.
    ``split_every`` spreads keys with very many ops (see ``fold.flag``).
    """

    def __init__(
        self, plan: ProjectionPlan, children: list[Projector] | None = None, should_retry: Callable[[Exception, int], bool] | None = None, actions: dict[str, Callable[[DataFrame], None]] | None = None,
        split_every: int | None = None, around: Callable[[str, DataFrame, Callable[[], None]], None] | None = None,
    ) -> None:
        if plan is None or any(c is None for c in children or []):
            raise ValueError("a plan and no missing children are needed")
        names = [plan.name, *(n for c in children or [] for n in c.names())]
        if len(set(names)) < len(names):
            raise ValueError("each projection needs a name of its own")
        self.plan, self.children, self.should_retry, self.actions = plan, children or [], should_retry or (lambda error, attempt: False), actions or {}
        self.split_every, self.around = split_every, around or (lambda name, events, run: run())
        below = {p.plan.name: p.plan for p in self._in_order()[:-1]}
        for ref in plan.children_read:
            if ref.projection not in below:
                raise ValueError(f"{plan.name} reads {ref.projection}, which is no child of it")
            if below[ref.projection].fields is None or below[ref.projection].reads_row:
                raise ValueError(f"{ref.projection} has no history to read")
        named = {r.action for r in plan.rules if r.op == CUSTOM}
        if actions is not None and named - set(actions):
            raise ValueError(f"no action is given for: {', '.join(sorted(named - set(actions)))}")

    def names(self) -> list[str]:
        return [self.plan.name, *(n for c in self.children for n in c.names())]

    def _in_order(self) -> list[Projector]:
        """Children first, each before its parent."""
        return [*(p for c in self.children for p in c._in_order()), self]

    def flagged(self, log: DataFrame, snapshot: DataFrame | None = None, **more: Column) -> DataFrame:
        """This projection's op rows with what becomes of them (see ``fold.flag``), and ``more`` columns of their events. An error of a rule ends the job that reads them."""
        runs = self._runs(log, {} if snapshot is None else {self.plan.name: snapshot}, captured=False, more=more)
        return runs[self.plan.name].flagged

    def _runs(self, log: DataFrame, snapshots: dict[str, DataFrame], captured: bool = True, more: dict[str, Column] | None = None) -> dict[str, _Run]:
        """By name: each projection's log, with the child rows that its rules read, and its ops."""
        runs: dict[str, _Run] = {}
        for p in self._in_order():
            own, plan = p._with_children(log, runs), p.plan
            found = risks(plan, own) if captured else None
            run = _Run(plan, own, found if found and found.any else None)
            if plan.fields is not None:
                ops = fold.op_rows(plan, own, run.risks, more if p is self else None).where(~F.col("op").isin(CUSTOM, fold.FILTER))
                before = snapshots.get(plan.name)
                if before is not None:
                    ops = ops.unionByName(fold.snapshot_rows(plan, before), allowMissingColumns=True)
                if plan.reads_row:
                    run.ops = ops
                else:
                    run.flagged = fold.flag(ops, p.split_every)
            runs[plan.name] = run
        return runs

    def keys(self, log: DataFrame) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
        """By name: the keys that ``log`` may change, and those together with the ones that rules of parents look up. None: all."""
        own = {p.plan.name: fold.keys_of(p.plan, log) if p.plan.fields is not None else None for p in self._in_order()}
        needed = dict(own)
        for p in self._in_order():
            for ref in p.plan.children_read:
                if needed[ref.projection] is not None:
                    kind = own[ref.projection].schema["key"].dataType
                    needed[ref.projection] = needed[ref.projection].unionByName(log.where(p.plan.reads_child(ref)).select(ref.key.cast(kind).alias("key"))).distinct()
        return {n: (own[n], needed[n]) for n in own}

    def _with_children(self, log: DataFrame, runs: dict[str, _Run]) -> DataFrame:
        """``log`` with a column for each child row that rules read: the child's row as of the event, which the child has seen before.

        Only events whose rules read it are looked up: by a join with the child's history where that is small, else by one
        union with it and one window.
        """
        for ref in self.plan.children_read:
            child = runs[ref.projection]
            history = fold.history_rows(child.plan, child.flagged)
            fields = ["_exists", *(n for n, (_, how) in child.plan.fields.items() if how is None)]
            history = history.select(F.col("key").alias("_key"), *fold.ORDER, F.struct(F.col("exists").alias("_exists"), *fields[1:]).alias("_row"))
            history = written(history, "child-history")
            reads, key, order = self.plan.reads_child(ref), ref.key.cast(child.plan.key_type), ["checkpoint", "event_seq"]
            found = as_of_small(log, history, key, reads, order, "_row", ref.column)
            if found is not None:
                log = found
                continue
            found = as_of(log.where(reads).withColumn("_key", key), history, "_key", order, ["_row"], split_every=self.split_every)
            found = found.withColumnRenamed("_row", ref.column).drop("_key")
            others = log.where(~reads).withColumn(ref.column, F.lit(None).cast(found.schema[ref.column].dataType))
            log = found.unionByName(others)
        return log

    def project(self, log: DataFrame, snapshots: dict[str, DataFrame] | None = None, on_error: str = "raise") -> ProjectionResult:
        """Fold ``log`` on top of ``snapshots`` (by projection name). ``on_error``: ``raise``, or ``cut`` to keep what came before the error.

        Errors of keys, predicates, conditions and assignments are found before this returns, at their place in the
        order of all errors; an assignment counts where it is applied, a condition where it is asked.
        """
        if on_error not in ("raise", "cut"):
            raise ValueError("on_error is raise or cut")
        attempt, finished = 1, set()
        while True:
            try:
                return self._project(log, snapshots or {}, on_error, finished)
            except Exception as error:
                if not isinstance(error, ProjectionError):
                    wrapped = ProjectionError("Projector failed to project an event.", self.plan.name, getattr(error, "_child", None), batch=self._bounds(log))
                    wrapped.__cause__ = error
                    error = wrapped
                if not self.should_retry(error, attempt):
                    raise error from error.__cause__
                attempt += 1

    def _bounds(self, log: DataFrame) -> tuple[int, int] | None:
        """The checkpoints between which an error lies that names no event: those of the log, if it can be read."""
        try:
            low, high = log.agg(F.min("checkpoint"), F.max("checkpoint")).first()
        except Exception:  # the log itself is what failed
            return None
        return None if low is None else (low, high)

    def _project(self, log: DataFrame, snapshots: dict[str, DataFrame], on_error: str, finished: set) -> ProjectionResult:
        order, runs = self._in_order(), self._runs(log, snapshots)
        row = self._first_error(order, runs)
        error = cut = None
        if row is not None:
            plan = order[row.projection_seq].plan
            event = {"checkpoint": row.checkpoint, "event_seq": row.event_seq, "event_type": row.event_type, "key": row.key}
            message = "Projector failed to project an event." if row.foreign else _message(row.op, plan.name, row.key)
            error = ProjectionError(message, self.plan.name, None if plan is self.plan else plan.name, row.transaction_id, event, (row.checkpoint, row.checkpoint))
            if row.foreign:
                error.__cause__ = runs[plan.name].cause(row)
            if on_error == "raise":
                raise error
            cut = (row.checkpoint, row.event_seq, row.projection_seq, row.rule_seq)
        return self._result(order, runs, error, cut, finished)

    def _first_error(self, order: list[Projector], runs: dict[str, _Run]) -> Row | None:
        """The first op of all projections that failed: children before their parents at the same event."""
        found = [rows.withColumn("projection_seq", F.lit(seq)) for seq, p in enumerate(order) for rows in runs[p.plan.name].failures()]
        if not found:
            return None
        union = found[0]
        for more in found[1:]:
            union = union.unionByName(more)
        return next(iter(union.orderBy("checkpoint", "event_seq", "projection_seq", "rule_seq").take(1)), None)

    def _result(self, order: list[Projector], runs: dict[str, _Run], error: ProjectionError | None, cut: tuple | None, finished: set) -> ProjectionResult:
        seq, run = order.index(self), runs[self.plan.name]
        children = {c.plan.name: c._result(order, runs, error, cut, finished) for c in self.children}  # a child's actions run first
        place = F.struct("checkpoint", "event_seq", F.lit(seq).alias("p"), "rule_seq")
        before = F.lit(True) if cut is None else place < F.struct(F.lit(cut[0]).cast("long").alias("checkpoint"), F.lit(cut[1]).alias("event_seq"), F.lit(cut[2]).alias("p"), F.lit(cut[3]).alias("rule_seq"))
        custom = lambda: fold.op_rows(self.plan, run.log, run.risks).where((F.col("op") == CUSTOM) & before)
        every = custom() if self.actions else None
        for name, action in self.actions.items():
            if (self.plan.name, name, cut) in finished:
                continue
            events = every.where(F.col("action") == name)
            try:
                self.around(name, events, lambda action=action, events=events: action(events))
            except Exception as e:
                if order[-1] is not self:
                    e._child = self.plan.name
                raise
            finished.add((self.plan.name, name, cut))
        state = rows = None
        if run.ops is not None:
            acc = run.folded if cut is None and run.folded is not None else fold.fold_reading(self.plan, run.ops.where(before))
            state = acc.where("acc.here").select("key", "acc.row.*")
        elif run.flagged is not None:
            rows = run.flagged.where(before)
            state = fold.final_rows(self.plan, rows)
        return ProjectionResult(state, error, rows, custom, children)


@dataclass
class _Run:
    """One projection over a log: its ops where rules read their row, else the flagged ones."""

    plan: ProjectionPlan
    log: DataFrame
    risks: Risks | None
    ops: DataFrame | None = None
    flagged: DataFrame | None = None
    folded: DataFrame | None = None

    def failures(self) -> list[DataFrame]:
        """Ops that failed; no DataFrame where none can. Where some can, the ops are written, as more is read from them than their failures."""
        out, places = [], ["checkpoint", "event_seq", "rule_seq", "transaction_id", "event_type", "op", F.col("key").cast("string").alias("key"), "foreign"]
        keyed = [r for r in self.plan.rules if r.op != CUSTOM]
        risky = self.risks is not None and any(any(own) for own, r in zip(self.risks.rules, self.plan.rules, strict=True) if r.op != CUSTOM)
        if self.ops is not None:
            self.folded = written(fold.fold_reading(self.plan, self.ops), "folded")
            bad = self.folded.where("acc.failed is not null").select(F.col("key").alias("_k"), "acc.failed.*").orderBy(*fold.ORDER).limit(1)
            own = self.ops.select(*fold.ORDER, "transaction_id", "event_type", "key")
            out.append(own.join(F.broadcast(bad), fold.ORDER).where(F.col("key").eqNullSafe(F.col("_k"))).select(*places))
        elif self.flagged is not None and (risky or any(r.policy == THROW for r in keyed)):
            self.flagged = written(self.flagged, "flagged")  # worked out once, for the first error and for the state
            out.append(self.flagged.where("failed").select(*places))
        if self.risks is not None and (self.risks.filters or any(own[0] for own, r in zip(self.risks.rules, self.plan.rules, strict=True) if r.op == CUSTOM)):
            ops = fold.op_rows(self.plan, self.log, self.risks).where(F.col("op").isin(CUSTOM, fold.FILTER) & (F.col("err") != 0))
            out.append(ops.withColumn("foreign", F.lit(True)).select(*places))
        return out

    def cause(self, row: Row) -> Exception | None:
        """What is raised when the failing op alone is worked out again, uncaptured."""
        plan = self.plan
        if row.rule_seq >= 0:
            plan = replace(plan, filters=(), rules=(plan.rules[row.rule_seq % len(plan.rules)],))
        event = self.log.where((F.col("checkpoint") == row.checkpoint) & (F.col("event_seq") == row.event_seq))
        try:
            fold.op_rows(plan, event).collect()
        except Exception as error:
            return error
        return None
