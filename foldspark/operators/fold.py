"""The keyed fold: from op rows to rows, history, misses and errors, in windows and aggregates.

Op rows come from a plan's rules, one for each rule that an event meets, ordered by (checkpoint, event_seq, rule_seq).
Whether a key's row is there before an op depends only on the last op that fixes its presence; that, the effect of each
op, and the incarnation of the row (a create after a delete begins a new one) are windows over one partitioning and
order, so the plan has one shuffle and one sort for all of them. The final aggregation by key and incarnation reuses
the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.operators.capture import Risks, failed
from foldspark.operators.lookup import carried
from foldspark.plans.event_map import ACCEPT, CONDITION, CREATE, CUSTOM, DELETE, IGNORE, THROW, UPDATE, Context, Event, Existing, ProjectionPlan
from foldspark.sources.log import ENVELOPE
from foldspark.sources.tables import sized, written

ORDER = ["checkpoint", "event_seq", "rule_seq"]
#: Columns of the log that op rows have besides the body; where rules read their row, they have the whole envelope.
OP_ENVELOPE = ["checkpoint", "event_seq", "transaction_id", "event_type"]


#: What of an op failed when it was worked out (bits of ``err``).
ERR_RULE, ERR_CONDITION, ERR_SETS = 1, 2, 4
#: An op that stands for an event of which a filter of the map failed.
FILTER = "filter"


def op_rows(plan: ProjectionPlan, log: DataFrame, risks: Risks | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(checkpoint, event_seq, rule_seq, transaction_id, event_type, op, key, action, policy, accepts, err, set_<field>, add_<field>, body).

    ``accepts`` says whether a duplicate is applied, or a miss created. ``set_<field>`` is a struct, so that NULL can be
    assigned. With ``risks``, what can fail is captured: ``err`` has the parts of an op that failed, whose columns are
    NULL, and an event on which a filter failed is an op of its own kind; without, a failure ends the job. ``more``:
    columns of the event that its ops have too.
    """
    fields = plan.fields or {}
    accepted = plan.handled()
    torn = failed(accepted) if risks and risks.filters else None
    # an event meets its rules by their numbers: rules of which it can meet but one share a slot, and columns are worked out once the number is known
    met: list[tuple[frozenset[str] | None, Column]] = []
    ops: list[dict[str, object]] = []
    shared: dict[tuple, Column] = {}  # what rules have in common stays one column
    if torn is not None:
        met.append((None, torn))
        ops.append(_filter_op())
    for n, rule in enumerate(plan.rules):
        broken, bad_key, bad_condition, bad_sets = risks.rules[n] if risks else (False,) * 4
        key = F.lit(None).cast(plan.key_type) if rule.key is None else shared.setdefault((id(rule.key), "key"), rule.key.cast(plan.key_type))
        accepts, sets = {ACCEPT: True, CONDITION: False if rule.condition is None else rule.condition}.get(rule.policy, False), []
        for name, (kind, _) in fields.items():
            x = rule.assigns.get(name)
            sets.append((None if x is None else shared.setdefault((id(x), name), F.struct(x.cast(kind).alias("v"))), f"set_{name}"))
        for name, (kind, how) in fields.items():
            if how:
                sets.append((rule.adds[name].cast(kind) if name in rule.adds else None, f"add_{name}"))
        for (order, condition), types in zip(plan.matches(n), plan.matched(n), strict=True):
            no_rule = failed(condition) if broken else F.lit(False)
            no_key = no_rule | failed(key) if bad_key else no_rule
            no_accepts = failed(accepts) if bad_condition else F.lit(False)
            no_sets = failed(F.struct(*(x for x, _ in sets if x is not None))) if bad_sets else F.lit(False)
            err = F.when(no_key, ERR_RULE).otherwise(F.when(no_accepts, ERR_CONDITION).otherwise(0) + F.when(no_sets, ERR_SETS).otherwise(0)) if broken or bad_key or bad_condition or bad_sets else 0

            def safe(x: object, risk: bool, wrong: Column) -> object:
                return F.when(~wrong, x) if risk else x

            accepted_too = safe(accepts, broken or bad_key or bad_condition, no_key | no_accepts)
            columns = {
                "rule_seq": order, "op": rule.op, "key": safe(key, broken or bad_key, no_key), "action": rule.action, "policy": rule.policy,
                "accepts": F.coalesce(accepted_too, F.lit(False)) if isinstance(accepted_too, Column) else accepted_too, "err": err,
            }
            for x, name in sets:
                columns[name] = None if x is None else safe(x, broken or bad_key or bad_sets, no_key | no_sets)
            meets = no_rule | condition if broken else condition
            met.append((None if broken else types, meets if torn is None else ~torn & meets))
            ops.append(columns)
    if not plan.rules:
        raise ValueError("the map has no handlers")
    kept = [c for c in ENVELOPE if c in log.columns and c != "body"] if plan.reads_row else OP_ENVELOPE
    types = {"rule_seq": "int", "op": "string", "key": plan.key_type, "action": "string", "policy": "string", "accepts": "boolean", "err": "int"}
    types |= {f"set_{n}": f"struct<v:{kind}>" for n, (kind, _) in fields.items()} | {f"add_{n}": kind for n, (kind, how) in fields.items() if how}
    slots = _slots(met)
    rows = log.where(accepted if torn is None else torn | accepted)
    # explode keeps filters on the numbers above it, and works out nothing ahead of what captures its failure
    rows = rows.withColumn("_op", F.explode(F.array(*slots))).where("_op is not null")
    return rows.select(*kept, "body", *(x.alias(n) for n, x in (more or {}).items()), *(_of_op([o.get(name) for o in ops], kind).alias(name) for name, kind in types.items()))


def _slots(met: list[tuple[frozenset[str] | None, Column]]) -> list[Column]:
    """The numbers of the ops that an event makes, from (types of events, condition) of each: NULL where a slot has none. Ops of one slot have no type in common."""
    slots: list[tuple[set[str], Column]] = []
    for n, (types, condition) in enumerate(met):
        at = next((i for i, (taken, _) in enumerate(slots) if types is not None and taken is not None and not taken & types), None)
        if at is None:
            slots.append((None if types is None else set(types), F.when(condition, n)))
        else:
            slots[at] = (slots[at][0] | types, slots[at][1].when(condition, n))
    return [x for _, x in slots]


def _of_op(values: list[object], kind: str) -> Column:
    """The value (a column or a constant) that belongs to the number in _op."""
    if all(not isinstance(x, Column) and x == values[0] and type(x) is type(values[0]) for x in values):
        return F.lit(values[0]).cast(kind)
    cases: list[tuple[list[int], object]] = []
    for n, x in enumerate(values):
        same = next((own for own, y in cases if y is x or not isinstance(x, Column) and not isinstance(y, Column) and y == x), None)
        if same is not None:
            same.append(n)
        elif x is not None:
            cases.append(([n], x))
    out = None
    for own, x in cases:
        is_one, value = F.col("_op").isin(own) if len(own) > 1 else F.col("_op") == own[0], (x if isinstance(x, Column) else F.lit(x)).cast(kind)
        out = F.when(is_one, value) if out is None else out.when(is_one, value)
    return out


def keys_of(plan: ProjectionPlan, log: DataFrame) -> DataFrame | None:
    """The distinct keys that events of ``log`` may change, whatever filters and predicates say; None if keys come from a child's row. A key that fails is left out."""
    if any("_child_" in str(r.key) for r in plan.rules):
        return None
    bare, parts = replace(plan, filters=(), rules=tuple(replace(r, predicates=()) for r in plan.rules)), []
    for n, rule in enumerate(plan.rules):
        if rule.op != CUSTOM:
            key = rule.key.cast(plan.key_type)
            parts += [F.when(condition & ~failed(key), F.struct(key.alias("key"))) for _, condition in bare.matches(n)]
    found = F.array_compact(F.array(*parts)) if parts else F.array().cast(f"array<struct<key:{plan.key_type}>>")
    return log.select(F.explode(found).alias("k")).select("k.key").distinct()


def _filter_op() -> dict[str, object]:
    return {"rule_seq": -1, "op": FILTER, "policy": IGNORE, "accepts": False, "err": ERR_RULE}


def snapshot_rows(plan: ProjectionPlan, snapshot: DataFrame) -> DataFrame:
    """A state (key and fields) as create ops before every event."""
    columns = [F.col(n).cast(k).alias(n) for n, (k, _) in plan.fields.items()]
    own = snapshot.select(F.col("key").cast(plan.key_type).alias("key"), *columns)
    sets = [F.struct(F.col(n).alias("v")).alias(f"set_{n}") for n in plan.fields]
    adds = [F.lit(None).cast(k).alias(f"add_{n}") for n, (k, how) in plan.fields.items() if how]
    return own.select(
        F.lit(-1).cast("long").alias("checkpoint"), F.lit(0).alias("event_seq"), F.lit(-1).alias("rule_seq"), F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("event_type"),
        F.lit(CREATE).alias("op"), "key", F.lit(None).cast("string").alias("action"), F.lit(ACCEPT).alias("policy"), F.lit(True).alias("accepts"), F.lit(0).alias("err"), *sets, *adds,
    )


def flag(ops: DataFrame, split_every: int | None = None) -> DataFrame:
    """Op rows with present (before the op), effective, failed, foreign (failed for another reason than its policy), missed and incarnation.

    ``split_every``: checkpoints of a range that is worked on by itself, so that the windows of a key with very many ops
    are spread over tasks. What a range takes over from those before it, presence and births, are sums by key and range
    that combine before they shuffle.
    """
    by = ["key"] if split_every is None else ["key", "_range"]
    rows = ops if split_every is None else ops.withColumn("_range", F.floor(F.col("checkpoint") / split_every))
    fixes = F.when(F.col("op") == CREATE, True).when((F.col("op") == UPDATE) & F.col("accepts"), True).when(F.col("op") == DELETE, False)
    rows = rows.withColumn("fixes", fixes)
    start = F.lit(False)
    if split_every is not None:
        last = F.max_by("fixes", F.when(F.col("fixes").isNotNull(), _place()))
        rows, start = _carry(rows, last, lambda before, w: F.coalesce(F.last(before, ignorenulls=True).over(w), F.lit(False))), F.col("_before")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    here, create = F.col("present"), F.col("op") == CREATE
    flagged = rows.withColumn("present", F.coalesce(F.last("fixes", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), start)).drop("_before")
    applies = F.when(create, ~here | F.col("accepts")).when(F.col("op") == UPDATE, here | F.col("accepts")).otherwise(False)
    fails = (F.col("policy") == THROW) & F.when(create, here).otherwise(~here)
    misses = (F.col("op") != CREATE) & ~here
    asked = (F.col("policy") == CONDITION) & F.when(create, here).otherwise(~here)  # only then the condition counts, and assignments only where they apply
    foreign = (F.col("err").bitwiseAND(ERR_RULE) != 0) | ((F.col("err").bitwiseAND(ERR_CONDITION) != 0) & asked) | ((F.col("err").bitwiseAND(ERR_SETS) != 0) & applies)
    flagged = flagged.withColumns({"effective": applies, "failed": fails | foreign, "foreign": foreign, "missed": misses})
    birth = (F.col("effective") & ~here).cast("int")
    births = F.sum(birth).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if split_every is not None:
        flagged = _carry(flagged, F.sum(birth), lambda before, w: F.coalesce(F.sum(before).over(w), F.lit(0)))
        births = births + F.col("_before")
    return flagged.withColumn("incarnation", births.cast("long")).drop("_before")


def _carry(rows: DataFrame, figure: Column, over: Callable) -> DataFrame:
    """``rows`` with _before: ``figure`` of each (key, range), carried over the key's earlier ranges."""
    w = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "_range").agg(figure.alias("_figure"))
    parts = parts.select(F.col("key").alias("_k"), F.col("_range").alias("_r"), over(F.col("_figure"), w).alias("_before"))
    return rows.join(parts, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))).drop("_k", "_r")


def _place() -> Column:
    return F.struct(*ORDER)


def final_rows(plan: ProjectionPlan, flagged: DataFrame, **more: Column) -> DataFrame:
    """(key, fields) of the rows that live at the end. ``more``: aggregates over all ops of a key, in maps of plain fields; ``last_incarnation`` is there beside them."""
    whole = Window.partitionBy("key", "incarnation")
    rows = flagged.where("incarnation > 0")
    lives = F.max_by("fixes", F.when(F.col("fixes").isNotNull(), _place()))
    if all(how is None for _, how in plan.fields.values()):
        # only a key's last incarnation can live, so keys are the groups: one sort serves the flags and this
        sets = {n: F.col("effective") & F.col(f"set_{n}").isNotNull() for n in plan.fields}
        last = {n: F.max_by(F.struct("incarnation", F.col(f"set_{n}")["v"].alias("v")), F.when(x, _place())).alias(f"_l_{n}") for n, x in sets.items()}
        found = rows.groupBy("key").agg(*last.values(), lives.alias("_lives"), F.max("incarnation").alias("last_incarnation"), *(x.alias(n) for n, x in more.items())).where("_lives")
        fields = [F.when(F.col(f"_l_{n}.incarnation") == F.col("last_incarnation"), F.col(f"_l_{n}.v")).alias(n) for n in plan.fields]
        return found.select("key", *fields, *(["last_incarnation", *more] if more else []))
    if more:
        raise ValueError("a map with accumulators has no more aggregates")
    out = []
    for name, (kind, how) in plan.fields.items():
        sets = F.col("effective") & F.col(f"set_{name}").isNotNull()
        last = F.max_by(F.col(f"set_{name}"), F.when(sets, _place()))["v"]
        if how is None:
            out.append(last.alias(name))
            continue
        # an assignment restarts the accumulator: only what is at or after the last one counts
        if "_range" in rows.columns:
            restarts = rows.groupBy(F.col("key").alias("_k"), F.col("incarnation").alias("_i")).agg(F.max(F.when(sets, _place())).alias(f"_l_{name}"))
            rows = rows.join(restarts, F.col("key").eqNullSafe(F.col("_k")) & (F.col("incarnation") == F.col("_i"))).drop("_k", "_i")
        else:
            rows = rows.withColumn(f"_l_{name}", F.max(F.when(sets, _place())).over(whole))
        counts = F.when(F.col("effective") & (F.col(f"_l_{name}").isNull() | (_place() >= F.col(f"_l_{name}"))), F.col(f"add_{name}"))
        if how == "count":
            out.append((F.coalesce(last, F.lit(0).cast(kind)) + F.count(counts)).cast(kind).alias(name))
        elif how == "sum":
            out.append((F.coalesce(last, F.lit(0).cast(kind)) + F.coalesce(F.sum(counts), F.lit(0))).cast(kind).alias(name))
        elif how == "min":
            out.append(F.least(last, F.min(counts)).alias(name))
        elif how == "max":
            out.append(F.greatest(last, F.max(counts)).alias(name))
        else:
            raise ValueError(f"no such accumulator: {how}")
    return rows.groupBy("key", "incarnation").agg(*out, lives.alias("_lives")).where("_lives").drop("incarnation", "_lives")


def history_rows(plan: ProjectionPlan, flagged: DataFrame) -> DataFrame:
    """(key, place, op, exists, fields) after each op that took effect: the state as of every checkpoint. Plain fields only.

    Ops that were flagged in ranges keep them: what a range takes over, the last assignments before it, is carried.
    """
    split = "_range" in flagged.columns
    w = Window.partitionBy("key", "incarnation", *(["_range"] if split else [])).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    removes = (F.col("op") == DELETE) & F.col("present")
    plain = [n for n, (_, how) in plan.fields.items() if how is None]
    rows = flagged.withColumn("removes", removes)
    own = {n: F.when(F.col("effective"), F.col(f"set_{n}")) for n in plain}
    if split and plain:
        rows = carried(rows, ["key", "incarnation"], {f"_before_{n}": F.max_by(F.col(f"set_{n}"), F.when(own[n].isNotNull(), _place())) for n in plain})
    fields = []
    for n in plain:
        last = F.last(own[n], ignorenulls=True).over(w)
        value = F.coalesce(last, F.col(f"_before_{n}")) if split else last
        fields.append(F.when(~F.col("removes"), value["v"]).alias(n))
    return rows.select("key", *ORDER, "op", (~F.col("removes")).alias("exists"), (F.col("effective") | F.col("removes")).alias("_took"), *fields).where("_took").drop("_took")


#: Ops of a key that are folded in one row; more are folded range by range, each going on from the state that the last one left.
CHAIN = 50_000


def fold_reading(plan: ProjectionPlan, ops: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(key, acc) of a map whose rules read the row they change, in Spark's own expressions.

    ``acc`` is a struct of here (whether the row is there), the fields, and failed: the place and reason of the first op
    that failed, after which nothing of the key is applied. A key's ops are sorted in an array and folded by
    ``aggregate``. Arrays hold at most ``chain`` ops: the n-th ranges of all keys that have as many are folded together,
    on top of the states that their last ranges left, so a round costs what these keys hold and no array grows with the log.
    """
    n = F.floor((F.row_number().over(Window.partitionBy("key").orderBy(*ORDER)) - 1) / chain).cast("int")
    maps = [f.name for f in ops.schema if f.dataType.typeName() == "map"]  # maps have no order, their entries do
    rows = ops.withColumns({m: F.map_entries(m) for m in maps}).withColumn("_range", n)
    op = F.struct(*ORDER, *(c for c in ops.columns if c not in ("key", *ORDER)))
    table = written(rows.groupBy("key", "_range").agg(F.sort_array(F.collect_list(op)).alias("ops")), "ranges", "_range")
    last, step = table.agg(F.max("_range")).first()[0] or 0, _step(plan, maps)
    state, done = table.where("_range = 0").select("key", F.aggregate("ops", _nothing(plan), step).alias("acc")), None
    for r in range(1, last + 1):
        state = written(state, "states")
        more = table.where(F.col("_range") == r).select(F.col("key").alias("_k"), "ops")
        same = F.col("key").eqNullSafe(F.col("_k"))
        settled = state.join(sized(more.select("_k")), same, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        state = more.join(state, same).select("key", F.aggregate("ops", F.col("acc"), step).alias("acc"))
    return state if done is None else done.unionByName(state)


_FAILED = "struct<checkpoint:bigint,event_seq:int,rule_seq:int,op:string,foreign:boolean>"


def _nothing(plan: ProjectionPlan) -> Column:
    """No row."""
    fields = [_empty(kind, how).alias(n) for n, (kind, how) in plan.fields.items()]
    return F.struct(F.lit(False).alias("here"), F.struct(*fields).alias("row"), F.lit(None).cast(_FAILED).alias("failed"))


def _empty(kind: str, how: str | None) -> Column:
    return (F.lit(0) if how in ("sum", "count") else F.lit(None)).cast(kind)


def _step(plan: ProjectionPlan, maps: list[str]) -> Callable[[Column, Column], Column]:
    """The policies' truth table as (state, op) -> state."""
    rules = list(enumerate(plan.rules))

    def step(acc: Column, op: Column) -> Column:
        here, row, kind = acc["here"], acc["row"], op["op"]
        op_event, old = Event(op["body"]), Existing(row)
        context = Context(_Opened(op, maps))
        number = F.when(op["rule_seq"] >= 0, F.pmod(op["rule_seq"], F.lit(len(rules))))  # rows of a snapshot come from no rule

        def of_rules(found: dict[int, Column], otherwise: Column) -> Column:
            out = None
            for n, x in found.items():
                out = F.when(number == n, x) if out is None else out.when(number == n, x)
            return otherwise if out is None else out.otherwise(otherwise)

        create, update = kind == CREATE, kind == UPDATE
        asked = (op["policy"] == CONDITION) & F.when(create, here).otherwise(~here)
        conditions = {n: r.reading(old, op_event, context) for n, r in rules if r.reading is not None}
        no_condition = asked & of_rules({n: failed(c) for n, c in conditions.items()}, op["err"].bitwiseAND(ERR_CONDITION) != 0)
        accepts = F.coalesce(of_rules({n: F.when(asked, c) for n, c in conditions.items()}, op["accepts"]), F.lit(False))
        applies = F.when(create, ~here | accepts).when(update, here | accepts).otherwise(False)
        assigns = {name: {n: r.reading_assigns[name](old, op_event, context).cast(t) for n, r in rules if name in r.reading_assigns} for name, (t, _) in plan.fields.items()}
        every: dict[int, list[Column]] = {}
        for found in assigns.values():
            for n, x in found.items():
                every.setdefault(n, []).append(x)
        no_sets = applies & (of_rules({n: failed(F.struct(*x)) for n, x in every.items()}, F.lit(False)) | (op["err"].bitwiseAND(ERR_SETS) != 0))
        foreign = (op["err"].bitwiseAND(ERR_RULE) != 0) | no_condition | no_sets
        fails = (op["policy"] == THROW) & F.when(create, here).otherwise(~here)
        gone, fields = kind == DELETE, []
        for name, (t, how) in plan.fields.items():
            before = F.when(here, row[name]).otherwise(_empty(t, how))
            found = assigns[name]
            value = of_rules(found, F.when(op[f"set_{name}"].isNotNull(), op[f"set_{name}"]["v"]).otherwise(before))
            if how:
                value, more = value, op[f"add_{name}"]
                value = {
                    "count": lambda v, m: F.coalesce(v, F.lit(0)) + F.when(m.isNotNull(), 1).otherwise(0), "sum": lambda v, m: F.when(m.isNull(), v).otherwise(F.coalesce(v, F.lit(0)) + m),
                    "min": F.least, "max": F.greatest,
                }[how](value, more)
            fields.append(F.when(gone, _empty(t, how)).when(applies, value).otherwise(row[name]).cast(t).alias(name))
        after = F.struct(F.when(gone, False).otherwise(here | applies).alias("here"), F.struct(*fields).alias("row"), F.lit(None).cast(_FAILED).alias("failed"))
        wrong = F.struct(op["checkpoint"].alias("checkpoint"), op["event_seq"].alias("event_seq"), op["rule_seq"].alias("rule_seq"), kind.alias("op"), foreign.alias("foreign")).cast(_FAILED)
        stopped = F.struct(here.alias("here"), row.alias("row"), wrong.alias("failed"))
        return F.when(acc["failed"].isNotNull(), acc).when(foreign | fails, stopped).otherwise(after)

    return step


class _Opened:
    """An op's columns, its maps made from their entries again."""

    def __init__(self, op: Column, maps: list[str]) -> None:
        self._op, self._maps = op, maps

    def __getitem__(self, name: str) -> Column:
        return F.map_from_entries(self._op[name]) if name in self._maps else self._op[name]


def same_key(a: object, b: object) -> bool:
    """Equality as Spark groups: nulls are equal, and so are NaNs."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and a != a and b != b)


def fold_rows(ops: DataFrame, step: Callable[[dict | None, dict], dict | None], schema: str, key: str = "key") -> DataFrame:
    """The general fold, for handlers that read the row they change: ``step(row or None, op) -> row or None`` in order.

    Each key's ops go through Python in one task, an Arrow batch at a time; only the row is held. Values are as Spark
    has them: nulls are None, 64-bit integers are exact. Ops with a null key are those of one key. Use it where no rule
    can say the same; ``fold_reading`` folds rules that read their row without Python.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names, out = list(ops.columns), to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches):
        began, current, state, done = False, None, None, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                op = dict(zip(names, values, strict=True))
                if not began or not same_key(op[key], current):
                    if began and state is not None:
                        done.append({key: current, **state})
                    began, current, state = True, op[key], None
                state = step(state, op)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if began and state is not None:
            yield pa.RecordBatch.from_pylist([{key: current, **state}], schema=out)

    return ops.repartition(key).sortWithinPartitions(key, *ORDER).mapInArrow(rows, schema)


__all__ = ["ACCEPT", "CUSTOM", "FILTER", "IGNORE", "ORDER", "final_rows", "flag", "fold_reading", "fold_rows", "history_rows", "op_rows", "same_key", "snapshot_rows"]
