"""Event maps: declarative rules from events to changes of keyed rows.

Verbs name what a handler does; keys, predicates and assignments are columns, or functions of (event, context) that give
columns. ``build`` checks and freezes the rules; later changes of the builder are refused.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldspark.plans.types import TypeRegistry

CREATE, UPDATE, DELETE, CUSTOM = "create", "update", "delete", "custom"
#: What a rule does about a duplicate (create) or a miss (update, delete).
THROW, IGNORE, ACCEPT, CONDITION = "throw", "ignore", "accept", "condition"


class Event:
    """Fields of the event's body as columns: ``e.value`` or ``e["value"]``."""

    def __init__(self, body: Column | None = None) -> None:
        self._body = body

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return (F.col("body") if self._body is None else self._body).getField(name)

    __getitem__ = __getattr__


class Existing:
    """Fields of the row that a handler finds, for rules of three parameters: ``lambda old, e, c: e.value > old.best``."""

    def __init__(self, row: Column) -> None:
        self._row = row

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._row[name]

    __getitem__ = __getattr__


@dataclass(frozen=True)
class ChildRef:
    """A row of a child projection that a rule reads: where ``key`` is found there when the event comes. ``column`` holds it in the log."""

    column: str
    projection: str
    key: Column
    event_types: frozenset[str] | None


class Child:
    """Fields of a child projection's row as of the event; NULL where there is no such row."""

    def __init__(self, column: str) -> None:
        self._column = column

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(self._column).getField(name)

    def is_there(self) -> Column:
        return F.coalesce(F.col(self._column).getField("_exists"), F.lit(False))


class Context:
    """The envelope's columns, headers by name, and rows of child projections."""

    def __init__(self, op: Column | None = None, child: Callable[[str, Column], Child] | None = None) -> None:
        self._op, self._child = op, child

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(name) if self._op is None else self._op[name]

    def header(self, name: str) -> Column:
        return self.event_headers[name]

    def transaction_header(self, name: str) -> Column:
        return self.transaction_headers[name]

    def child(self, projection: str, key: Column) -> Child:
        """The row of ``key`` in the child ``projection``, as it is when the event comes: children see each event first."""
        if self._child is None:
            raise TypeError("a rule that reads its own row reads no child's")
        return self._child(projection, key)


#: A column, or what gives one for (event, context).
Expr = Column | Callable[[Event, Context], Column]
#: What also reads the row that is there: (existing, event, context).
Reading = Callable[[Existing, Event, Context], Column]


def reads_row(x: Expr | Reading) -> bool:
    """Whether ``x`` takes the existing row: a function of three parameters without defaults."""
    return not isinstance(x, Column) and sum(p.default is p.empty for p in inspect.signature(x).parameters.values()) == 3


@dataclass(frozen=True)
class Rule:
    event_type: str
    op: str
    key: Column | None = None
    predicates: tuple[Column, ...] = ()
    policy: str = THROW
    condition: Column | None = None
    assigns: dict[str, Column] = field(default_factory=dict)
    adds: dict[str, Column] = field(default_factory=dict)
    action: str | None = None
    #: Conditions and assignments that read the row: functions of (existing, event, context).
    reading: Reading | None = None
    reading_assigns: dict[str, Reading] = field(default_factory=dict)

    @property
    def reads_row(self) -> bool:
        return self.reading is not None or bool(self.reading_assigns)


class _Handler:
    """What follows an ``as_...`` verb. The last policy wins, before or after ``using``."""

    def __init__(self, builder: EventMapBuilder, action: Action, rule: Rule) -> None:
        self._builder, self._action, self._rule, self._entries = builder, action, rule, []

    def _set(self, policy: str, condition: Expr | Reading | None = None):
        self._builder._check_open()
        own = condition is not None and reads_row(condition)
        new = {"policy": policy, "condition": None if condition is None or own else self._resolve(condition), "reading": condition if own else None}
        self._rule = replace(self._rule, **new)
        for i in self._entries:
            old, _ = self._builder._rules[i]
            self._builder._rules[i] = (replace(old, **new), self._action)
        return self

    def _resolve(self, x: Expr) -> Column:
        return self._builder._resolve(x, self._rule.event_type)

    def _assigns(self, given: dict[str, Expr | Reading]) -> dict[str, dict]:
        return {
            "assigns": {n: self._resolve(x) for n, x in given.items() if not reads_row(x)},
            "reading_assigns": {n: x for n, x in given.items() if reads_row(x)},
        }

    def _register(self, **more):
        self._builder._check_open()
        self._entries.append(len(self._builder._rules))
        self._builder._rules.append((replace(self._rule, **more), self._action))
        return self


class _Using(_Handler):
    def using(self, **assigns: Expr | Reading):
        """Assign fields; a function of (existing, event, context) reads the row it changes. Called twice it registers a second handler."""
        return self._register(**self._assigns(assigns))

    def adding(self, _assigns: dict[str, Expr | Reading] | None = None, **adds: Expr):
        """Accumulate into fields by the function each was declared with (sum, count, min, max); ``_assigns`` are set, and restart a field."""
        return self._register(**self._assigns(_assigns or {}), adds={n: self._resolve(x) for n, x in adds.items()})


class Create(_Using):
    def ignoring_duplicates(self):
        return self._set(IGNORE)

    def overwriting_duplicates(self):
        """A duplicate is applied to the row that is there; fields it does not assign stay."""
        return self._set(ACCEPT)

    def handling_duplicates_using(self, should_overwrite: Expr | Reading):
        """Overwrite where the condition on (event, context) or on (existing, event, context) holds."""
        return self._set(CONDITION, should_overwrite)


class Update(_Using):
    def throwing_if_missing(self):
        return self._set(THROW)

    def ignoring_misses(self):
        return self._set(IGNORE)

    def creating_if_missing(self):
        return self._set(ACCEPT)

    def handling_misses_using(self, should_create: Expr):
        return self._set(CONDITION, should_create)


class Delete(_Handler):
    def throwing_if_missing(self):
        return self._set(THROW)

    def ignoring_misses(self):
        return self._set(IGNORE)

    def handling_misses_using(self):
        """Misses are tolerated and reported: ``ProjectionResult.misses`` has their keys."""
        return self._set(CONDITION, F.lit(True))


class Action:
    """What follows ``map``. Predicates hold for all handlers of this action, also for those added before."""

    def __init__(self, builder: EventMapBuilder, event_type: str) -> None:
        self._builder, self._type, self._predicates = builder, event_type, []

    def when(self, predicate: Expr) -> Action:
        self._builder._check_open()
        self._predicates.append(self._builder._resolve(predicate, self._type))
        return self

    def _keyed(self, kind: type, op: str, key: Expr):
        self._builder._check_open()
        if self._builder.fields is None:
            raise TypeError("a map without fields has custom actions only")
        return kind(self._builder, self, Rule(self._type, op, self._builder._resolve(key, self._type)))

    def as_create_of(self, key: Expr) -> Create:
        return self._keyed(Create, CREATE, key)

    def as_update_of(self, key: Expr) -> Update:
        return self._keyed(Update, UPDATE, key)

    def as_delete_of(self, key: Expr) -> Delete:
        return self._keyed(Delete, DELETE, key)._register()

    def as_action(self, name: str) -> None:
        """A custom action: its events are in ``ProjectionResult.custom`` under this name, and go to the action given to the projector."""
        _Handler(self._builder, self, Rule(self._type, CUSTOM, action=name))._register()

    # older names for common pairs
    def as_create_if_does_not_exist_of(self, key: Expr) -> Create:
        return self.as_create_of(key).ignoring_duplicates()

    def as_create_or_update_of(self, key: Expr) -> Create:
        return self.as_create_of(key).overwriting_duplicates()

    def as_update_if_exists_of(self, key: Expr) -> Update:
        return self.as_update_of(key).ignoring_misses()

    def as_delete_if_exists_of(self, key: Expr) -> Delete:
        return self.as_delete_of(key).ignoring_misses()


@dataclass(frozen=True)
class ProjectionPlan:
    """A built map. ``fields``: name to (type, accumulator or None); None for a map of custom actions only."""

    name: str
    key_type: str
    fields: dict[str, tuple[str, str | None]] | None
    filters: tuple[Column, ...]
    rules: tuple[Rule, ...]
    registry: TypeRegistry
    children_read: tuple[ChildRef, ...] = ()

    @property
    def reads_row(self) -> bool:
        """Whether a rule reads the row that it changes, so that a key's ops are folded one after another."""
        return any(r.reads_row for r in self.rules)

    def reads_child(self, ref: ChildRef) -> Column:
        """Whether an event is one whose rules read ``ref``."""
        if ref.event_types is None or self.registry.root in ref.event_types:
            return F.lit(True)
        types = [*ref.event_types, *(t for m in ref.event_types for t in self._reach(m))]
        return F.coalesce(F.col("event_type").isin(types), F.lit(False))

    @property
    def mapped(self) -> list[str]:
        return list(dict.fromkeys(r.event_type for r in self.rules))

    def _reach(self, event_type: str) -> list[str]:
        """Types whose events run the handlers of ``event_type`` as their base."""
        known = [*self.registry.types(), *self.mapped]
        return [t for t in dict.fromkeys(known) if self.registry.base_of(t, self.mapped) == event_type]

    def accepted(self) -> Column:
        """All global filters hold. A filter that gives NULL does not hold."""
        ok = F.lit(True)
        for f in self.filters:
            ok = ok & F.coalesce(f, F.lit(False))
        return ok

    def handled(self) -> Column:
        """Whether the filters hold and the type has a handler, whatever the handlers' own predicates say."""
        types = [*self.mapped, *(t for m in self.mapped for t in self._reach(m))]
        catch_all = F.col("event_type").isNotNull() if self.registry.root in self.mapped else F.lit(False)
        return self.accepted() & (F.coalesce(F.col("event_type").isin(types), F.lit(False)) | catch_all)

    def matches(self, n: int) -> list[tuple[int, Column]]:
        """(order, condition) of rule ``n``: as the handler of an event's base type, then as that of its own type. ``matched`` has their types."""
        rule = self.rules[n]
        holds = F.lit(True)
        for p in rule.predicates:
            holds = holds & F.coalesce(p, F.lit(False))
        kind, out = F.col("event_type"), []
        below = self._reach(rule.event_type)
        if rule.event_type == self.registry.root:  # also above types that nobody has named
            known = dict.fromkeys([*self.registry.types(), *self.mapped])
            others = [t for t in known if self.registry.base_of(t, self.mapped) != rule.event_type]
            out.append((n, kind.isNotNull() & ~kind.isin([rule.event_type, *others]) & holds))
        elif below:
            out.append((n, kind.isin(below) & holds))
        return [*out, (len(self.rules) + n, (kind == rule.event_type) & holds)]

    def matched(self, n: int) -> list[frozenset[str] | None]:
        """The types of events that may meet each of ``matches``; None: any."""
        rule = self.rules[n]
        below = self._reach(rule.event_type)
        base = [None] if rule.event_type == self.registry.root else [frozenset(below)] if below else []
        return [*base, frozenset([rule.event_type])]


class EventMapBuilder:
    """``fields``: name to a type, or to (type, "sum" | "count" | "min" | "max") for accumulators; leave out for custom actions only."""

    def __init__(self, name: str = "projection", key_type: str = "string", fields: dict[str, str | tuple[str, str]] | None = None, registry: TypeRegistry | None = None) -> None:
        self.name, self.key_type, self.registry = name, key_type, registry or TypeRegistry()
        self.fields = None if fields is None else {n: (f, None) if isinstance(f, str) else f for n, f in fields.items()}
        self._filters: list[Column] = []
        self._rules: list[tuple[Rule, Action]] = []
        self._children: dict[tuple[str, str], tuple[Column, set | None]] = {}
        self._columns: dict[Callable, Column] = {}
        self._built = False

    def _resolve(self, x: Expr, event_type: str | None) -> Column:
        """The column of ``x``, one for all rules that share a function; the child rows that it reads are noted."""
        if isinstance(x, Column):
            return x

        def child(projection: str, key: Column) -> Child:
            _, types = self._children.setdefault((projection, str(key)), (key, set()))
            types.add(event_type)
            return Child(f"_child_{list(self._children).index((projection, str(key)))}")

        found = x(Event(), Context(child=child))
        return self._columns.setdefault(x, found)

    def _check_open(self) -> None:
        if self._built:
            raise RuntimeError("the map has been built")

    def where(self, predicate: Expr) -> EventMapBuilder:
        self._check_open()
        self._filters.append(self._resolve(predicate, None))
        return self

    def map(self, event_type: str) -> Action:
        self._check_open()
        if not event_type:
            raise ValueError("an event type is needed")
        return Action(self, event_type)

    def build(self) -> ProjectionPlan:
        self._check_open()
        for rule, _ in self._rules:
            unknown = [n for n in (*rule.assigns, *rule.reading_assigns, *rule.adds) if n not in (self.fields or {})]
            if unknown:
                raise ValueError(f"no such fields: {', '.join(unknown)}")
            plain = [n for n in rule.adds if self.fields[n][1] is None]
            if plain:
                raise ValueError(f"no accumulator is declared for: {', '.join(plain)}")
        self._built = True
        refs = tuple(ChildRef(f"_child_{n}", projection, key, None if None in types else frozenset(types)) for n, ((projection, _), (key, types)) in enumerate(self._children.items()))
        rules = tuple(replace(r, predicates=tuple(a._predicates)) for r, a in self._rules)
        plan = ProjectionPlan(self.name, self.key_type, self.fields, tuple(self._filters), rules, self.registry, refs)
        if plan.reads_row and any(r.op == DELETE and r.policy == CONDITION for r in rules):
            raise ValueError("a map whose rules read their row cannot report misses")
        return plan
