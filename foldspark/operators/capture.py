"""Errors of columns as data: whether a column's evaluation fails, row by row, without ending the job.

Casts, arithmetic, parsing and ``raise_error`` are captured. A Python function is run outside its expression by Spark,
so its errors end the job as they do anywhere; so do those of columns that hold maps, which have no digest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.plans.event_map import ProjectionPlan

#: A column, fields of it, or a literal: nothing that could fail.
_PLAIN = re.compile(r"Column<'(?:\w+(?:\['[\w.]+'\])*|-?\d+L?|NULL|true|false|'[^']*')'>")
#: What an analysed expression may consist of and still cannot fail: columns, fields, literals, comparisons and logic.
_TOKEN = re.compile(r"[\w.$]+#\d+L?|#\d+L?|\.\w+|\[[\w]+\]|-?\d+(?:\.\d+)?(?:E-?\d+)?[LDS]?\b|<=>|[<>=]=?|[(),]|\b(?:AND|OR|NOT|IN|CASE|WHEN|THEN|ELSE|END|AS|isnull|isnotnull|coalesce|true|false|null|concat|lower|upper)\b|\w+(?=,|\)|\s)|\s+")
_LITERAL = re.compile(r"cast\((-?\d+(?:\.\d+)?) as (?:double|float|bigint|int)\)")
_CALL = re.compile(r"\b(\w+)\(")
_SAFE_CALLS = {"AND", "OR", "NOT", "IN", "isnull", "isnotnull", "coalesce", "WHEN", "THEN", "ELSE", "concat", "lower", "upper"}


def failed(column: Column) -> Column:
    """Whether evaluating ``column`` fails: a parse that gives NULL for any error under it is handed a text that is never NULL.

    The text is a digest, since the optimizer would leave out the evaluation if only its nullness was asked for.
    """
    return F.try_to_binary(F.xxhash64(column).cast("string"), F.lit("utf-8")).isNull()


def can_fail(rows: DataFrame, columns: list[tuple[Column, str | None]]) -> list[bool]:
    """For each (column, type that it is cast to): False if it is sure not to fail on any row. In doubt it can."""
    if not columns:
        return []
    types = rows.select(*(c.alias(f"c{n}") for n, (c, _) in enumerate(columns))).schema
    out = []
    for (column, kind), found in zip(columns, types, strict=True):
        own = found.dataType.simpleString()
        if "map<" in own:
            out.append(False)
            continue
        if kind is not None and own not in (kind, "void") and (own, kind) not in _WIDER and not (kind == "string" and "<" not in own):
            out.append(True)
        elif _PLAIN.fullmatch(str(column)):
            out.append(False)
        else:
            out.append(not _harmless(rows, column))
    return out


#: Casts that hold every value.
_WIDER = {(a, b) for chain in (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("int", "double"), ("tinyint", "float"), ("smallint", "float")) for i, a in enumerate(chain) for b in chain[i + 1 :]}


def _harmless(rows: DataFrame, column: Column) -> bool:
    text = rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
    text = _LITERAL.sub(r"\1", text.removeprefix("Project [").rpartition(" AS x#")[0])
    if any(name not in _SAFE_CALLS for name in _CALL.findall(text)):
        return False
    return bool(text) and not _TOKEN.sub("", text)


@dataclass(frozen=True)
class Risks:
    """What of a plan can fail on a log: the filters, and of each rule the predicates, key, condition and assignments."""

    filters: bool
    rules: tuple[tuple[bool, bool, bool, bool], ...]

    @property
    def any(self) -> bool:
        return self.filters or any(any(r) for r in self.rules)


def risks(plan: ProjectionPlan, log: DataFrame) -> Risks:
    fields, asked, places = plan.fields or {}, [(plan.accepted(), None)], []
    for rule in plan.rules:
        parts = ([(p, None) for p in rule.predicates], [] if rule.key is None else [(rule.key, plan.key_type)], [] if rule.condition is None else [(rule.condition, None)])
        sets = [(x, fields[n][0]) for n, x in (*rule.assigns.items(), *rule.adds.items())]
        places.append([])
        for part in (*parts, sets):
            places[-1].append(range(len(asked), len(asked) + len(part)))
            asked += part
    found = can_fail(log, asked)
    return Risks(found[0], tuple(tuple(any(found[i] for i in part) for part in own) for own in places))
