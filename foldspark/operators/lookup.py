"""As-of lookups of a child projection's history, nested collections, and chains of adjoining periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from foldspark.sources.tables import BROADCAST_ROWS


def as_of(left: DataFrame, right: DataFrame, key: str, order: list[str], values: list[str], prefix: str = "", split_every: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same key at or before its place.

    One union and one window: no row of one side is paired with many of the other. Deletions must be rows of ``right``
    (with NULL values), so that they end what came before. A null key matches null keys. ``split_every``: values of the
    first column of ``order`` (a number) that make a range; ranges of a key are worked on by themselves, and the last
    value before each comes from sums by key and range, so a key with very many rows is spread over tasks.
    """
    both = [*(F.col(c) for c in order)]
    a = right.select(F.col(key).alias("_key"), *both, F.lit(0).alias("_side"), F.struct(*values).alias("_value"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    b = left.select(F.col(key).alias("_key"), *both, F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    rows, by = a.unionByName(b), ["_key"]
    if split_every is not None:
        rows, by = rows.withColumn("_range", F.floor(F.col(order[0]) / split_every)), ["_key", "_range"]
    w = Window.partitionBy(*by).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_value", ignorenulls=True).over(w)
    if split_every is not None:
        place = F.when(F.col("_value").isNotNull(), F.struct(*order))
        rows = carried(rows, ["_key"], {"_before": F.max_by("_value", place)})
        last = F.coalesce(last, F.col("_before"))
    found = rows.withColumn("_found", last).where("_side = 1")
    return found.select("_row.*", *(F.col(f"_found.{v}").alias(prefix + v) for v in values))


#: Rows of a key up to which its history is joined as intervals: each row that asks is compared with so many at most.
INTERVALS = 16


def as_of_small(left: DataFrame, right: DataFrame, key: Column, asks: Column, order: list[str], value: str, name: str) -> DataFrame | None:
    """``left`` with ``name``: ``value`` of the last row of ``right`` (_key, ``order``, rule_seq, ``value``) of ``key`` at or before its place, for the rows that ask.

    ``right`` is broadcast, each row as the interval until its key's next one, so that rows of ``left`` stay where they
    are, however many ask for one key. None if ``right`` has too many rows for it, over all or of one key.
    """
    size = right.groupBy("_key").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if (size.n or 0) > BROADCAST_ROWS or (size.most or 0) > INTERVALS:
        return None
    place = F.struct(*order)
    until = F.lead(place).over(Window.partitionBy("_key").orderBy(*order, "rule_seq"))
    intervals = right.select("_key", place.alias("_from"), until.alias("_until"), F.col(value).alias(name))
    here = F.struct(*(left[c] for c in order))
    same = asks & key.eqNullSafe(F.col("_key")) & (F.col("_from") <= here) & (F.col("_until").isNull() | (here < F.col("_until")))
    return left.join(F.broadcast(intervals), same, "left").drop("_key", "_from", "_until")


def carried(rows: DataFrame, by: list[str], last: dict[str, Column]) -> DataFrame:
    """``rows`` (with _range) with, for each name in ``last``, the figure of the latest earlier range of the same ``by`` that has one.

    Figures are worked out by ``by`` and range with map-side sums, so what is carried has a row for each range of a key.
    """
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_range").agg(*(x.alias(n) for n, x in last.items()))
    parts = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), *(F.last(n, ignorenulls=True).over(w).alias(n) for n in last))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(parts, same).drop("_r", *(f"_by_{c}" for c in by))


def nest(rows: DataFrame, parent: str, sequence: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """(parent, ``name``): the last values of each (parent, sequence), as an array of structs in order of first touch.

    Fields that an op leaves NULL keep what an earlier one set. A field of type struct<v> is assigned its v, NULL too.
    """
    place = F.struct(*order)

    def last(f: str) -> Column:
        found, kind = F.max_by(f, F.when(F.col(f).isNotNull(), place)), rows.schema[f].dataType
        return found["v"] if isinstance(kind, StructType) and kind.names == ["v"] else found

    each = rows.groupBy(parent, sequence).agg(F.min(place).alias("_first"), *(last(f).alias(f) for f in fields))
    items = F.sort_array(F.collect_list(F.struct("_first", sequence, *fields)))
    return each.groupBy(parent).agg(F.transform(items, lambda x: F.struct(x[sequence].alias(sequence), *(x[f].alias(f) for f in fields))).alias(name))


def contiguous_chain(periods: Column, start: str = "from", end: str = "to", valid: str = "valid") -> Column:
    """struct(first, last): the chain of adjoining valid periods that ends with the array's last valid one.

    It goes back while another valid period ends where the current one starts (two NULLs are equal), at most once round
    the array. NULL if no period is valid.
    """
    good = F.filter(periods, lambda p: F.coalesce(p[valid], F.lit(False)))
    last = F.element_at(good, -1)

    def back(acc: Column, _: Column) -> Column:
        before = F.filter(good, lambda p: p[end].eqNullSafe(acc[start]) & ~p.eqNullSafe(acc))
        return F.when(F.size(before) > 0, before[0]).otherwise(acc)

    first = F.aggregate(good, last, back)
    return F.when(F.size(good) > 0, F.struct(first.alias("first"), last.alias("last")))
