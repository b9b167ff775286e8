"""Progress statistics: last checkpoints, properties, events, speed and time to reach a checkpoint.

Input: a progress log (projector_id, seq, ts, checkpoint), where ``seq`` is the order of calls; properties add (name,
value), events (body). All figures are DataFrames.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldspark.sources.tables import sized, written

#: Of the two samplers: seconds that must pass for a new sample (strictly more), and samples kept.
SHORT, LONG = (5, 12), (60, 9)


def last_checkpoints(progress: DataFrame) -> DataFrame:
    """(projector_id, checkpoint, ts) of the last call of each projector, which need not be the highest checkpoint."""
    last = F.max_by(F.struct("checkpoint", "ts"), "seq")
    return progress.groupBy("projector_id").agg(last.alias("l")).select("projector_id", F.col("l.checkpoint").alias("checkpoint"), F.col("l.ts").alias("ts"))


def last_properties(properties: DataFrame) -> DataFrame:
    """(projector_id, name, value, ts): the last value of each property."""
    last = F.max_by(F.struct("value", "ts"), "seq")
    return properties.groupBy("projector_id", "name").agg(last.alias("l")).select("projector_id", "name", F.col("l.value").alias("value"), F.col("l.ts").alias("ts"))


#: Records of a range, about: ranges are worked on by themselves.
RANGE_ROWS = 100_000


class _Range:
    """Records of one projector in a range of its log, and where a sampler goes from any of them.

    The record that becomes the next base after base b is the first later one more than ``threshold`` seconds after b,
    so it depends on b's time alone, and what a range does to a base that enters it is a step function of that time.
    """

    def __init__(self, at: np.ndarray, checkpoint: np.ndarray, threshold: int) -> None:
        self.at, self.checkpoint, self.threshold = at, checkpoint, threshold
        n = len(at)
        tops = [at]  # the latest time of 1, 2, 4, ... records from each one on
        while 2 << (len(tops) - 1) <= n:
            half = len(tops[-1]) - (1 << (len(tops) - 1))
            tops.append(np.maximum(tops[-1][:half], tops[-1][-half:]))
        place = np.arange(1, n + 1)
        for step in range(len(tops) - 1, -1, -1):
            can = np.flatnonzero(place + (1 << step) <= n)
            can = can[tops[step][place[can]] - at[can] <= threshold]
            place[can] += 1 << step
        self.next = place

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each record the last base of the chain from it, and the steps to get there; by pointer doubling."""
        n = len(self.at)
        to = np.where(self.next < n, self.next, np.arange(n))
        steps = (self.next < n).astype(np.int64)
        while (to[to] != to).any():
            steps, to = steps + steps[to], to[to]
        return to, steps

    def table(self) -> dict:
        """What the range does to a base: ``upto``, ``leave_at``, ``leave_checkpoint``, ``samples`` are the step function, by time, neighbours of one outcome as one; ``begin_...`` is the outcome where the range's first record is the first base."""
        last, steps = self.ends()
        first = np.flatnonzero(self.at > np.concatenate(([-np.inf], np.maximum.accumulate(self.at)[:-1])))
        outcome = np.stack([last[first], steps[first]])
        final = np.append((outcome[:, 1:] != outcome[:, :-1]).any(axis=0), True)
        kept = first[final]
        return {
            "upto": self.at[kept], "leave_at": self.at[last[kept]], "leave_checkpoint": self.checkpoint[last[kept]], "samples": steps[kept] + 1,
            "begin_at": self.at[last[0]], "begin_checkpoint": self.checkpoint[last[0]], "begin_samples": int(steps[0]),
        }

    def newest(self, base: tuple[float, float] | None, keep: int) -> list[np.float32]:
        """The last ``keep`` samples of the range if it is entered with ``base``, or begins with its first record."""
        found: deque[np.float32] = deque(maxlen=keep)
        if base is None:
            at = int(self.next[0])
            base = (self.at[0], self.checkpoint[0])
        else:
            later = np.flatnonzero(self.at - base[0] > self.threshold)
            at = int(later[0]) if len(later) else len(self.at)
        while at < len(self.at):
            found.append(np.float32((self.checkpoint[at] - base[1]) / (self.at[at] - base[0])))
            base, at = (self.at[at], self.checkpoint[at]), int(self.next[at])
        return list(found)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Times in seconds and checkpoints in order of calls."""
    order = np.argsort(table.column("seq").to_numpy(), kind="stable")
    return table.column("at").to_numpy()[order] / 1e6, table.column("checkpoint").to_numpy()[order]


def _weighted(samples: list[np.float32]) -> np.float32 | None:
    """The mean weighted 1 for the oldest to n for the newest; None without samples."""
    if not samples:
        return None
    total = np.float32(0)
    for n, x in enumerate(samples, 1):
        total = np.float32(total + np.float32(x * np.float32(n)))
    return np.float32(float(total) / (len(samples) * (len(samples) + 1) / 2))


def speeds(progress: DataFrame) -> DataFrame:
    """(projector_id, speed): checkpoints a second, from samples of the last minute and the last ten; the minute's speed is the newest of the latter.

    A projector's log is cut into ranges of calls. Each range gives a table of what it does to a base that enters it;
    the tables, not the records, are walked through in order, and samples are taken only from the ranges that hold the
    newest ones. So no task sees a projector's whole log. Records without a time or checkpoint are no samples; a
    projector without samples has a null speed.
    """
    kind = progress.schema["projector_id"].dataType
    names, samplers = kind.simpleString(), (SHORT, LONG)
    given = progress.select("projector_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("checkpoint").cast("double").alias("checkpoint"))
    rows = given.where("at is not null and checkpoint is not null and not isnan(checkpoint)")
    parts = max(1, rows.count() // RANGE_ROWS)
    rows = written(rows.repartitionByRange(parts, "projector_id", "seq").withColumn("_range", F.spark_partition_id()), "progress")
    arrays = "upto array<double>, leave_at array<double>, leave_checkpoint array<double>, samples array<long>"
    schema = f"projector_id {names}, _range int, sampler int, {arrays}, begin_at double, begin_checkpoint double, begin_samples long"

    entered = f"projector_id {names}, _range int, sampler int, base_at double, base_checkpoint double"
    taken = f"projector_id {names}, sampler int, _range int, n int, speed float"
    last = f"projector_id {names}, speed float"
    of_tables, of_bases, of_samples, of_speeds = (to_arrow_schema(StructType.fromDDL(x)) for x in (schema, entered, taken, last))

    def tables(key: tuple, table: pa.Table) -> pa.Table:
        at, checkpoint = _sorted(table)
        out = [{"projector_id": key[0].as_py(), "_range": key[1].as_py(), "sampler": n, **_Range(at, checkpoint, threshold).table()} for n, (threshold, _) in enumerate(samplers)]
        return pa.Table.from_pylist(out, schema=of_tables)

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        """The base that enters each range that holds some of the newest samples."""
        threshold, keep = samplers[key[1].as_py()]
        base, found = None, []
        for r in sorted(table.to_pylist(), key=lambda r: r["_range"]):
            before, n = base, 0
            if base is None:
                base, n = (r["begin_at"], r["begin_checkpoint"]), r["begin_samples"]
            elif len(over := np.flatnonzero(np.array(r["upto"]) - base[0] > threshold)):
                i = int(over[0])
                base, n = (r["leave_at"][i], r["leave_checkpoint"][i]), r["samples"][i]
            found.append((r["_range"], before, n))
        out, later = [], 0
        for range_, before, n in reversed(found):
            if n and later < keep:
                out.append({"projector_id": key[0].as_py(), "_range": range_, "sampler": key[1].as_py(), "base_at": before and before[0], "base_checkpoint": before and before[1]})
            later += n
        return pa.Table.from_pylist(out, schema=of_bases)

    def samples(key: tuple, table: pa.Table) -> pa.Table:
        at, checkpoint = _sorted(table)
        threshold, keep = samplers[key[2].as_py()]
        base = [table.column(c)[0].as_py() for c in ("base_at", "base_checkpoint")]
        found = _Range(at, checkpoint, threshold).newest(None if base[0] is None else tuple(base), keep)
        out = [{"projector_id": key[0].as_py(), "sampler": key[2].as_py(), "_range": key[1].as_py(), "n": n, "speed": float(x)} for n, x in enumerate(found)]
        return pa.Table.from_pylist(out, schema=of_samples)

    def speed(key: tuple, table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: (r["sampler"], r["_range"], r["n"]))
        minute, ten = ([np.float32(r["speed"]) for r in own if r["sampler"] == n][-keep:] for n, (_, keep) in enumerate(samplers))
        newest = _weighted(minute)
        found = _weighted(ten if newest is None else [*ten, newest])
        return pa.Table.from_pylist([{"projector_id": key[0].as_py(), "speed": float(found)}], schema=of_speeds)

    steps = rows.groupBy("projector_id", "_range").applyInArrow(tables, schema)
    bases = written(steps.groupBy("projector_id", "sampler").applyInArrow(walk, entered), "bases").withColumnRenamed("projector_id", "_id").withColumnRenamed("_range", "_r")
    near = rows.join(sized(bases), F.col("projector_id").eqNullSafe(F.col("_id")) & (F.col("_range") == F.col("_r"))).drop("_id", "_r")
    newest = near.groupBy("projector_id", "_range", "sampler").applyInArrow(samples, taken)
    found = newest.groupBy("projector_id").applyInArrow(speed, last).withColumnRenamed("projector_id", "_id")
    return given.select("projector_id").distinct().join(found, F.col("projector_id").eqNullSafe(F.col("_id")), "left").select("projector_id", "speed")


#: The longest time there is, in seconds: 64 bits of 100 nanoseconds.
LONGEST = 922_337_203_685


def time_to_reach(progress: DataFrame, target: Column | int) -> DataFrame:
    """(projector_id, checkpoint, speed, eta_seconds): whole seconds, cut towards zero, of 32-bit division.

    0 if the target is reached; NULL without a speed, at speed 0 and beyond the longest time; negative at a negative speed.
    """
    goal = target if isinstance(target, Column) else F.lit(target)
    both = last_checkpoints(progress).join(speeds(progress), "projector_id")
    rest = F.try_divide((goal - F.col("checkpoint")).cast("float").cast("double"), F.col("speed").cast("double")).cast("float")
    eta = F.when(goal <= F.col("checkpoint"), F.lit(0).cast("long")).when(F.abs(rest) <= LONGEST, rest.try_cast("long"))
    return both.select("projector_id", "checkpoint", "speed", eta.alias("eta_seconds"))


def eta_parts(seconds: Column) -> Column:
    """struct(days, hours, minutes, seconds, milliseconds) of seconds or parts of them, each cut towards zero and of the sign of the whole."""
    whole = seconds.cast("long")
    thousandths = (seconds.cast("decimal(30, 9)") * 1000).cast("long")
    cut = lambda n: (whole - whole % n) / n  # noqa: E731  % keeps the sign
    part = lambda x: x.cast("long")
    return F.struct(part(cut(86400)).alias("days"), part(cut(3600) % 24).alias("hours"), part(cut(60) % 60).alias("minutes"), (whole % 60).alias("seconds"), F.coalesce((thousandths % 1000).cast("int"), F.lit(0)).alias("milliseconds"))


def restored(projector_id: str, properties: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(progress, properties, events) of a projector restored from stored properties (name, value, ts) and events (body, ts).

    Restored rows come before every later call (seq below 0, in order of time); progress starts anew, with no checkpoint.
    """
    spark = properties.sparkSession
    own = F.lit(projector_id).alias("projector_id")
    before = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1 << 62)).alias("seq")
    progress = spark.createDataFrame([], "projector_id string, seq long, ts timestamp, checkpoint long")
    return progress, properties.select(own, F.lit(-1).cast("long").alias("seq"), "ts", "name", "value"), events.select(own, before, "ts", "body")


def summary(progress: DataFrame, base_url: str = "") -> DataFrame:
    """The list view, sorted by id."""
    return last_checkpoints(progress).select("projector_id", F.col("checkpoint").alias("last_checkpoint"), F.col("ts").alias("updated_utc"), F.concat(F.lit(base_url + "/"), "projector_id").alias("url")).orderBy("projector_id")


def detail(progress: DataFrame, properties: DataFrame, projector_id: str, base_url: str = "") -> DataFrame:
    """One row, also for an unknown id: checkpoint 0 and no properties."""
    spark = progress.sparkSession
    one = spark.createDataFrame([(projector_id,)], "projector_id string")
    props = last_properties(properties.where(F.col("projector_id") == projector_id)).groupBy("projector_id").agg(F.sort_array(F.collect_list(F.struct("name", "value", "ts"))).alias("properties"))
    last = last_checkpoints(progress.where(F.col("projector_id") == projector_id))
    return one.join(last, "projector_id", "left").join(props, "projector_id", "left").select(
        "projector_id", F.coalesce("checkpoint", F.lit(0)).alias("last_checkpoint"), F.col("ts").alias("updated_utc"),
        F.coalesce("properties", F.array().cast(props.schema["properties"].dataType)).alias("properties"), F.lit(f"{base_url}/{projector_id}/events").alias("events_url"),
    )


def events(log: DataFrame, projector_id: str) -> DataFrame:
    return log.where(F.col("projector_id") == projector_id).orderBy("seq").select("body", "ts")
