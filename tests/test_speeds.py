"""Speeds over ranges of a projector's log, against the samplers as they are defined."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions import stats


def model(points):
    """points: (seconds, checkpoint) in order of calls."""
    kept = []
    for threshold, keep in (stats.SHORT, stats.LONG):
        base, samples = None, []
        for t, c in points:
            if base is None:
                base = (t, c)
            elif t - base[0] > threshold:
                samples.append(np.float32((c - base[1]) / (t - base[0])))
                base = (t, c)
        kept.append(samples[-keep:])
    newest = stats._weighted(kept[0])
    found = stats._weighted(kept[1] if newest is None else [*kept[1], newest])
    return None if found is None else float(found)


def logs_of(seed):
    rng = random.Random(seed)
    dense = [(n // 10 + (n % 10) / 10, 3 * n + rng.randint(0, 9)) for n in range(2000)]
    jumps, t = [], 0.0
    for n in range(900):
        t += rng.choice([0, 0.5, 7, 61, -30, -80, 5])
        jumps.append((t, n * 7 % 1000))
    return {"dense": dense, "jumps": jumps, "flat": [(1.0, n) for n in range(300)], "one": [(5.0, 5)], "falling": [(float(-n), n) for n in range(200)], None: dense[::3]}


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_ranges_give_what_the_whole_log_gives(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "RANGE_ROWS", rows)
    begin, own = datetime(2020, 1, 1), logs_of(rows)
    table = [(i, n, begin + timedelta(seconds=t), c) for i, points in own.items() for n, (t, c) in enumerate(points)] + [("none", 0, None, 1), ("none", 1, begin, None)]
    random.Random(1).shuffle(table)
    df = spark.createDataFrame(table, "projector_id string, seq long, ts timestamp, checkpoint long")
    found = {r.projector_id: r.speed for r in stats.speeds(df).collect()}
    micros = lambda t: int((begin + timedelta(seconds=t) - datetime(1970, 1, 1)) / timedelta(microseconds=1)) / 1e6
    assert found == {i: model([(micros(t), c) for t, c in points]) for i, points in own.items()} | {"none": None}


def test_a_range_is_a_step_function():
    rng = np.random.default_rng(0)
    at = np.cumsum(rng.choice([0.0, 1.0, 4.0, -3.0, 9.0], 400))
    own = stats._Range(at, np.arange(400.0), 5)
    table = own.table()
    for base in np.linspace(at.min() - 20, at.max() + 5, 300):
        time, n = base, 0
        for t in at:
            if t - time > 5:
                time, n = t, n + 1
        over = np.flatnonzero(table["upto"] - base > 5)
        got = (table["leave_at"][over[0]], table["samples"][over[0]]) if len(over) else (base, 0)
        assert got == (time, n)
        assert len(own.newest((base, 0.0), 1000)) == n
    assert len(table["upto"]) < 120  # chains meet, so outcomes are few beside 400 records


def test_parts_of_seconds(spark):
    found = spark.range(1).select(stats.eta_parts(F.lit(-61.257)).alias("a"), stats.eta_parts(F.lit(0.999)).alias("b"), stats.eta_parts(F.lit(5)).alias("c")).first()
    assert tuple(found.a) == (0, 0, -1, -1, -257) and tuple(found.b) == (0, 0, 0, 0, 999) and tuple(found.c) == (0, 0, 0, 5, 0)
