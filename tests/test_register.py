"""The document register: its log is read once, its periods and lookups are those of a plain fold."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foldspark import queries
from foldspark.operators import lookup
from foldspark.operators.fold import op_rows
from foldspark.operators.projector import Projector
from foldspark.plans import documents
from foldspark.plans.event_map import EventMapBuilder
from foldspark.sources import log as logs

DAY = datetime(2020, 1, 1)
BODY_FIELDS = "Code string, Name string, Number string, DocumentNumber string, Kind string, Country string, InitialState string, State string, Area string, NextReviewAt timestamp_ntz, PeriodEnd timestamp_ntz, Sequence int, `From` timestamp_ntz, `To` timestamp_ntz, ClosedAt timestamp_ntz"


def register_log(spark, events):
    names = [f.split()[0].strip("`") for f in BODY_FIELDS.split(", ")]
    rows = [(n + 1, kind, tuple(body.get(x) for x in names)) for n, (kind, body) in enumerate(events)]
    df = spark.createDataFrame(rows, f"n long, t string, b struct<{BODY_FIELDS}>")
    return logs.make_log(df, checkpoint=F.col("n"), event_type=F.col("t"), body=F.col("b"))


def test_the_register_reads_each_table_once_without_python(spark):
    plan = queries.document_register(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_linenumber" in line and "Relation" in line for line in plan.splitlines()) == 1
    assert "MapInArrow" not in plan and "register-ops" not in plan


def test_countries_read_no_orders_and_lines(spark):
    log = queries._register_log(spark, "/root/testdata/sf0.001")
    plan = log.where("event_type = 'CountryRegisteredEvent'")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_nationkey" in plan and "l_orderkey" not in plan and "o_custkey" not in plan


def fold(events):
    """(periods, starts, ends) by document, event by event."""
    docs = {}
    planned, reset, approved, closed, canceled = documents.PERIODS
    for kind, b in events:
        if kind == "WarrantAssignedEvent":
            docs[b["Number"]] = [[], None, None]
        elif kind == "DocumentArchivedEvent":
            docs.pop(b["DocumentNumber"], None)
        elif (doc := docs.get(b["DocumentNumber"])) is not None:
            period = next((p for p in doc[0] if p[0] == b["Sequence"]), None)
            if period is None:
                period = [b["Sequence"], None, None, None]
                doc[0].append(period)
            if kind in (planned, reset):
                period[1:3] = (b["From"], b["To"]) if kind == planned else (None, None)
            elif kind == closed:
                period[2:] = b["ClosedAt"], "Closed"
            elif kind == canceled:
                period[3] = "Canceled"
            else:
                period[3] = "Valid"
                valid = [p for p in doc[0] if p[3] == "Valid"]
                chain = valid[-1:]
                while before := next((p for p in valid if p[2] == chain[-1][1] and not any(p is c for c in chain)), None):
                    chain.append(before)
                chain.sort(key=lambda p: p[0])
                doc[1:] = chain[0][1], chain[-1][2]
    return {k: ([tuple(p) for p in periods], a, b) for k, (periods, a, b) in docs.items()}


def test_periods_are_those_of_a_fold(spark):
    rng, events, alive = random.Random(3), [], set()
    day = lambda: DAY + timedelta(days=rng.randrange(4))
    for _ in range(1500):
        doc = str(rng.randrange(25))
        if doc not in alive:
            alive.add(doc)
            events.append(("WarrantAssignedEvent", {"Number": doc, "Kind": "k", "Country": "c", "InitialState": "Active"}))
        elif rng.random() < 0.03:
            alive.discard(doc)
            events.append(("DocumentArchivedEvent", {"DocumentNumber": doc}))
        else:
            kind = rng.choice([documents.PERIODS[0], documents.PERIODS[2], *documents.PERIODS])
            events.append((kind, {"DocumentNumber": doc, "Sequence": rng.randrange(6), "From": day(), "To": day(), "ClosedAt": day()}))
    found = {r.key: ([tuple(p) for p in r.periods], r.starts, r.ends) for r in documents.register(register_log(spark, events)).collect()}
    assert found == fold(events)


def test_lookups_by_intervals_and_by_union(spark, monkeypatch):
    names = EventMapBuilder("names", "string", {"name": "string"})
    names.map("named").as_create_of(lambda e, c: e.code).overwriting_duplicates().using(name=lambda e, c: e.name)
    names.map("gone").as_delete_of(lambda e, c: e.code).ignoring_misses()
    rows = EventMapBuilder("rows", "string", {"name": "string", "there": "boolean"})
    rows.map("asks").as_create_of(lambda e, c: c.transaction_id).using(name=lambda e, c: c.child("names", e.code).name, there=lambda e, c: c.child("names", e.code).is_there())
    rows.map("named").as_create_of(lambda e, c: c.transaction_id).using(name=F.lit("-"))
    names, rows, rng = names.build(), rows.build(), random.Random(5)
    events = [(n + 1, rng.choice(["named", "asks", "asks", "gone", "other"]), rng.choice(["a", "b", None]), str(n)) for n in range(60)]
    log = logs.make_log(spark.createDataFrame(events, "n long, t string, code string, name string"), checkpoint=F.col("n"), event_type=F.col("t"), body=F.struct("code", "name"))
    want, now = {}, {}
    for n, kind, code, name in events:
        if kind == "named":
            now[code] = name
            want[str(n)] = ("-", None)
        elif kind == "gone":
            now.pop(code, None)
        elif kind == "asks":
            want[str(n)] = (now.get(code), code in now)
    for most in (1000, 0):
        monkeypatch.setattr(lookup, "INTERVALS", most)
        state = Projector(rows, [Projector(names)]).project(log).state
        assert {r.key: (r.name, r.there) for r in state.collect()} == want


def test_rules_of_one_type_and_of_its_base_all_run(spark):
    m = EventMapBuilder("all", "string", {"a": "string", "b": "string", "n": ("bigint", "count")})
    key = lambda e, c: e.k
    m.map("x").when(lambda e, c: e.v > 1).as_create_of(key).overwriting_duplicates().using(a=lambda e, c: e.k)
    m.map("y").as_create_of(key).overwriting_duplicates().adding({"b": F.lit("y")}, n=F.lit(1))
    m.map("x").as_update_of(key).ignoring_misses().adding({"b": F.lit("x")}, n=F.lit(1))
    m.map("z").as_action("z")
    rows = spark.createDataFrame([(1, "x", "p", 1), (2, "x", "p", 2), (3, "y", "q", 0), (4, "z", "q", 0), (5, "w", "q", 0)], "n long, t string, k string, v int")
    log = logs.make_log(rows, checkpoint=F.col("n"), event_type=F.col("t"), body=F.struct("k", "v"))
    found = sorted((r.checkpoint, r.op, r.key, r.action, None if r.set_a is None else r.set_a.v, None if r.set_b is None else r.set_b.v, r.add_n) for r in op_rows(m.build(), log).collect())
    assert found == [(1, "update", "p", None, None, "x", 1), (2, "create", "p", None, "p", None, None), (2, "update", "p", None, None, "x", 1), (3, "create", "q", None, None, "y", 1), (4, "custom", None, "z", None, None, None)]
