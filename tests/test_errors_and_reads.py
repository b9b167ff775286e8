"""Errors of rules as data, order of actions, rules that read their row, and rules that read a child's."""

import random

import pytest
from pyspark.sql import functions as F

from foldspark.operators import capture, fold
from foldspark.operators.projector import ProjectionError, Projector
from foldspark.plans.event_map import EventMapBuilder
from foldspark.sources.log import make_log

KEY = lambda e, c: e.key


def log(spark, events):
    """events: (type, key, text) in order, two in a transaction."""
    rows = [(n // 2 + 1, n % 2, *e) for n, e in enumerate(events)]
    df = spark.createDataFrame(rows, "n long, seq int, type string, key string, text string")
    return make_log(df, checkpoint=F.col("n"), event_seq=F.col("seq"), event_type=F.col("type"), own_id=F.concat(F.lit("t"), F.col("n").cast("string")), body=F.struct("key", "text"))


def numbers(policy="overwriting_duplicates", name="numbers"):
    m = EventMapBuilder(name, "string", {"n": "int"})
    getattr(m.map("A").as_create_of(KEY), policy)().using(n=lambda e, c: e.text.cast("int"))
    return m


def rows(result):
    return {r.key: r.n for r in result.state.collect()}


def test_failing_assignment_is_found_before_the_state_is_handed_out(spark):
    asked = []
    projector = Projector(numbers().build(), should_retry=lambda error, attempt: asked.append((error, attempt)) or attempt < 3)
    events = [("A", "a", "1"), ("A", "b", "2"), ("A", "c", "no number"), ("A", "a", "9")]
    with pytest.raises(ProjectionError, match="failed to project an event") as e:
        projector.project(log(spark, events))
    assert e.value.event == {"checkpoint": 2, "event_seq": 0, "event_type": "A", "key": "c"}
    assert e.value.transaction_id == "t2" and e.value.batch == (2, 2) and e.value.child is None
    assert "no number" in str(e.value.__cause__)
    assert [attempt for _, attempt in asked] == [1, 2, 3] and all(isinstance(x, ProjectionError) and x.event for x, _ in asked)
    found = projector.project(log(spark, events), on_error="cut")
    assert rows(found) == {"a": 1, "b": 2} and found.error.event["checkpoint"] == 2


def test_assignments_count_only_where_they_are_applied(spark):
    m = EventMapBuilder("numbers", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).ignoring_duplicates().using(n=lambda e, c: e.text.cast("int"))
    m.map("U").as_update_of(KEY).ignoring_misses().using(n=lambda e, c: e.text.cast("int"))
    events = [("A", "a", "1"), ("A", "a", "x"), ("U", "b", "y"), ("U", "a", "5"), ("B", "a", "z")]
    found = Projector(m.build()).project(log(spark, events))
    assert found.error is None and rows(found) == {"a": 5}


def test_conditions_count_only_where_they_are_asked(spark):
    m = EventMapBuilder("numbers", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).handling_duplicates_using(lambda e, c: e.text.cast("int") > 3).using(n=lambda e, c: F.length(e.text))
    assert rows(Projector(m.build()).project(log(spark, [("A", "a", "x"), ("A", "b", "yy"), ("A", "a", "4444")]))) == {"a": 4, "b": 2}
    m = EventMapBuilder("numbers", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).handling_duplicates_using(lambda e, c: e.text.cast("int") > 3).using(n=lambda e, c: F.length(e.text))
    with pytest.raises(ProjectionError) as e:
        Projector(m.build()).project(log(spark, [("A", "a", "x"), ("A", "b", "yy"), ("A", "a", "z")]))
    assert e.value.event["checkpoint"] == 2


@pytest.mark.parametrize("where", ["filter", "predicate", "key", "custom"])
def test_other_parts_that_fail(spark, where):
    bad = lambda e, c: e.text.cast("int") > 0
    m = EventMapBuilder("numbers", "string", {"n": "string"})
    if where == "filter":
        m.where(bad)
    action = m.map("A")
    if where == "predicate":
        action.when(bad)
    action.as_create_of((lambda e, c: e.text.cast("int").cast("string")) if where == "key" else KEY).overwriting_duplicates().using(n=lambda e, c: e.text)
    if where == "custom":
        m.map("A").when(bad).as_action("seen")
    events = [("A", "a", "1"), ("A", "b", "2"), ("A", "c", "x"), ("A", "d", "y")]
    found = Projector(m.build()).project(log(spark, events), on_error="cut")
    assert found.error.event["checkpoint"] == 2 and found.error.event["event_seq"] == 0 and "'x'" in str(found.error.__cause__)
    keys = {"1", "2"} if where == "key" else {"a", "b", "c"} if where == "custom" else {"a", "b"}
    assert {r.key for r in found.state.collect()} == keys


def test_first_of_foreign_and_policy_errors_of_children(spark):
    throwing = EventMapBuilder("child", "string", {"n": "int"})
    throwing.map("A").as_create_of(KEY).using(n=lambda e, c: F.lit(1))
    for events, child, text in (
        ([("A", "a", "1"), ("A", "a", "x")], "child", "already exists"),  # the child comes first at the same event
        ([("A", "a", "1"), ("A", "b", "x"), ("A", "a", "3")], None, "failed to project"),
    ):
        with pytest.raises(ProjectionError, match=text) as e:
            Projector(numbers().build(), [Projector(throwing.build() if child else replica(throwing))]).project(log(spark, events))
        assert e.value.child == child and e.value.projector == "numbers"


def replica(builder):
    m = EventMapBuilder("child", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).using(n=lambda e, c: F.lit(1))
    return m.build()


def test_a_child_fails_in_a_rule(spark):
    parent = EventMapBuilder("parent", "string", {"n": "string"})
    parent.map("A").as_create_of(KEY).overwriting_duplicates().using(n=lambda e, c: e.text)
    found = Projector(parent.build(), [Projector(numbers(name="child").build())]).project(log(spark, [("A", "a", "1"), ("A", "b", "x")]), on_error="cut")
    assert found.error.child == "child" and rows(found) == {"a": "1"} and rows(found.children["child"]) == {"a": 1}


def test_plain_plans_run_no_job_to_look_for_errors(spark):
    m = EventMapBuilder("numbers", "string", {"n": "string"})
    m.map("A").when(lambda e, c: e.text > "a").as_create_of(KEY).overwriting_duplicates().using(n=lambda e, c: e.text)
    rows_ = log(spark, [("A", "a", "1")])
    assert not capture.risks(m.build(), rows_).any
    risky = capture.can_fail(rows_, [(F.col("body.text"), "int"), (F.col("checkpoint"), "double"), (F.col("checkpoint") / F.col("event_seq"), None), (F.col("body.text") == 3, None), (F.col("event_headers")["x"], "string"), (F.lit(None), "int"), (F.col("checkpoint") > 5, None)])
    assert risky == [True, True, True, True, False, False, False]


def test_actions_run_child_first_and_finished_ones_not_again(spark):
    ran = []

    def plan(name, *actions):
        m = EventMapBuilder(name)
        for a in actions:
            m.map("A").as_action(a)
        return m.build()

    def failing_once(events):
        ran.append("two")
        if ran.count("two") == 1:
            raise OSError("not now")

    child = Projector(plan("child", "inner"), actions={"inner": lambda events: ran.append("inner")})
    actions = {"one": lambda events: ran.append("one"), "two": failing_once, "three": lambda events: ran.append("three")}
    parent = Projector(plan("parent", *actions), [child], should_retry=lambda error, attempt: isinstance(error, ProjectionError), actions=actions)
    parent.project(log(spark, [("A", "a", "1")]))
    assert ran == ["inner", "one", "two", "two", "three"]


def model(events, chain=None):
    """The sequential reading of ``reading_map``."""
    state = {}
    for kind, key, text in events:
        old = state.get(key)
        if kind == "A" and (old is None or len(text) > old["n"]):
            state[key] = {"n": len(text), "seen": (old or {"seen": 0})["seen"] + 1, "path": text}
        elif kind == "U" and old is not None:
            state[key] = {"n": old["n"], "seen": old["seen"] + 1, "path": (old["path"] + text)[-7:]}
        elif kind == "D":
            state.pop(key, None)
    return {k: (v["n"], v["seen"], v["path"]) for k, v in state.items()}


def reading_map():
    m = EventMapBuilder("reads", "string", {"n": "int", "seen": ("bigint", "count"), "path": "string"})
    m.map("A").as_create_of(KEY).handling_duplicates_using(lambda old, e, c: F.length(e.text) > old.n).adding({"n": lambda e, c: F.length(e.text), "path": lambda e, c: e.text}, seen=F.lit(1))
    m.map("U").as_update_of(KEY).ignoring_misses().adding({"path": lambda old, e, c: F.right(F.concat(old.path, e.text), F.lit(7))}, seen=F.lit(1))
    m.map("D").as_delete_of(KEY).ignoring_misses()
    return m.build()


def random_events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("AAUUUUD"), rng.choice(["hot"] * 6 + ["a", "b", None]), "xyz"[: rng.randint(0, 3)] * rng.randint(1, 4)) for _ in range(n)]


@pytest.mark.parametrize("chain", [3, 50_000])
def test_rules_read_their_row(spark, monkeypatch, chain):
    events = random_events(80, chain)
    monkeypatch.setattr(fold.fold_reading, "__defaults__", (chain,))
    found = Projector(reading_map()).project(log(spark, events)).state
    assert {r.key: (r.n, r.seen, r.path) for r in found.collect()} == model(events)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    half = Projector(reading_map()).project(log(spark, events[:40])).state
    later = make_log(log(spark, events).where("checkpoint > 20"), checkpoint=F.col("checkpoint"), event_seq=F.col("event_seq"), event_type=F.col("event_type"), body=F.col("body"))
    again = Projector(reading_map()).project(later, {"reads": half}).state
    assert {r.key: (r.n, r.seen, r.path) for r in again.collect()} == model(events)


def test_stored_rows_go_through_no_rule(spark):
    m = EventMapBuilder("reads", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).overwriting_duplicates().using(n=lambda old, e, c: F.coalesce(old.n, F.lit(0)) + 1)
    found = Projector(m.build()).project(log(spark, [("A", "a", ""), ("A", "b", "")]), {"reads": spark.createDataFrame([("a", 5), ("c", 7)], "key string, n int")})
    assert rows(found) == {"a": 6, "b": 1, "c": 7}


def test_errors_of_rules_that_read_their_row(spark):
    m = EventMapBuilder("reads", "string", {"n": "int"})
    m.map("A").as_create_of(KEY).ignoring_duplicates().using(n=lambda e, c: e.text.cast("int"))
    m.map("U").as_update_of(KEY).throwing_if_missing().using(n=lambda old, e, c: (F.lit(12) / (old.n - e.text.cast("int"))).cast("int"))
    plan = m.build()
    for events, place, text in (
        ([("A", "a", "5"), ("U", "a", "3"), ("U", "a", "6"), ("A", "b", "1")], (2, 0), "failed to project"),
        ([("A", "a", "5"), ("U", "b", "3"), ("U", "a", "5")], (1, 1), "Failed to find reads with key b"),
        ([("A", "a", "5"), ("A", "a", "x"), ("A", "c", "x")], (2, 0), "failed to project"),
    ):
        found = Projector(plan).project(log(spark, events), on_error="cut")
        assert (found.error.event["checkpoint"], found.error.event["event_seq"]) == place and text in str(found.error)
        assert rows(found) == ({"a": 6} if text.startswith("failed") and len(events) == 4 else {"a": 5})
    with pytest.raises(ValueError, match="misses"):
        m = EventMapBuilder("reads", "string", {"n": "int"})
        m.map("U").as_update_of(KEY).using(n=lambda old, e, c: old.n)
        m.map("D").as_delete_of(KEY).handling_misses_using()
        m.build()


def test_a_key_of_a_million_ops(spark):
    n = F.col("id")
    df = make_log(spark.range(1_000_000), checkpoint=n + 1, event_type=F.when(n == 0, "A").otherwise("U"), body=F.struct(F.lit("k").alias("key"), (n % 1000).cast("int").alias("v")))
    m = EventMapBuilder("reads", "string", {"peaks": "bigint", "last": "int"})
    m.map("A").as_create_of(KEY).using(peaks=F.lit(0), last=lambda e, c: e.v)
    m.map("U").as_update_of(KEY).ignoring_misses().using(peaks=lambda old, e, c: old.peaks + F.when(e.v < old.last, 1).otherwise(0), last=lambda e, c: e.v)
    found = Projector(m.build()).project(df).state.collect()
    assert [(r.key, r.peaks, r.last) for r in found] == [("k", 999, 999)]


def test_rules_read_children_as_of_their_event(spark):
    names = EventMapBuilder("names", "string", {"name": "string"})
    names.map("N").as_create_of(KEY).overwriting_duplicates().using(name=lambda e, c: e.text)
    names.map("X").as_delete_of(KEY).ignoring_misses()
    m = EventMapBuilder("users", "string", {"name": "string", "there": "boolean"})
    read = {"name": lambda e, c: c.child("names", e.text).name, "there": lambda e, c: c.child("names", e.text).is_there()}
    m.map("U").as_create_of(KEY).overwriting_duplicates().using(**read)
    m.map("N").as_create_of(lambda e, c: F.concat(F.lit("own "), e.key)).overwriting_duplicates().using(name=lambda e, c: c.child("names", e.key).name)
    events = [("U", "u1", "de"), ("N", "de", "Germany"), ("U", "u2", "de"), ("X", "de", None), ("U", "u3", "de"), ("N", "de", "Deutschland"), ("U", "u4", "de"), ("U", "u5", None)]
    projector = Projector(m.build(), [Projector(names.build())])
    found = {r.key: (r.name, r.there) for r in projector.project(log(spark, events)).state.collect()}
    assert found == {"u1": (None, False), "u2": ("Germany", True), "u3": (None, False), "u4": ("Deutschland", True), "u5": (None, False), "own de": ("Deutschland", None)}
    carried = projector.project(log(spark, events[:1]), {"names": spark.createDataFrame([("de", "before")], "key string, name string")})
    assert [(r.name, r.there) for r in carried.state.collect()] == [("before", True)]
    with pytest.raises(ValueError, match="no child"):
        Projector(projector.plan)
