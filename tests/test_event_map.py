"""Maps, folds and policies on small catalogue logs, against a sequential model."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foldspark.operators import fold
from foldspark.operators.lookup import as_of
from foldspark.operators.projector import ProjectionError, Projector
from foldspark.plans.event_map import EventMapBuilder
from foldspark.plans.types import TypeRegistry
from foldspark.sources.log import make_log

TYPES = TypeRegistry({"Added": "ProductEvent", "Discontinued": "ProductEvent", "PriceChanged": "ProductEvent"})
FIELDS = {"category": "string", "price": "decimal(10,2)"}


def log(spark, events, headers=None):
    """events: (type, key, category, price) in order."""
    rows = [(n + 1, *e, headers or {}) for n, e in enumerate(events)]
    df = spark.createDataFrame(rows, "n long, type string, key string, category string, price double, headers map<string,string>")
    return make_log(df, checkpoint=F.col("n"), event_type=F.col("type"), body=F.struct("key", "category", "price"), event_headers=F.col("headers"))


def state(plan, rows, **more):
    return {r.key: (r.category, None if r.price is None else float(r.price)) for r in Projector(plan).project(rows, **more).state.collect()}


def catalogue(registry=None):
    return EventMapBuilder("ProductCatalogEntry", "string", FIELDS, registry or TYPES)


KEY = lambda e, c: e.key
CATEGORY = {"category": lambda e, c: e.category}


def test_create_and_key_from_header(spark):
    m = catalogue()
    m.map("Added").as_create_of(lambda e, c: c.header("ProductId")).using(**CATEGORY)
    assert state(m.build(), log(spark, [("Added", None, "Hybrids", None)], {"ProductId": "1234"})) == {"1234": ("Hybrids", None)}


@pytest.mark.parametrize(("policy", "want"), [("ignoring_duplicates", "Fosile"), ("overwriting_duplicates", "Hybrids")])
def test_duplicates(spark, policy, want):
    m = catalogue()
    getattr(m.map("Added").as_create_of(KEY), policy)().using(**CATEGORY)
    assert state(m.build(), log(spark, [("Added", "c350E", "Fosile", None), ("Added", "c350E", "Hybrids", None)]))["c350E"][0] == want


def test_custom_duplicates_and_throw(spark):
    rows = log(spark, [("Added", "a", "old", None), ("Added", "a", "new", None)])
    m = catalogue()
    m.map("Added").as_create_of(KEY).handling_duplicates_using(lambda e, c: e.category == "new").using(**CATEGORY)
    assert state(m.build(), rows) == {"a": ("new", None)}
    m = catalogue()
    m.map("Added").as_create_of(KEY).using(**CATEGORY)
    plan = m.build()
    with pytest.raises(ProjectionError, match="ProductCatalogEntry with key a already exists") as e:
        Projector(plan).project(rows)
    assert e.value.event["checkpoint"] == 2 and e.value.transaction_id == "2"
    assert state(plan, rows, on_error="cut") == {"a": ("old", None)}


def test_update_misses(spark):
    rows = log(spark, [("Added", "a", "x", None)])
    for policy, want in (("ignoring_misses", {}), ("creating_if_missing", {"a": ("x", None)})):
        m = catalogue()
        getattr(m.map("Added").as_update_of(KEY).using(**CATEGORY), policy)()  # a policy after using counts
        assert state(m.build(), rows) == want
    m = catalogue()
    m.map("Added").as_update_of(KEY).using(**CATEGORY)
    with pytest.raises(ProjectionError, match="Failed to find"):
        Projector(m.build()).project(rows)


def test_deletes(spark):
    rows = log(spark, [("Added", "a", "x", None), ("Discontinued", "a", None, None), ("Discontinued", "b", None, None)])
    m = catalogue()
    m.map("Added").as_create_of(KEY).using(**CATEGORY)
    m.map("Discontinued").as_delete_of(KEY).handling_misses_using()
    found = Projector(m.build()).project(rows)
    assert found.state.count() == 0 and [r.key for r in found.misses.collect()] == ["b"]
    m = catalogue()
    m.map("Discontinued").as_delete_of(KEY)
    with pytest.raises(ProjectionError, match="Could not delete"):
        Projector(m.build()).project(rows)


def test_filters_predicates_and_handled(spark):
    rows = log(spark, [("Added", "a", "Hybrids", None), ("Other", "a", "Hybrids", None)])
    m = catalogue().where(lambda e, c: e.category == "Electric")
    m.map("Added").as_create_of(KEY).using(**CATEGORY)
    assert state(m.build(), rows) == {}
    m = catalogue()
    action = m.map("Added")
    action.as_create_of(KEY).using(**CATEGORY)
    action.when(lambda e, c: e.category == "Electric")  # also holds for the handler before it
    plan = m.build()
    assert state(plan, rows) == {}
    assert [r.h for r in rows.orderBy("checkpoint").select(plan.handled().alias("h")).collect()] == [True, False]


def test_base_then_concrete(spark):
    rows = log(spark, [("PriceChanged", "a", None, 10.5), ("Unknown", "b", None, 1.0)])
    m = catalogue(TypeRegistry(TYPES.parents, root="object"))
    m.map("PriceChanged").as_update_of(KEY).creating_if_missing().using(category=F.lit("Concrete"), price=lambda e, c: e.price)
    m.map("ProductEvent").as_update_of(KEY).creating_if_missing().using(category=F.lit("All Products"))
    m.map("object").as_update_of(KEY).creating_if_missing().using(category=F.lit("any"))
    # the base is the first registered ancestor only; the concrete handler is last
    assert state(m.build(), rows) == {"a": ("Concrete", 10.5), "b": ("any", None)}


def test_null_is_assigned_and_kept_apart(spark):
    rows = log(spark, [("Added", "a", "x", 1.0), ("PriceChanged", "a", None, 2.0), ("Cleared", "a", None, None)])
    m = catalogue()
    m.map("Added").as_create_of(KEY).using(**CATEGORY, price=lambda e, c: e.price)
    m.map("PriceChanged").as_update_of(KEY).using(price=lambda e, c: e.price)
    m.map("Cleared").as_update_of(KEY).using(category=F.lit(None))
    assert state(m.build(), rows) == {"a": (None, 2.0)}


def test_builder_is_closed_after_build(spark):
    m = catalogue()
    a = m.map("Added")
    a.as_create_of(KEY).using(**CATEGORY)
    m.build()
    for f in (lambda: m.map("x"), lambda: m.where(F.lit(True)), lambda: a.when(F.lit(True)), m.build):
        with pytest.raises(RuntimeError):
            f()
    with pytest.raises(TypeError):
        EventMapBuilder("x").map("Added").as_create_of(KEY)
    n = catalogue()
    n.map("Added").as_create_of(KEY).using(nothing=F.lit(1))
    with pytest.raises(ValueError, match="no such fields"):
        n.build()
    with pytest.raises(ValueError):
        TypeRegistry({"a": "b", "b": "a"})


def test_random_ops_match_a_sequential_model(spark):
    rng = random.Random(3)
    events = [(rng.choice(["Added", "Touched", "Upserted", "Discontinued"]), f"k{rng.randrange(12)}", rng.choice(["x", "y", None]), float(rng.randrange(9))) for _ in range(600)]
    m = EventMapBuilder("p", "string", {"category": "string", "price": ("double", "sum")})
    m.map("Added").as_create_of(KEY).overwriting_duplicates().adding({**CATEGORY, "price": F.lit(0.0)})
    m.map("Touched").as_update_of(KEY).ignoring_misses().adding(price=lambda e, c: e.price)
    m.map("Upserted").as_update_of(KEY).creating_if_missing().using(**CATEGORY)
    m.map("Discontinued").as_delete_of(KEY).ignoring_misses()
    want: dict = {}
    for kind, key, category, price in events:
        if kind == "Added":
            want.setdefault(key, [None, 0.0])[:] = [category, 0.0]
        elif kind == "Touched" and key in want:
            want[key][1] += price
        elif kind == "Upserted":
            want.setdefault(key, [None, 0.0])[0] = category
        elif kind == "Discontinued":
            want.pop(key, None)
    plan, rows = m.build(), log(spark, events)
    assert state(plan, rows) == {k: tuple(v) for k, v in want.items()}
    split = Projector(plan, split_every=70).project(rows).state
    assert {r.key: (r.category, r.price) for r in split.collect()} == {k: tuple(v) for k, v in want.items()}
    # in two parts, the second on the snapshot of the first
    first = Projector(plan).project(rows.where("checkpoint <= 300")).state
    assert state(plan, rows.where("checkpoint > 300"), snapshots={"p": first}) == {k: tuple(v) for k, v in want.items()}


def test_children_errors_and_retries(spark):
    rows = log(spark, [("Added", "a", "x", None), ("Added", "a", "y", None), ("PriceChanged", "z", None, 1.0)])
    child = EventMapBuilder("child", "string", {"category": "string"})
    child.map("Added").as_create_of(KEY).using(**CATEGORY)
    parent = EventMapBuilder("parent", "string", {"category": "string"})
    parent.map("Added").as_create_of(KEY).overwriting_duplicates().using(**CATEGORY)
    attempts = []
    p = Projector(parent.build(), [Projector(child.build())], should_retry=lambda error, n: attempts.append(n) or n < 3)
    with pytest.raises(ProjectionError) as e:
        p.project(rows)
    assert attempts == [1, 2, 3] and e.value.child == "child" and e.value.projector == "parent"
    found = p.project(rows, on_error="cut")
    assert [(r.key, r.category) for r in found.state.collect()] == [("a", "x")]  # the child's error also stops the parent
    with pytest.raises(ValueError):
        Projector(None)


def test_custom_actions(spark):
    m = EventMapBuilder("actions")
    m.map("Discontinued").as_action("archive")
    seen = []
    Projector(m.build(), actions={"archive": lambda df: seen.extend(r.body.key for r in df.collect())}).project(log(spark, [("Discontinued", "c350E", None, None), ("Added", "x", None, None)]))
    assert seen == ["c350E"]


def test_as_of_ends_with_a_deletion(spark):
    left = spark.createDataFrame([(1, "a"), (3, "a"), (6, "a")], "t long, k string")
    right = spark.createDataFrame([(2, "a", "x"), (3, "a", "y"), (5, "a", None)], "t long, k string, v string")
    assert sorted((r.t, r.v) for r in as_of(left, right, "k", ["t"], ["v"]).collect()) == [(1, None), (3, "y"), (6, None)]


def test_empty_log(spark):
    m = catalogue()
    m.map("Added").as_create_of(KEY).using(**CATEGORY)
    assert state(m.build(), log(spark, []).limit(0)) == {}
    assert fold.ORDER[0] == "checkpoint" and datetime


def test_foreign_errors_are_wrapped(spark):
    rows = log(spark, [("Discontinued", "a", None, None), ("Discontinued", "b", None, None)])
    m, parent = EventMapBuilder("inner"), EventMapBuilder("outer")
    m.map("Discontinued").as_action("fails")
    parent.map("Discontinued").as_action("fine")

    def fails(events):
        raise OSError("disk")

    with pytest.raises(ProjectionError, match="failed to project") as e:
        Projector(parent.build(), [Projector(m.build(), actions={"fails": fails})]).project(rows)
    assert isinstance(e.value.__cause__, OSError) and (e.value.projector, e.value.child, e.value.batch) == ("outer", "inner", (1, 2))
    e.value.transaction_id = "7"
    e.value.transaction_id = "7"
    for name in ("transaction_id", "projector", "batch"):
        with pytest.raises(RuntimeError, match="already set"):
            setattr(e.value, name, "other")


def test_every_named_action_is_served(spark):
    m = EventMapBuilder("actions")
    m.map("Discontinued").as_action("archive")
    with pytest.raises(ValueError, match="archive"):
        Projector(m.build(), actions={"other": print})


def test_general_fold_keeps_nulls_and_large_numbers(spark):
    big = (1 << 60) + 1
    rows = [(k, n, 0, 0, v) for n, (k, v) in enumerate([(big, 1), (None, None), (big, None), (None, big), (big - 1, 5)])]
    ops = spark.createDataFrame(rows, "key long, checkpoint long, event_seq int, rule_seq int, v long").repartition(2)
    found = fold.fold_rows(ops, lambda row, op: {"vs": [*(row or {"vs": []})["vs"], op["v"]]}, "key long, vs array<long>")
    assert {r.key: r.vs for r in found.collect()} == {big: [1, None], None: [None, big], big - 1: [5]}
    nan = float("nan")
    floats = spark.createDataFrame([(x, n, 0, 0) for n, x in enumerate([nan, 1.0, nan, None])], "key double, checkpoint long, event_seq int, rule_seq int")
    assert sorted(r.n for r in fold.fold_rows(floats, lambda row, op: {"n": (row or {"n": 0})["n"] + 1}, "key double, n int").collect()) == [1, 1, 2]
