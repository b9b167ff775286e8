"""States in buckets: what versions write, what readers see, and what is swept."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from foldspark.operators.projector import Projector
from foldspark.plans.event_map import EventMapBuilder
from foldspark.sources import log as logs
from foldspark.sources.tables import shared_folder
from foldspark.streaming.dispatcher import Dispatcher, SubscriptionOptions
from foldspark.streaming.store import SnapshotStore


def files(path, name="s", version="*"):
    return sorted(f.split(f"/{name}/")[1] for f in glob.glob(f"{path}/{name}/v={version}/part=*/*.parquet"))


def contents(state):
    return {} if state is None else {r.key: r.n for r in state.collect()}


def test_one_key_writes_one_bucket(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), buckets=8)
    store.write("s", 0, spark.range(200).select(F.col("id").alias("key"), (F.col("id") * 2).alias("n")))
    assert len(files(tmp_path)) == 8 and store.count("s") == 200
    store.remove_by_key("s", 7)
    (only,) = files(tmp_path, version="0.1")
    assert only.split("/")[1].endswith("-delta") and store.count("s") == 199 and store.find("s", 7) is None
    store.remove_by_key("s", 7)  # not there any more: nothing is written
    assert store.versions("s") == [(0, 0), (0, 1)]
    store.add_range("s", spark.createDataFrame([(7, 1)], "key long, n long"))
    assert store.find("s", 7).n == 1 and len(files(tmp_path, version="0.2")) == 1
    plan = store.read("s", keys=spark.createDataFrame([(7,)], "key long"))._jdf.queryExecution().toString()
    assert "part=" in plan or len(store.read("s", keys=spark.createDataFrame([(7,)], "key long")).inputFiles()) == 3


def test_versions_against_a_model(spark, tmp_path):
    rng, model, past = random.Random(5), {}, {}
    store = SnapshotStore(spark, str(tmp_path), buckets=4, max_deltas=2)
    for batch in range(9):
        past[batch] = dict(model)
        changes = {rng.randrange(30): rng.choice([None, rng.randrange(100)]) for _ in range(8)}
        rows = [(k, v, v is not None) for k, v in changes.items()]
        for _ in range(1 + (batch == 4)):  # a batch that runs again
            store.apply("s", batch, spark.createDataFrame(rows, "key long, n long, exists boolean"))
        model |= {k: v for k, v in changes.items() if v is not None}
        model = {k: v for k, v in model.items() if changes.get(k, 0) is not None}
        assert contents(store.read("s")) == model
        assert contents(store.read("s", before=batch)) == past[batch]
        live = store._live("s", store._finished("s"), (batch, 0))
        assert all(len(b.folders) <= 4 for b in live.values())  # at most two changes more than the limit before a bucket is whole again
    assert any("-full" in f for f in files(tmp_path)) and min(store.batches("s")) > 0
    wanted = spark.createDataFrame([(k,) for k in range(0, 30, 3)] + [(99,)], "key long")
    assert contents(store.read("s", keys=wanted)) == {k: v for k, v in model.items() if k % 3 == 0}
    store.write("s", 9, spark.createDataFrame([(1, 1)], "key long, n long"))
    assert contents(store.read("s")) == {1: 1} and contents(store.read("s", before=9)) == model
    store.write("s", 10, spark.createDataFrame([], "key long, n long"))
    assert contents(store.read("s")) == {} and store.read("s").columns == ["key", "n"]


def test_unfinished_versions_do_not_count(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.write("s", 0, spark.createDataFrame([("a", 1)], "key string, n long"))
    store.apply("s", 1, spark.createDataFrame([("a", 2, True)], "key string, n long, exists boolean"))
    (tmp_path / "s" / "v=1.0" / "_SUCCESS").unlink()
    assert contents(store.read("s")) == {"a": 1}


def plans():
    names = EventMapBuilder("names", "string", {"name": "string"})
    names.map("N").as_create_of(lambda e, c: e.key).overwriting_duplicates().using(name=lambda e, c: e.text)
    m = EventMapBuilder("users", "string", {"name": "string", "n": ("bigint", "count")})
    m.map("U").as_create_of(lambda e, c: e.key).overwriting_duplicates().adding({"name": lambda e, c: c.child("names", e.text).name}, n=F.lit(1))
    m.map("D").as_delete_of(lambda e, c: e.key).ignoring_misses()
    m.map("Never").as_create_of(lambda e, c: e.key).using(name=lambda e, c: F.lit("never"))  # a policy that throws: ops are written
    return Projector(m.build(), [Projector(names.build())])


@pytest.mark.parametrize("restart", [False, True])
def test_batches_read_and_write_their_keys_only(spark, tmp_path, restart):
    rng = random.Random(3)
    events = [(rng.choice("NUUD"), rng.choice("abcdef"), rng.choice("abc")) for _ in range(40)]
    schema = "n long, type string, key string, text string"
    as_log = lambda r: logs.make_log(r, checkpoint=F.col("n") + 1, event_type=F.col("type"), body=F.struct("key", "text"))
    store, folder = SnapshotStore(spark, str(tmp_path / "state"), buckets=4, max_deltas=1), str(tmp_path / "events")
    d = Dispatcher(lambda o: as_log(spark.readStream.schema(schema).options(**o).parquet(folder)), lambda: as_log(spark.read.parquet(folder)))
    handled, before = [], glob.glob(shared_folder(spark).removeprefix("file://") + "/*")
    options = SubscriptionOptions(id=f"keys-{restart}", success_handler=lambda i: handled.append(i.batch_id), reader_options={"maxFilesPerTrigger": "1"})
    for n in range(4):
        spark.createDataFrame([(10 * n + i, *e) for i, e in enumerate(events[10 * n : 10 * n + 10])], schema).coalesce(1).write.mode("append").parquet(folder)
        if restart or n == 3:
            d.subscribe(plans(), store, str(tmp_path / "cp"), options=options).awaitTermination()
    assert handled == [0, 1, 2, 3]
    left = glob.glob(shared_folder(spark).removeprefix("file://") + "/*")
    assert set(left) <= set(before), "a batch leaves no tables behind"
    whole = plans().project(as_log(spark.read.parquet(folder)))
    assert {tuple(r) for r in store.read("users").collect()} == {tuple(r) for r in whole.state.collect()}
    assert {tuple(r) for r in store.read("names").collect()} == {tuple(r) for r in whole.children["names"].state.collect()}


def test_the_logs_end_is_known_without_a_job(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    assert store.last() == 0
    for n in range(3):
        store.write(logs.Transaction([("A", {"n": n})]), logs.Transaction([("A", {})], checkpoint=100 * (n + 1)))
    context = spark.sparkContext
    context.setJobGroup("waits", "waits")
    try:
        assert store.last() == 300 and not store.wait_for_growth(300, timeout=0.3) and store.wait_for_growth(299, timeout=0)
        assert not context.statusTracker().getJobIdsForGroup("waits")
        rows = store.read(100)
        assert len(rows.inputFiles()) == 3 and rows.count() == 4 and rows.columns == logs.ENVELOPE
        assert "PartitionFilters: [isnotnull(upto" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_ranges_are_even_where_values_are_not(spark, monkeypatch):
    monkeypatch.setattr(logs, "RANGE_ROWS", 1000)
    n = F.col("id")
    rows = spark.range(40_000).select(F.when(n == 7, 10**15).otherwise(n * n % 1_000_003 + n).alias("checkpoint"))
    found = logs._in_ranges(rows, "checkpoint").groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("checkpoint").alias("a"), F.max("checkpoint").alias("b")).orderBy("_range").collect()
    assert len(found) >= 35 and max(r.n for r in found) < 2500
    assert all(x.b < y.a for x, y in zip(found, found[1:], strict=False))
    as_log = logs.make_log(rows.distinct(), checkpoint=F.col("checkpoint"), event_type=F.lit("x"), body=F.lit(None).cast("string"))
    sizes = logs.in_batches(as_log, 100).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in sizes)[1:] == [100] * (len(sizes) - 1)


def test_history_and_lookups_in_ranges_are_those_of_the_whole(spark):
    rng = random.Random(8)
    events = [(n, rng.choice("NNXUUU"), rng.choice(["hot"] * 4 + ["a", None]), rng.choice("pqr")) for n in range(300)]
    log = logs.make_log(spark.createDataFrame(events, "n long, type string, key string, text string"), checkpoint=F.col("n") + 1, event_type=F.col("type"), body=F.struct("key", "text"))

    def found(split):
        names = EventMapBuilder("names", "string", {"name": "string", "other": "string"})
        names.map("N").as_create_of(lambda e, c: e.key).overwriting_duplicates().using(name=lambda e, c: e.text)
        names.map("U").as_update_of(lambda e, c: e.key).ignoring_misses().using(other=lambda e, c: e.text)
        names.map("X").as_delete_of(lambda e, c: e.key).ignoring_misses()
        m = EventMapBuilder("seen", "bigint", {"name": "string", "other": "string", "there": "boolean"})
        read = lambda c, e: c.child("names", e.key)
        m.map("U").as_create_of(lambda e, c: c.checkpoint).using(name=lambda e, c: read(c, e).name, other=lambda e, c: read(c, e).other, there=lambda e, c: read(c, e).is_there())
        return sorted(map(tuple, Projector(m.build(), [Projector(names.build(), split_every=split)], split_every=split).project(log).state.collect()))

    assert found(17) == found(1) == found(None) and len(found(None)) > 100
