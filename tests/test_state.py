"""Keyed streaming state gives the rows of the batch fold."""

from pyspark.sql import functions as F

from foldspark.operators.projector import Projector
from foldspark.plans.event_map import EventMapBuilder
from foldspark.sources import log as logs
from foldspark.streaming.dispatcher import catch_up, has_subscription
from foldspark.streaming.state import stateful, stateful_history


def plan():
    m = EventMapBuilder("users", "string", {"last": "string", "total": ("bigint", "sum"), "n": ("bigint", "count")})
    key = lambda e, c: c.stream_id
    m.map("up").as_create_of(key).overwriting_duplicates().adding({"last": F.lit(None), "total": F.lit(0)}, n=F.lit(1))
    m.map("hit").as_update_of(key).ignoring_misses().adding({"last": lambda e, c: c.event_type}, total=lambda e, c: c.checkpoint)
    m.map("down").as_delete_of(key).ignoring_misses()
    return m.build()


def test_state_matches_the_batch_fold(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    kinds = ["up", "hit", "hit", "down", "hit", "up", "up", "hit"]
    write = lambda n: store.write(*(logs.Transaction([(kinds[(i * 7 + i // 3) % 8], {})], stream_id=f"k{i % 5}") for i in range(n)))
    write(30)
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.key] = (r.last, r.total, r.n) if r.exists else None

    stream = stateful(plan(), store.stream(maxFilesPerTrigger="1"))
    query = stream.writeStream.queryName("state").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
    catch_up(query)
    write(23)
    catch_up(query)
    assert has_subscription(spark, "state")
    query.stop()
    assert not has_subscription(spark, "state")
    want = {r.key: (r["last"], r.total, r.n) for r in Projector(plan()).project(store.read()).state.collect()}
    assert {k: v for k, v in seen.items() if v is not None} == want


def test_large_numbers_nulls_and_nan(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    m = EventMapBuilder("values", "bigint", {"n": "bigint", "x": "double", "sum": ("bigint", "sum")})
    big = 1 << 60
    key = F.when(F.col("stream_id") != "none", F.col("stream_id").cast("long") + big)
    m.map("set").as_create_of(lambda e, c: key).overwriting_duplicates().adding({"n": F.when(F.col("checkpoint") % 2 == 1, F.col("checkpoint") + big), "x": F.when(F.col("checkpoint") != 3, F.lit(float("nan")))}, sum=F.lit(big))
    store.write(*(logs.Transaction([("set", {})], stream_id=s) for s in ("1", "none", "3", "1")))
    found = {}
    query = stateful(m.build(), store.stream()).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, _: found.update({r.key: (r.n, r.x, r["sum"]) for r in batch.collect()})).start().awaitTermination()
    assert set(found) == {big + 1, None, big + 3}
    assert found[big + 3] == (big + 3, None, big) and found[big + 1][0] is None and found[big + 1][1] != found[big + 1][1] and found[big + 1][2] == 2 * big and found[None][0] is None


def test_history_and_initial_state_over_batches(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    kinds = ["up", "hit", "hit", "down", "hit", "up"]
    for _ in range(3):
        store.write(*(logs.Transaction([(kinds[(i * 5 + i // 4) % 6], {})], stream_id=f"k{i % 4}") for i in range(13)))
    before = spark.createDataFrame([("k1", "then", 100, 5), ("other", None, 1, 1)], "key string, last string, total long, n long")
    found = {}
    for name, stream in (
        ("rows", stateful(plan(), store.stream(maxFilesPerTrigger="1"), before)),
        ("changes", stateful_history(plan(), store.stream(maxFilesPerTrigger="1"), before, keep=2)),
    ):
        rows = []
        writer = stream.writeStream.outputMode("update" if name == "rows" else "append").option("checkpointLocation", str(tmp_path / name))
        writer.trigger(availableNow=True).foreachBatch(lambda b, n, rows=rows: rows.extend((n, r) for r in b.collect())).start().awaitTermination()
        found[name] = rows
    assert {n for n, _ in found["rows"]} == {0, 1, 2}
    want = {r.key: (r.last, r.total, r.n) for r in Projector(plan()).project(store.read(), {"users": before}).state.where("key <> 'other'").collect()}
    last = {r.key: (r.last, r.total, r.n) if r.exists else None for _, r in found["rows"]}
    assert {k: v for k, v in last.items() if v} == want
    ends, seen = {}, {}
    for _, r in sorted(found["changes"], key=lambda x: (x[1].checkpoint, x[1].event_seq)):
        assert [(p.checkpoint, p.exists, p.total) for p in r.past] == seen.get(r.key, [])[-2:]
        seen.setdefault(r.key, []).append((r.checkpoint, r.exists, r.total))
        ends[r.key] = (r.last, r.total, r.n) if r.exists else None
    assert {k: v for k, v in ends.items() if v} == want
