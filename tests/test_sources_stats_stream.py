"""Logs, statistics, the document example and streams."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foldspark.functions import stats
from foldspark.operators.projector import Projector
from foldspark.plans import documents
from foldspark.plans.event_map import EventMapBuilder
from foldspark.sources import log as logs
from foldspark.streaming.dispatcher import Dispatcher, Info, Resolution, SnapshotStore, SubscriptionOptions


def test_store_appends_and_assigns(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    assert store.write(logs.Transaction([("A", {"x": 1}), ("B", {})]), logs.Transaction([("A", {})], checkpoint=999)) == 999
    assert store.write_events(("C", {})) == 1000
    assert store.write_with_headers(("D", {}), {"user": "Pavel"}) == 1001
    rows = store.read().orderBy("checkpoint", "event_seq").collect()
    assert [(r.checkpoint, r.event_seq, r.transaction_id) for r in rows] == [(1, 0, "1"), (1, 1, "1"), (999, 0, "999"), (1000, 0, "1000"), (1001, 0, "1001")]
    assert rows[-1].event_headers == {"user": "Pavel"} and rows[-1].transaction_headers == {}
    assert store.read(999).count() == 2
    assert logs.is_ahead(store.read(), 1002) and not logs.is_ahead(store.read(), 1001) and not logs.is_ahead(store.read(), None)
    assert logs.LogStore(spark, str(tmp_path / "log")).write_events(("E", {})) == 1002


def test_batches(spark):
    df = logs.make_log(spark.range(25), checkpoint=F.col("id") * 7_000 + 1, event_type=F.lit("x"), body=F.lit(None).cast("string"))
    assert sorted(r["count"] for r in logs.in_batches(df, 10).groupBy("batch_id").count().collect()) == [5, 10, 10]
    with pytest.raises(ValueError):
        logs.in_batches(df, 0)


def test_json_zip(spark, tmp_path):
    lines = "\n".join(json.dumps({"$type": "Some.Names.CountryRegisteredEvent, Assembly", "Code": str(n)}) for n in range(20))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("events.json", lines)
        z.writestr("more.json", lines)
    rows = logs.read_json_zip(spark, str(tmp_path / "e.zip"), page_size=2).orderBy("checkpoint", "event_seq").collect()
    assert len(rows) == 20 and rows[0].event_type == "CountryRegisteredEvent"
    assert sorted({r.checkpoint for r in rows}) == [1, 2, 4, 5]  # a number is skipped between pages


def progress(spark, points):
    rows = [("p", n, datetime(2020, 1, 1) + timedelta(seconds=t), c) for n, (t, c) in enumerate(points)]
    return spark.createDataFrame(rows, "projector_id string, seq long, ts timestamp, checkpoint long")


def climb(rates):
    out, c = [], 0
    for n, r in enumerate(rates):
        c += r
        out.append((n, c))
    return out


@pytest.mark.parametrize(
    ("points", "speed", "tolerance"),
    [
        (climb([1000] * 60), 1000, 0.01),
        (climb([1000 + 100 * n for n in range(60)]), 4550, 0.5),
        (climb([1000 - 10 * n for n in range(60)]), 645, 0.5),
        (climb([1000] * 600 + [2000] * 540 + [3000] * 60), 2222.5022, 1),
        ([(5 * n, n + 1) for n in range(12)], 0.2, 1e-6),
        ([(0, 1000), (120, 10000)], 75, 0.01),
    ],
)
def test_speed(spark, points, speed, tolerance):
    assert abs(stats.speeds(progress(spark, points)).first().speed - speed) <= tolerance


def test_eta_and_views(spark):
    p = progress(spark, climb([1000] * 60))
    assert stats.time_to_reach(p, 100_000).first().eta_seconds == 40
    assert stats.time_to_reach(p, 5).first().eta_seconds == 0
    one = progress(spark, [(0, 10)])
    assert stats.speeds(one).first().speed is None and stats.time_to_reach(one, 100).first().eta_seconds is None
    flat = progress(spark, [(0, 10), (100, 10)])
    assert stats.time_to_reach(flat, 100).first().eta_seconds is None
    props = spark.createDataFrame([("p", 1, datetime(2020, 1, 1), "n", "a"), ("p", 2, datetime(2020, 1, 2), "n", "b")], "projector_id string, seq long, ts timestamp, name string, value string")
    assert [(r.name, r.value) for r in stats.last_properties(props).collect()] == [("n", "b")]
    assert stats.detail(p, props, "p").first().properties[0].value == "b"
    unknown = stats.detail(p, props, "q").first()
    assert unknown.last_checkpoint == 0 and unknown.properties == []
    assert stats.summary(p, "/stats").first().url == "/stats/p"
    parts = spark.range(1).select(stats.eta_parts(F.lit(93784)).alias("x")).first().x
    assert (parts.days, parts.hours, parts.minutes, parts.seconds) == (1, 2, 3, 4)


def test_document_register(spark):
    d = lambda n: datetime(2020, 1, n)
    events = [
        ("WarrantAssignedEvent", {"Number": "w", "Kind": "k", "Country": "nl", "InitialState": "Active"}),
        ("LicenseGrantedEvent", {"Number": "l", "Kind": "k", "Country": "xx", "InitialState": "Open"}),
        ("ValidityPeriodPlannedEvent", {"DocumentNumber": "w", "Sequence": 1, "From": d(1), "To": d(5)}),
        ("ValidityPeriodPlannedEvent", {"DocumentNumber": "w", "Sequence": 2, "From": d(5), "To": d(9)}),
        ("ValidityPeriodApprovedEvent", {"DocumentNumber": "w", "Sequence": 1}),
        ("ValidityPeriodApprovedEvent", {"DocumentNumber": "w", "Sequence": 2}),
        ("StateTransitionedEvent", {"DocumentNumber": "l", "State": "Closed"}),
        ("AreaRestrictedEvent", {"DocumentNumber": "l", "Area": "north"}),
        ("AreaRestrictionCancelledEvent", {"DocumentNumber": "l"}),
    ]
    rows = spark.createDataFrame([(n + 1, t, json.dumps(b, default=lambda x: x.isoformat())) for n, (t, b) in enumerate(events)], "n long, t string, b string")
    log = logs.make_log(rows, checkpoint=F.col("n"), event_type=F.col("t"), body=F.from_json("b", documents.BODY))
    found = {r.key: r for r in documents.register(log, d(7)).collect()}
    assert found["w"].state == "Active" and found["w"].starts == d(1) and found["w"].ends == d(9)
    assert {r.key: r.state for r in documents.register(log, d(10)).collect()}["w"] == "Revalidate"
    assert found["l"].state == "Open" and found["l"].type == "Audit" and found["l"].area is None
    lookup = spark.createDataFrame([("nl", "Netherlands"), ("xx", "Nowhere")], "key string, name string")
    counts = documents.counts_per_state(documents.register(log, d(7)), lookup)
    assert {(r.country_name, r.state, r["count"]) for r in counts.collect()} == {("Netherlands", "Active", 1), ("Nowhere", "Open", 1)}
    for bad in (lookup.where("key = 'nl'"), lookup.unionByName(lookup)):
        with pytest.raises(LookupError):
            documents.counts_per_state(documents.register(log, d(7)), bad)


def register_log(spark, events):
    rows = spark.createDataFrame([(n + 1, t, json.dumps(b, default=lambda x: x.isoformat())) for n, (t, b) in enumerate(events)], "n long, t string, b string")
    return logs.make_log(rows, checkpoint=F.col("n"), event_type=F.col("t"), body=F.from_json("b", documents.BODY))


def test_validity_is_what_the_last_approval_saw(spark):
    d = lambda n: datetime(2020, 1, n)
    period = lambda n, **more: {"DocumentNumber": "w", "Sequence": n, **more}
    made = ("WarrantAssignedEvent", {"Number": "w", "Kind": "k", "Country": "nl", "InitialState": "Active"})
    events = [
        made, ("ValidityPeriodPlannedEvent", period(1, From=d(1), To=d(5))), ("ValidityPeriodPlannedEvent", period(2, From=d(5), To=d(9))), ("ValidityPeriodApprovedEvent", period(1)),
        ("ValidityPeriodApprovedEvent", period(2)), ("ValidityPeriodClosedEvent", period(2, ClosedAt=d(7))), ("ValidityPeriodResetEvent", period(1)), ("CountryRegisteredEvent", {"Code": "nl", "Name": "Netherlands"}),
    ]
    one = documents.register(register_log(spark, events)).first()
    # closing and resetting later leave the document's dates, a reset clears the period's and leaves its status
    assert (one.starts, one.ends, one.country_name) == (d(1), d(9), "")
    assert [(p["sequence"], p["from"], p["to"], p.status) for p in one.periods] == [(1, None, None, "Valid"), (2, d(5), d(7), "Closed")]
    again = documents.register(register_log(spark, [*events, ("DocumentArchivedEvent", {"DocumentNumber": "w"}), made])).first()
    assert (again.starts, again.periods, again.country_name) == (None, [], "Netherlands")


def test_folder_of_zips(spark, tmp_path):
    for name, n in (("b", 7), ("a", 5)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("e.json", "\n".join(json.dumps({"$type": "N.E, A", "Code": f"{name}{i}"}) for i in range(n)))
    log = logs.read_json_zip(spark, str(tmp_path / "*.zip"), page_size=2, per_transaction=2)
    rows = [(r.checkpoint, r.event_seq, json.loads(r.body)["Code"]) for r in log.orderBy("checkpoint", "event_seq").collect()]
    assert [r[2] for r in rows] == [*(f"a{i}" for i in range(5)), *(f"b{i}" for i in range(7))] and len({r[:2] for r in rows}) == 12
    assert sorted({r[0] for r in rows}) == [1, 2, 4, 7, 8, 10, 11]


def test_checkpoints_over_many_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(logs, "RANGE_ROWS", 7)
    rng = random.Random(2)
    for explicit in (0.0, 0.1, 0.9):
        rows = [(n * n, rng.randrange(1000) if rng.random() < explicit else rng.choice([-1, None])) for n in range(120)]
        want, last = [], 50
        for n, c in rows:
            last = last + 1 if c in (-1, None) else c
            want.append((n, last))
        found = logs.assign_checkpoints(spark.createDataFrame(rows, "n long, checkpoint long").repartition(3), "n", 50)
        assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["n", "checkpoint"]
    assert logs.assign_checkpoints(spark.createDataFrame([], "n long, checkpoint long"), "n").count() == 0


def test_eta_parts_are_cut_towards_zero(spark):
    parts = lambda n: tuple(spark.range(1).select(stats.eta_parts(F.lit(n)).alias("x")).first().x)
    assert parts(-1) == (0, 0, 0, -1, 0) and parts(-3661) == (0, -1, -1, -1, 0) and parts(-90061) == (-1, -1, -1, -1, 0) and parts(None) == (None, None, None, None, 0)


def test_speed_of_gaps_and_a_restored_projector(spark):
    points = [("p", n, datetime(2020, 1, 1) + timedelta(seconds=t), c) for n, (t, c) in enumerate([(0, 0), (100, 1000), (50, 7), (101, 1001), (300, 3000)])] + [("p", 9, None, 5), ("p", 10, datetime(2020, 1, 2), None), ("q", 0, None, None)]
    found = {r.projector_id: r.speed for r in stats.speeds(spark.createDataFrame(points, "projector_id string, seq long, ts timestamp, checkpoint long")).collect()}
    assert abs(found["p"] - 10) < 0.01 and found["q"] is None
    t = datetime(2020, 1, 1)
    props, events = spark.createDataFrame([("n", "a", t)], "name string, value string, ts timestamp"), spark.createDataFrame([("first", t), ("second", t + timedelta(seconds=1))], "body string, ts timestamp")
    progress, own, log = stats.restored("p", props, events)
    assert stats.last_properties(own).first().value == "a" and [r.body for r in stats.events(log, "p").collect()] == ["first", "second"] and progress.count() == 0
    later = own.unionByName(spark.createDataFrame([("p", 1, t, "n", "b")], "projector_id string, seq long, ts timestamp, name string, value string"))
    assert stats.last_properties(later).first().value == "b"


def users():
    m = EventMapBuilder("users", "string", {"n": ("bigint", "count")})
    m.map("up").as_create_of(lambda e, c: c.stream_id).adding(n=F.lit(1))
    return Projector(m.build())


def dispatcher(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "log"))
    return store, Dispatcher(lambda o: store.stream(**o), store.read), SnapshotStore(spark, str(tmp_path / "state"))


def test_stream_resumes_and_ignores(spark, tmp_path):
    store, d, snapshots = dispatcher(spark, tmp_path)
    store.write(logs.Transaction([("up", {})], stream_id="a"))
    asked, ok = [], []
    options = SubscriptionOptions(exception_handler=lambda e, n, i: asked.append(n) or (Resolution.RETRY if n < 2 else Resolution.IGNORE), success_handler=ok.append)
    d.subscribe(users(), snapshots, str(tmp_path / "cp"), options=options).awaitTermination()
    assert len(ok) == 1
    store.write(logs.Transaction([("up", {})], stream_id="b"), logs.Transaction([("up", {})], stream_id="a"), logs.Transaction([("up", {})], stream_id="c"))
    d.subscribe(users(), snapshots, str(tmp_path / "cp"), options=options).awaitTermination()
    assert asked == [1, 2] and {r.key for r in snapshots.read("users").collect()} == {"a", "b"}  # the rest of the batch is dropped


def test_stream_aborts_and_restarts(spark, tmp_path):
    store, d, snapshots = dispatcher(spark, tmp_path)
    store.write(logs.Transaction([("up", {})], stream_id="a", checkpoint=1), logs.Transaction([("up", {})], stream_id="a", checkpoint=999))
    q = d.subscribe(users(), snapshots, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="already exists"):
        q.awaitTermination()
    assert snapshots.read("users") is None
    trace = []
    again = SubscriptionOptions(restart_when_ahead=True, before_restarting=lambda i: trace.append(i.id), exception_handler=lambda e, n, i: Resolution.IGNORE)
    d.subscribe(users(), snapshots, str(tmp_path / "cp2"), from_checkpoint=1000, options=again).awaitTermination()
    assert trace == ["projection"] and snapshots.read("users").count() == 1

    def fails(info: Info):
        raise RuntimeError("no")

    for _ in range(2):  # every restart replays the log, also in the same progress folder
        d.subscribe(users(), snapshots, str(tmp_path / "cp2"), from_checkpoint=1000, options=again).awaitTermination()
        assert snapshots.read("users").count() == 1
    store.write(logs.Transaction([("up", {})], stream_id="b", checkpoint=1001))
    assert d.handled["projection"] == 999
    d.subscribe(users(), snapshots, str(tmp_path / "cp2"), options=again).awaitTermination()  # goes on after the last restart
    assert snapshots.count("users") == 2 and d.handled["projection"] == 1001
    stop = SubscriptionOptions(restart_when_ahead=True, before_restarting=fails)
    assert d.subscribe(users(), snapshots, str(tmp_path / "cp3"), from_checkpoint=2000, options=stop) is None


def test_ahead_without_a_restart_and_a_handler_that_throws(spark, tmp_path):
    store, d, snapshots = dispatcher(spark, tmp_path)
    store.write(logs.Transaction([("up", {})], stream_id="a"), logs.Transaction([("up", {})], stream_id="a"))
    d.subscribe(users(), snapshots, str(tmp_path / "cp"), from_checkpoint=1000).awaitTermination()  # waits for what is beyond
    assert snapshots.count("users") == 0 and not d.handled.get("projection")

    def handler(error, attempts, info):
        raise OSError(f"handler of {info.id}")

    query = d.subscribe(users(), snapshots, str(tmp_path / "cp2"), options=SubscriptionOptions(id="throws", exception_handler=handler))
    with pytest.raises(Exception, match="handler of throws"):
        query.awaitTermination()
    null = logs.make_log(spark.range(2), checkpoint=F.col("id") + 1, event_type=F.when(F.col("id") == 1, "up"), body=F.lit(None).cast("string"), stream_id=F.lit("x"))
    assert [r.key for r in users().project(null).state.collect()] == ["x"]  # an event without a type has no handler


def test_waiting_for_growth_and_for_a_checkpoint(spark, tmp_path):
    store, d, snapshots = dispatcher(spark, tmp_path)
    assert store.last() == 0 and not store.wait_for_growth(0, timeout=0)
    store.write(logs.Transaction([("up", {})], stream_id="a"))
    assert store.wait_for_growth(0, timeout=0)
    query = d.subscribe(users(), snapshots, str(tmp_path / "cp"), options=SubscriptionOptions(id="waits"), available_now=False)
    assert d.wait_until_checkpoint(query, 1, timeout=60) and not d.wait_until_checkpoint(query, 2, timeout=0)
    store.write(logs.Transaction([("up", {})], stream_id="b"))
    assert d.wait_until_checkpoint(query, 2, timeout=60) and snapshots.find("users", "b").n == 1 and snapshots.find("users", "c") is None
    store.write(logs.Transaction([("up", {})], stream_id="b"))
    with pytest.raises(Exception, match="already exists"):
        d.wait_until_checkpoint(query, 3, timeout=60)


def test_repository(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, n long")
    store.remove_by_key("users", "a")
    assert store.count("users") == 0
    store.add_range("users", rows)
    with pytest.raises(ValueError):
        store.add_range("users", rows.where("n = 1"))
    store.remove_by_key("users", None)
    store.remove_by_key("users", "not there")
    assert store.count("users") == 2 and store.find("users", None) is None and store.find("users", "b").n == 2
    store.write("users", 1, rows)
    assert store.count("users") == 3 and store.read("users", before=1).count() == 2
    store.clear("users")
    assert store.read("users") is None
