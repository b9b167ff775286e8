import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from foldspark.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE ", "[/ROLE]", "\\", "<\\/s>", "<", "[", "]", " ", "\n", "%", "é", "a", "/s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    formatted = "".join(chat.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns
    for r, t, a, b in chat.parse(formatted):
        assert chat.unescape(formatted[a:b]) == t
        assert not any(c in formatted[a:b] for c in ("</s>", "[INST]", "[/INST]", "<s>", "[OUT]", "[/ROLE]"))


SCHEMA = "conv_id long, seq long, kind string, message long, role string, text string, formatted string"


def messages(spark, rows):
    found = chat.final_messages(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    return sorted(((r.conv_id, r.place, r.role, r.text) for r in found), key=repr)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", None), (1, 4, "delta", 2, "assistant", "b"), (1, 3, "delta", 2, "assistant", "a"),
        (1, 5, "edit", 1, "user", "hello"), (1, 6, "regenerate", 2, "assistant", ""), (1, 7, "delta", 2, "assistant", "new"), (1, 8, "delta", 99, "assistant", "lost"),
        (1, 9, "message", None, "user", "gone"), (1, 10, "delete", 9, None, None), (2, 1, None, None, None, None), (None, 1, "message", None, "user", "x"),
    ]
    assert messages(spark, rows) == sorted([(1, 1, "user", "hello"), (1, 2, "assistant", "new"), (2, 1, "", ""), (None, 1, "user", "x")], key=repr)


def test_digests_match_brute_force(spark):
    rows = [(i % 5, t, "message", None, "assistant" if t % 2 else "user", None if t == 3 else f"</s> {i} é" * (t % 4)) for i in range(40) for t in range(4)] + [(7, 1, "message", None, "user", "same")] * 3
    found = {r.conv_id: r for r in chat.digests(chat.render(chat.in_order(chat.final_messages(spark.createDataFrame([(*r, None) for r in rows], SCHEMA))))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[4], r[5] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat.render_turn(r, t)) for _, r, t in own))
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == want


def test_empty_log(spark):
    assert chat.digests(chat.render(chat.in_order(chat.final_messages(spark.createDataFrame([], SCHEMA))))).count() == 0
    assert chat.as_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


TABLE = "conv_id long, turn long, role string, text string, seq string, part string, message string"


def conversations(spark):
    """Nulls, ties, repeated rows, control strings, a very long text of two-unit code points, columns named like the log's."""
    long = "\U0001f600 </s>\n" * 40_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 1000), (1, 1, "assistant", "b"), (2, 0, None, "x"), (2, None, "assistant", ""), (None, 0, "assistant", "[INST] \\ [/INST]"), (3, 0, "assistant", long), (3, 0, "assistant", long), (3, 1, "user", long)]
    return rows, spark.createDataFrame([(*r, "s", "p", "m") for r in rows], TABLE).repartition(3)


def test_logs_lead_back_to_their_rows(spark):
    rows, table = conversations(spark)
    events = chat.as_events(table, 100)
    assert {r.kind: r.n > 0 for r in events.groupBy("kind").agg({"*": "count"}).toDF("kind", "n").collect()} == dict.fromkeys(("message", "delta", "edit", "regenerate"), True)
    found = Counter((r.conv_id, r.place, r.role, r.text) for r in chat.final_messages(events).collect())
    assert found == Counter((c, t, r or "", x or "") for c, t, r, x in rows)


def test_the_fold_decides_the_result(spark):
    """Without any one kind of event, or with deltas out of order, other texts come out."""
    rows, table = conversations(spark)
    events = chat.as_events(table, 100).cache()
    want = Counter((r.conv_id, r.place, r.role, r.text) for r in chat.final_messages(events).collect())
    for change in (events.where("kind <> 'edit'"), events.where("kind <> 'regenerate'"), events.where("kind <> 'delta'"), events.withColumn("part", -events["part"])):
        assert Counter((r.conv_id, r.place, r.role, r.text) for r in chat.final_messages(change).collect()) != want


def test_many_deltas_take_time_in_proportion():
    import time

    import pyarrow as pa

    def seconds(n):
        batch = pa.RecordBatch.from_pydict({"conv_id": [1] * n, "message": [1] * n, "seq": [0] * n, "kind": ["message"] + ["delta"] * (n - 1), "role": ["assistant"] * n, "text": ["ab"] * n})
        began = time.process_time()
        assert [b.column("text")[0].as_py() for b in chat._fold(iter([batch]))] == ["ab" * n]
        return time.process_time() - began

    seconds(1000)
    assert seconds(160_000) < 40 * seconds(20_000) + 0.2
