"""Chat formatting by event-sourced reconstruction.

A log of conversation events is partitioned by conversation and message, sorted by sequence, and folded: streamed
deltas append, edits and regenerations replace. The final messages, in order, are rendered by a template whose control
strings are escaped inside texts, so that the output can be read back. Both passes stream over sorted partitions: a
task holds one message, or one turn, at a time, however long a conversation is.

Events: conv_id, seq, part, kind, message, role, text. (seq, part) is the order of a conversation's events; ``part``
numbers what came under one seq and may be left out. Kinds: ``message`` starts a message at its place, ``delta``
appends to it, ``edit`` and ``regenerate`` replace its text (a regeneration starts anew, deltas after it append to it),
``delete`` removes it. ``message`` tells messages of a conversation apart; null means the event's own seq. Events of a
message that never began are ignored. A null text is empty, a null role is the empty role, a null kind is ``message``.
Events of one kind at one place run in order of role and text, and each ``message`` starts a message. Messages that
began at one seq are turns in order of role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the template uses to mark turns. Inside texts and roles, a backslash goes after the first character of each.
CONTROL = r"/?s>|/?INST\]|/?OUT\]|/?ROLE[ \]]"
_ESCAPE = re.compile(rf"([<\[])(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[OUT\] (?P<assistant>.*?)</s>|\[ROLE (?P<role>.*?)\]\n(?P<other>.*?) \[/ROLE\]", re.S)


def escape(text: str) -> str:
    """``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``: no control string is left, and it can be undone."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render_turn(role: str, text: str) -> str:
    if role == "user":
        return f"<s>[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f"[OUT] {escape(text)}</s>"
    name = role.replace("%", "%25").replace("]", "%5D")
    return f"[ROLE {escape(name)}]\n{escape(text)} [/ROLE]"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in ``formatted``."""
    out = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        role = unescape(m["role"]).replace("%5D", "]").replace("%25", "%") if kind == "other" else kind
        out.append((role, unescape(m[kind]), m.start(kind), m.end(kind)))
    return out


_MESSAGE = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, message, sequence: the final text of each message."""
    key, place, role, parts = None, None, None, None
    done: list[tuple] = []

    def close() -> None:
        if parts is not None:
            done.append((key[0], place, role, "".join(parts)))

    for batch in batches:
        for conv, message, seq, kind, who, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "seq", "kind", "role", "text")), strict=True):
            if kind == "message" or (conv, message) != key:
                close()
                key, place, role, parts = (conv, message), seq, who, None
            if kind == "message":
                parts = [text]
            elif parts is None:
                continue
            elif kind == "delta":
                parts.append(text)
            elif kind in ("edit", "regenerate"):
                parts = [text]
            elif kind == "delete":
                parts = None
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE)


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of each message that the log leaves; its place is the seq at which it began. An empty log leaves none."""
    seq = F.col("seq").cast("long")
    part = F.coalesce(F.col("part").cast("long"), F.lit(0)) if "part" in events.columns else F.lit(0).cast("long")
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), seq.alias("seq"), part.alias("part"), F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce(F.col("message").cast("long"), seq).alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    first = F.when(F.col("kind") == "message", 0).otherwise(1)
    return log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "part", first, "role", "text").mapInArrow(_fold, "conv_id long, place long, role string, text string")


def in_order(messages: DataFrame) -> DataFrame:
    """Each conversation in one partition, its messages in order."""
    return messages.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, formatted): the rendered turn beside each message; a conversation's turns, joined in order, are its text."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "formatted"])

    return messages.select("conv_id", "place", "role", "text").mapInArrow(turns, "conv_id long, place long, role string, text string, formatted string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the formatted turns back; the state of a conversation is two running hashes and three counts."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    began, conv, state, done = False, None, None, []

    def close() -> None:
        if began:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        for cid, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if not began or cid != conv:
                close()
                began, conv, state = True, cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(formatted)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def digests(rendered: DataFrame) -> DataFrame:
    """A row for each conversation of ``render(in_order(...))``, read back from the formatted turns; rows of a null conv_id are one conversation."""
    return rendered.select("conv_id", "formatted").mapInArrow(_digest, _DIGEST)


#: Code points of a streamed delta.
DELTA = 256


def as_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log that leads to rows (conv_id, turn, role, text), null texts as empty ones; repeated rows are messages each.

    An assistant's turn is streamed: a first answer in one delta, its regeneration, and then the text in deltas of
    ``delta`` code points. Any other turn begins as a draft, which an edit replaces by the text.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.concat(F.lit("Draft: "), F.substring("text", 1, delta))
    streamed = F.concat(F.array(event("message", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))), F.transform(pieces, lambda p: event("delta", p)))
    edited = F.array(event("message", draft), event("edit", F.col("text")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("message"), "role", text.alias("text"))
    return rows.select("conv_id", "seq", "message", "role", F.posexplode(F.when(F.col("role").eqNullSafe(F.lit("assistant")), streamed).otherwise(edited)).alias("part", "e")).select("conv_id", "seq", "part", "e.kind", "message", "role", "e.text")


def op3_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own control strings, each from its log of events.

    An empty table leaves conversation -7 alone.
    """
    probe = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(render(in_order(final_messages(as_events(rows.unionByName(own))))))


QUERIES = {"op3_chat_events": op3_chat_events}
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|/?OUT\]|/?ROLE[ \]])', '\1\\\2\3', 'g')"
SQL = {
    "op3_chat_events": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('[OUT] </s>')
      ELSE length('[ROLE ]') + 1 + length(' [/ROLE]') + length({_ESCAPED.format("replace(replace(role, '%', '%25'), ']', '%5D')")}) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
}
