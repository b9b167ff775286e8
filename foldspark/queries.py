"""Registered queries over the driver's tables, and the same in ANSI SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldspark.functions import stats
from foldspark.operators import fold
from foldspark.operators.lookup import as_of, contiguous_chain, nest
from foldspark.operators.projector import Projector
from foldspark.plans import documents
from foldspark.plans.documents import counts_per_state as count_states
from foldspark.plans.documents import realtime_state as classify
from foldspark.plans.event_map import EventMapBuilder, ProjectionPlan
from foldspark.plans.types import TypeRegistry
from foldspark.sources import log as logs
from foldspark.sources.tables import shared_folder
from foldspark.sources.zipped import write_zips
from foldspark.streaming.dispatcher import Dispatcher, Info, Resolution, SubscriptionOptions, catch_up, has_subscription
from foldspark.streaming.store import SnapshotStore
from foldspark.streaming.state import stateful, stateful_history

QUERIES: dict = {}
SQL: dict[str, str] = {}
FIELDS = {"last_type": "string", "last_value": "double"}
#: click, view and purchase are activities, signup and error are of the life cycle; all are events.
TYPES = TypeRegistry({"click": "activity", "view": "activity", "purchase": "activity", "signup": "lifecycle", "error": "lifecycle"})
NOW = datetime(1997, 6, 15)
_USER = lambda e, c: e.user_id
_SET = {"last_type": lambda e, c: c.event_type, "last_value": lambda e, c: e.value}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _fold_sql(ops: str, select: str) -> str:
    """``ops``: SQL of (ord, key, op, accepts, policy, last_type, last_value, ...); ``select`` reads ``inc``."""
    return f"""
WITH ops AS ({ops}),
fixed AS (SELECT *, CASE WHEN op = 'create' THEN true WHEN op = 'update' AND accepts THEN true WHEN op = 'delete' THEN false END AS fixes FROM ops),
seen AS (SELECT *, coalesce(last_value(fixes IGNORE NULLS) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM fixed),
eff AS (SELECT *, CASE op WHEN 'create' THEN (NOT present OR accepts) WHEN 'update' THEN (present OR accepts) ELSE false END AS effective FROM seen),
inc AS (SELECT *, sum(CASE WHEN effective AND NOT present THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord ROWS UNBOUNDED PRECEDING) AS incarnation FROM eff),
alive AS (SELECT key, incarnation, arg_max(fixes, ord) FILTER (WHERE fixes IS NOT NULL) AS lives, arg_max(last_type, ord) FILTER (WHERE effective) AS last_type,
          arg_max(last_value, ord) FILTER (WHERE effective) AS last_value FROM inc WHERE incarnation > 0 GROUP BY key, incarnation)
{select}"""


def _ops_sql(create: str = "true", update: str = "false", kinds: str = "('click', 'view', 'purchase')") -> str:
    return f"""SELECT event_id AS ord, user_id AS key, CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN event_type = 'signup' THEN {create} WHEN event_type = 'error' THEN false ELSE {update} END AS accepts, event_type AS last_type, value AS last_value, value
    FROM events WHERE event_type IN ('signup', 'error') OR event_type IN {kinds}"""


_STATE = "SELECT key AS user_id, last_type, last_value FROM alive WHERE lives"


def _users(create: str = "overwriting", update: str = "ignoring", name: str = "users", fields: dict | None = None) -> EventMapBuilder:
    m = EventMapBuilder(name, "bigint", fields or FIELDS, TYPES)
    c = m.map("signup").as_create_of(_USER)
    {"overwriting": c.overwriting_duplicates, "ignoring": c.ignoring_duplicates, "throwing": lambda: c, "custom": lambda: c.handling_duplicates_using(lambda e, c: e.value > 50)}[create]()
    c.using(**_SET)
    for kind in ("click", "view", "purchase"):
        u = m.map(kind).as_update_of(_USER)
        {"ignoring": u.ignoring_misses, "creating": u.creating_if_missing, "throwing": u.throwing_if_missing, "custom": lambda u=u: u.handling_misses_using(lambda e, c: c.event_type == "purchase")}[update]()
        u.using(**_SET)
    return m


def _state(plan: ProjectionPlan, log: DataFrame) -> DataFrame:
    return Projector(plan).project(log).state.withColumnRenamed("key", "user_id")


def _deleting(m: EventMapBuilder) -> ProjectionPlan:
    m.map("error").as_delete_of(_USER).ignoring_misses()
    return m.build()


@query("SELECT event_id + 1 AS checkpoint, event_type FROM events WHERE event_id + 1 > 5000")
def log_scan_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is on the stored column, so that it reaches the scan."""
    return logs.events_after(spark, sf_dir, 5000).select("checkpoint", "event_type")


@query("SELECT event_id + 1 AS checkpoint, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 't' || CAST(event_id AS VARCHAR) END, ''), CAST(event_id + 1 AS VARCHAR)) AS transaction_id FROM events")
def log_default_transaction_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    own = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("t"), n.cast("string")))
    return logs.make_log(spark.read.parquet(f"{sf_dir}/events.parquet"), checkpoint=n + 1, event_type=F.col("event_type"), body=F.lit(None).cast("string"), own_id=own).select("checkpoint", "transaction_id")


@query("SELECT event_id + 1 AS checkpoint, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 10) AS BIGINT) AS batch_id FROM events")
def log_batches_of_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.in_batches(logs.events_log(spark, sf_dir), 10).select("checkpoint", "batch_id")


@query("""
WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id ELSE -1 END AS own, count(CASE WHEN event_id % 5 = 0 THEN 1 END) OVER (ORDER BY event_id) AS run FROM events)
SELECT event_id, CAST(max(own) OVER (PARTITION BY run) + row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS BIGINT) AS checkpoint FROM g""")
def log_assigned_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id")).otherwise(-1).alias("checkpoint"))
    return logs.assign_checkpoints(rows, "event_id").select("event_id", "checkpoint")


@query("""
WITH e AS (SELECT *, event_id // 3000 AS f, event_id % 3000 AS line FROM events), p AS (SELECT f, CAST(ceil(count(*) / 600.0) AS BIGINT) AS pages FROM e GROUP BY f),
b AS (SELECT f, coalesce(sum(pages) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page FROM p)
SELECT CAST((b.page + line // 600) * 101 + (line // 6) % 100 + 1 AS BIGINT) AS checkpoint, CAST(line % 6 AS INTEGER) AS event_seq, event_type, event_id FROM e JOIN b USING (f)""")
def log_from_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as zips of JSON lines, 3000 each, and read as a log by tasks of 100,000 bytes: pages begin anew with each file."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.concat(F.lit("Shop.Events."), F.col("event_type"), F.lit(", Shop"))
    text = F.to_json(F.struct(kind.alias("$type"), "event_id", "user_id", "value"))
    path = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}"
    write_zips(rows.select(F.floor(F.col("event_id") / 3000).alias("file"), "event_id", text.alias("text")), path, "file", "event_id", "text").count()
    log = logs.read_json_zip(spark, path, span=100_000)
    return log.select("checkpoint", "event_seq", "event_type", F.get_json_object("body", "$.event_id").cast("long").alias("event_id"))


@query("SELECT event_id + 1 AS checkpoint, (value > 10 AND event_type IN ('signup', 'error', 'click')) AS handled FROM events")
def map_handled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of handlers do not count, the map's filters do."""
    m = EventMapBuilder("flags", registry=TypeRegistry()).where(lambda e, c: e.value > 10)
    m.map("signup").as_action("a")
    m.map("error").when(lambda e, c: e.value > 1e9).as_action("b")
    m.map("click").as_action("c")
    return logs.events_log(spark, sf_dir).select("checkpoint", m.build().handled().alias("handled"))


@query("SELECT event_id + 1 AS checkpoint, 'big' AS action FROM events WHERE value > 10 AND event_type = 'purchase' AND value > 60 AND user_id % 2 = 0")
def map_global_and_local_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EventMapBuilder("filters").where(lambda e, c: e.value > 10)
    m.map("purchase").when(lambda e, c: e.value > 60).when(lambda e, c: e.user_id % 2 == 0).as_action("big")
    return Projector(m.build()).project(logs.events_log(spark, sf_dir)).custom.select("checkpoint", "action")


@query("""
SELECT event_id + 1 AS checkpoint, 0 AS place, 'any activity' AS action FROM events WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id + 1, 1, 'purchase' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id + 1, 1, 'purchase again' FROM events WHERE event_type = 'purchase'""")
def map_base_then_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EventMapBuilder("types", registry=TYPES)
    m.map("purchase").as_action("purchase")
    m.map("activity").as_action("any activity")
    m.map("purchase").as_action("purchase again")
    plan = m.build()
    rows = Projector(plan).project(logs.events_log(spark, sf_dir)).custom
    return rows.select("checkpoint", (F.col("rule_seq") >= len(plan.rules)).cast("int").alias("place"), "action")


@query(_fold_sql(_ops_sql(), _STATE))
def project_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: signup creates or overwrites, activities update, errors delete."""
    return _state(_deleting(_users()), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql("false"), _STATE))
def create_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_deleting(_users("ignoring")), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql(kinds="('none')"), _STATE))
def create_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EventMapBuilder("users", "bigint", FIELDS)
    m.map("signup").as_create_of(_USER).overwriting_duplicates().using(**_SET)
    return _state(_deleting(m), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql("value > 50"), _STATE))
def create_custom_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_deleting(_users("custom")), logs.events_log(spark, sf_dir))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'signup'),
r(user_id, n, best) AS (SELECT user_id, n, value FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN e.value > r.best THEN e.value ELSE r.best END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, max(best) AS best FROM r GROUP BY user_id""")
def create_dup_reads_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duplicate that is applied only if it beats the row that is there."""
    m = EventMapBuilder("best", "bigint", {"best": "double"})
    m.map("signup").as_create_of(_USER).handling_duplicates_using(lambda old, e, c: e.value > old.best).using(best=lambda e, c: e.value)
    return _state(m.build(), logs.events_log(spark, sf_dir))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('signup', 'view', 'error')),
r(user_id, n, here, streak, longest, last) AS (SELECT user_id, 0, false, 0, 0, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT r.user_id, e.n, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false ELSE here END,
    CASE WHEN event_type = 'view' AND here THEN CASE WHEN value > last THEN streak + 1 ELSE 0 END WHEN event_type = 'signup' AND here THEN streak ELSE 0 END,
    CASE WHEN event_type = 'view' AND here THEN greatest(longest, CASE WHEN value > last THEN streak + 1 ELSE 0 END) WHEN event_type = 'signup' AND here THEN longest ELSE 0 END,
    CASE WHEN event_type = 'signup' OR (event_type = 'view' AND here) THEN value END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, CAST(streak AS BIGINT) AS streak, CAST(longest AS BIGINT) AS longest, last FROM r WHERE here QUALIFY n = max(n) OVER (PARTITION BY user_id)
  AND n = (SELECT max(n) FROM e WHERE e.user_id = r.user_id)""")
def update_reads_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments from the row that is there: how many views in a row rose over what came before, and the most of them."""
    m = EventMapBuilder("streaks", "bigint", {"streak": "bigint", "longest": "bigint", "last": "double"})
    rises = lambda old, e: F.when(e.value > old.last, old.streak + 1).otherwise(0)
    m.map("signup").as_create_of(_USER).overwriting_duplicates().using(last=lambda e, c: e.value, streak=lambda old, e, c: F.coalesce(old.streak, F.lit(0)), longest=lambda old, e, c: F.coalesce(old.longest, F.lit(0)))
    m.map("view").as_update_of(_USER).ignoring_misses().using(last=lambda e, c: e.value, streak=lambda old, e, c: rises(old, e), longest=lambda old, e, c: F.greatest(old.longest, rises(old, e)))
    return _state(_deleting(m), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql(), """,
cut AS (SELECT min(ord) AS cut_at FROM inc WHERE effective AND op = 'update' AND value > 60)
SELECT x.user_id, last_value, cut_at + 1 AS error_checkpoint, CAST(cut_at + 1 AS VARCHAR) AS transaction_id, event_type, 'users' AS projector, 'CAST_INVALID_INPUT' AS reason FROM (
  SELECT key AS user_id, arg_max(CASE WHEN effective THEN last_value END, ord) FILTER (WHERE effective) AS last_value, arg_max(fixes, ord) FILTER (WHERE fixes IS NOT NULL) AS lives FROM inc, cut WHERE incarnation > 0 AND ord < cut_at GROUP BY key, incarnation) x, cut
JOIN events ON event_id = cut_at WHERE lives"""))
def foreign_errors_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment that fails on some events: the first one that is applied stops the run, and says what it was."""
    m = EventMapBuilder("users", "bigint", {"last_value": "double"}, TYPES)
    m.map("signup").as_create_of(_USER).overwriting_duplicates().using(last_value=lambda e, c: e.value)
    for kind in ("click", "view", "purchase"):
        m.map(kind).as_update_of(_USER).ignoring_misses().using(last_value=lambda e, c: F.when(e.value > 60, "no number").otherwise(e.value.cast("string")))
    return _with_error(Projector(_deleting(m)).project(logs.events_log(spark, sf_dir), on_error="cut"))


def _with_error(found) -> DataFrame:
    e = found.error
    reason = next((r for r in ("CAST_INVALID_INPUT", "DIVIDE_BY_ZERO") if r in str(e.__cause__)), "none")
    return found.state.select(
        F.col("key").alias("user_id"), "last_value", F.lit(e.event["checkpoint"]).cast("long").alias("error_checkpoint"), F.lit(e.transaction_id).alias("transaction_id"),
        F.lit(e.event["event_type"]).alias("event_type"), F.lit(e.child or e.projector).alias("projector"), F.lit(reason).alias("reason"),
    )


@query("""
WITH c AS (SELECT min(event_id) AS cut_at FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0)
SELECT user_id, arg_max(value, event_id) AS last_value, cut_at + 1 AS error_checkpoint, CAST(cut_at + 1 AS VARCHAR) AS transaction_id, 'purchase' AS event_type, 'child' AS projector, 'DIVIDE_BY_ZERO' AS reason
FROM events, c WHERE event_type IN ('signup', 'purchase') AND event_id < cut_at GROUP BY ALL""")
def child_predicate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of a child divides by zero: the child's error comes before what its parent does with the same event."""
    child = EventMapBuilder("child", "bigint", {"last_value": "double"})
    child.map("purchase").when(lambda e, c: 1 / (e.user_id % 7) > 0.1).as_create_of(_USER).overwriting_duplicates().using(last_value=lambda e, c: e.value)
    m = EventMapBuilder("users", "bigint", {"last_value": "double"})
    for kind in ("signup", "purchase"):
        m.map(kind).as_create_of(_USER).overwriting_duplicates().using(last_value=lambda e, c: F.when((c.event_type == "purchase") & (e.user_id % 7 == 0), F.raise_error(F.lit("late"))).otherwise(e.value))
    return _with_error(Projector(m.build(), [Projector(child.build())]).project(logs.events_log(spark, sf_dir), on_error="cut"))


@query("""
WITH s AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN value END AS v FROM events WHERE event_type IN ('signup', 'error')),
p AS (SELECT a.event_id, a.user_id, CASE WHEN a.event_type = 'purchase' THEN a.value - coalesce(s.v, 0) END AS over FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) a
      ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.event_id >= s.event_id),
w AS (SELECT v.event_id, v.user_id, p.over, s.v FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.event_id >= p.event_id ASOF LEFT JOIN s ON v.user_id = s.user_id AND v.event_id >= s.event_id)
SELECT user_id, round(arg_max(over, event_id) FILTER (WHERE true), 6) AS over, arg_max(over IS NOT NULL, event_id) AS bought, arg_max(v IS NOT NULL, event_id) AS signed_up FROM w
GROUP BY user_id""".replace("arg_max(over, event_id) FILTER (WHERE true)", "arg_max({'x': over}, event_id).x"))
def children_read_in_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: purchases read the signups below them as they are then, views read both."""
    signups = EventMapBuilder("signups", "bigint", {"v": "double"})
    signups.map("signup").as_create_of(_USER).overwriting_duplicates().using(v=lambda e, c: e.value)
    bought = EventMapBuilder("bought", "bigint", {"over": "double"})
    bought.map("purchase").as_create_of(_USER).overwriting_duplicates().using(over=lambda e, c: e.value - F.coalesce(c.child("signups", e.user_id).v, F.lit(0.0)))
    m = EventMapBuilder("views", "bigint", {"over": "double", "bought": "boolean", "signed_up": "boolean"})
    m.map("view").as_create_of(_USER).overwriting_duplicates().using(
        over=lambda e, c: c.child("bought", e.user_id).over, bought=lambda e, c: c.child("bought", e.user_id).is_there(), signed_up=lambda e, c: c.child("signups", e.user_id).is_there()
    )
    projector = Projector(m.build(), [Projector(_deleting(bought), [Projector(_deleting(signups))])])
    return projector.project(logs.events_log(spark, sf_dir)).state.select(F.col("key").alias("user_id"), F.round("over", 6).alias("over"), "bought", "signed_up")


@query(_fold_sql(_ops_sql(update="true"), _STATE))
def update_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_deleting(_users(update="creating")), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql(update="event_type = 'purchase'"), _STATE))
def update_custom_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_deleting(_users(update="custom")), logs.events_log(spark, sf_dir))


@query(_fold_sql(_ops_sql(), "SELECT ord + 1 AS checkpoint, key AS user_id FROM inc WHERE op = 'update' AND NOT present"))
def update_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates that found nothing and were let go."""
    flagged = Projector(_deleting(_users())).flagged(logs.events_log(spark, sf_dir))
    return flagged.where("op = 'update' and missed").select("checkpoint", F.col("key").alias("user_id"))


@query(_fold_sql(_ops_sql(), "SELECT ord + 1 AS checkpoint, key AS user_id FROM inc WHERE op = 'delete' AND NOT present"))
def delete_misses_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _users()
    m.map("error").as_delete_of(_USER).handling_misses_using()
    return Projector(m.build()).project(logs.events_log(spark, sf_dir)).misses.select("checkpoint", F.col("key").alias("user_id"))


@query(_fold_sql(_ops_sql("false"), "SELECT ord + 1 AS checkpoint, key AS user_id, op FROM inc WHERE CASE WHEN op = 'create' THEN present ELSE NOT present END ORDER BY ord LIMIT 1"))
def policy_errors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under policies that throw: the first error, at which the run stops."""
    m = _users("throwing", "throwing")
    m.map("error").as_delete_of(_USER).throwing_if_missing()
    flagged = Projector(m.build()).flagged(logs.events_log(spark, sf_dir))
    return flagged.where("failed").orderBy(*fold.ORDER).limit(1).select("checkpoint", F.col("key").alias("user_id"), "op")


@query(_fold_sql(_ops_sql("false", kinds="('none')"), """,
cut AS (SELECT min(ord) AS cut_at FROM inc WHERE op = 'create' AND present)
SELECT key AS user_id, arg_max(value, ord) AS last_value FROM inc, cut WHERE op <> 'x' AND ord < cut_at GROUP BY key HAVING arg_max(fixes, ord)"""))
def policy_errors_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stand when the first duplicate stops the run."""
    m = EventMapBuilder("users", "bigint", {"last_value": "double"})
    m.map("signup").as_create_of(_USER).using(last_value=lambda e, c: e.value)
    m.map("error").as_delete_of(_USER).ignoring_misses()
    return Projector(m.build()).project(logs.events_log(spark, sf_dir), on_error="cut").state.withColumnRenamed("key", "user_id")


@query(_fold_sql(_ops_sql(), """
SELECT ord + 1 AS checkpoint, key AS user_id, op, NOT (op = 'delete') AS "exists", CASE WHEN op <> 'delete' THEN last_type END AS last_type, CASE WHEN op <> 'delete' THEN last_value END AS last_value
FROM inc WHERE effective OR (op = 'delete' AND present)"""))
def project_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _deleting(_users())
    rows = fold.history_rows(plan, Projector(plan).flagged(logs.events_log(spark, sf_dir)))
    return rows.select("checkpoint", F.col("key").alias("user_id"), "op", "exists", *FIELDS)


@query(_fold_sql(_ops_sql(), """,
epochs AS (SELECT *, count(CASE WHEN effective AND op = 'create' THEN 1 END) OVER (PARTITION BY key ORDER BY ord ROWS UNBOUNDED PRECEDING) AS epoch FROM inc),
latest AS (SELECT *, max(epoch) OVER (PARTITION BY key, incarnation) AS last_epoch FROM epochs WHERE incarnation > 0)
SELECT l.key AS user_id, CAST(count(CASE WHEN effective AND op = 'update' THEN 1 END) AS BIGINT) AS n, round(coalesce(sum(CASE WHEN effective AND op = 'update' AND epoch = last_epoch THEN value END), 0), 4) AS total,
       max(CASE WHEN effective THEN value END) AS highest
FROM latest l JOIN alive a ON a.key = l.key AND a.incarnation = l.incarnation AND a.lives GROUP BY l.key, l.incarnation"""))
def project_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of activities; a signup starts the sum anew."""
    return _state(_totals(), logs.events_log(spark, sf_dir)).withColumn("total", F.round("total", 4))


def _totals() -> ProjectionPlan:
    m = EventMapBuilder("totals", "bigint", {"n": ("bigint", "count"), "total": ("double", "sum"), "highest": ("double", "max")})
    m.map("signup").as_create_of(_USER).overwriting_duplicates().adding({"total": F.lit(0.0)}, highest=lambda e, c: e.value)
    for kind in ("click", "view", "purchase"):
        m.map(kind).as_update_of(_USER).ignoring_misses().adding(n=F.lit(1), total=lambda e, c: e.value, highest=lambda e, c: e.value)
    return _deleting(m)


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, arg_max(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY 1")
def key_from_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EventMapBuilder("by_header", "bigint", {"last_type": "string", "n": ("bigint", "count")}, TypeRegistry(TYPES.parents, root="event"))
    m.map("event").as_create_of(lambda e, c: c.header("k")).overwriting_duplicates().adding({"last_type": lambda e, c: c.event_type}, n=F.lit(1))
    return Projector(m.build()).project(logs.events_log(spark, sf_dir)).state.withColumnRenamed("key", "k")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS n FROM lineitem)
SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN r ON l_orderkey = o_orderkey WHERE n = 1""")
def nested_lines_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines nested in their orders by number, duplicates upserted; unnested for comparison."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nested = nest(lines, "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_quantity"], "lines")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    # the place of the last op gives both fields, so they come from one line
    return orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("lines").alias("x")).select("o_orderkey", F.col("x.l_linenumber").alias("l_linenumber"), F.col("x.l_partkey").alias("l_partkey"), F.col("x.l_quantity").alias("l_quantity"))


@query("""
SELECT p.event_id + 1 AS checkpoint, p.user_id, s.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN value END AS value FROM events WHERE event_type IN ('signup', 'error')) s ON p.user_id = s.user_id AND p.event_id >= s.event_id""")
def child_lookup_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the value of the child projection's row at that time; a deletion ends it."""
    child = EventMapBuilder("signups", "bigint", {"signup_value": "double"})
    child.map("signup").as_create_of(_USER).overwriting_duplicates().using(signup_value=lambda e, c: e.value)
    plan, log = _deleting(child), logs.events_log(spark, sf_dir)
    history = fold.history_rows(plan, Projector(plan).flagged(log)).select("checkpoint", "event_seq", F.col("key").alias("user_id"), "signup_value")
    purchases = log.where("event_type = 'purchase'").select("checkpoint", "event_seq", F.col("body.user_id").alias("user_id"))
    return as_of(purchases, history, "user_id", ["checkpoint", "event_seq"], ["signup_value"]).select("checkpoint", "user_id", "signup_value")


#: A third of all users as one.
_HOT = lambda e, c: F.when(e.user_id % 3 == 0, 0).otherwise(e.user_id)
_HOT_SQL = "(SELECT event_id, event_type, value, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id FROM events)"


def _hot_signups() -> ProjectionPlan:
    m = EventMapBuilder("signups", "bigint", {"signup_value": "double"})
    m.map("signup").as_create_of(_HOT).overwriting_duplicates().using(signup_value=lambda e, c: e.value)
    m.map("error").as_delete_of(_HOT).ignoring_misses()
    return m.build()


@query(f"""
WITH o AS (SELECT event_id, user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {_HOT_SQL} WHERE event_type IN ('signup', 'error'))
SELECT event_id + 1 AS checkpoint, user_id, event_type = 'signup' AS "exists", CASE WHEN event_type = 'signup' THEN value END AS signup_value FROM o WHERE event_type = 'signup' OR before = 'signup'""")
def history_of_a_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of signups where one key has a third of all events: its ranges of checkpoints are worked on by themselves."""
    plan = _hot_signups()
    rows = fold.history_rows(plan, Projector(plan, split_every=500).flagged(logs.events_log(spark, sf_dir)))
    return rows.select("checkpoint", F.col("key").alias("user_id"), "exists", "signup_value")


@query(f"""
SELECT p.event_id + 1 AS checkpoint, p.user_id, s.value AS signup_value FROM (SELECT * FROM {_HOT_SQL} WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN value END AS value FROM {_HOT_SQL} WHERE event_type IN ('signup', 'error')) s ON p.user_id = s.user_id AND p.event_id >= s.event_id""")
def child_lookup_of_a_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``child_lookup_asof``, through a rule that reads its child, where one key has a third of all events."""
    m = EventMapBuilder("purchases", "bigint", {"user_id": "bigint", "signup_value": "double"})
    m.map("purchase").as_create_of(lambda e, c: c.checkpoint).using(user_id=_HOT, signup_value=lambda e, c: c.child("signups", _HOT(e, c)).signup_value)
    projector = Projector(m.build(), [Projector(_hot_signups(), split_every=500)], split_every=500)
    return projector.project(logs.events_log(spark, sf_dir)).state.select(F.col("key").alias("checkpoint"), "user_id", "signup_value")


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_linenumber + (l_linenumber % 2) * (l_orderkey % 2) AS f, l_linenumber + 1 AS t FROM lineitem WHERE l_linenumber <> 3),
c(l_orderkey, n, f) AS (SELECT l_orderkey, n, f FROM p q WHERE n = (SELECT max(n) FROM p WHERE p.l_orderkey = q.l_orderkey)
  UNION ALL SELECT p.l_orderkey, p.n, p.f FROM c JOIN p ON p.l_orderkey = c.l_orderkey AND p.t = c.f AND p.n <> c.n)
SELECT l_orderkey, CAST(min(n) AS INTEGER) AS first_line, CAST(max(n) AS INTEGER) AS last_line FROM c GROUP BY l_orderkey""")
def contiguous_chain_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as periods, each from its number (or one later) to the next; line 3 is never valid."""
    n = F.col("l_linenumber").cast("long")
    periods = F.sort_array(F.collect_set(F.struct(n.alias("sequence"), (n + (n % 2) * (F.col("l_orderkey") % 2)).alias("from"), (n + 1).alias("to"), (n != 3).alias("valid"))))
    chains = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(periods.alias("p")).withColumn("c", contiguous_chain(F.col("p"))).where("c is not null")
    return chains.select("l_orderkey", F.col("c.first.sequence").cast("int").alias("first_line"), F.col("c.last.sequence").cast("int").alias("last_line"))


_REAL = """CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN TIMESTAMP '1997-06-15' > o_orderdate + INTERVAL 900 DAY THEN 'InReview' WHEN TIMESTAMP '1997-06-15' > o_orderdate + INTERVAL 700 DAY THEN 'Expired'
WHEN TIMESTAMP '1997-06-15' > o_orderdate + INTERVAL 400 DAY THEN 'Revalidate' WHEN TIMESTAMP '1997-06-15' < o_orderdate THEN 'AwaitingActivation' ELSE 'Active' END"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents; those of status O are the active ones."""
    orders, day = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderdate")
    plus = lambda n: day + F.expr(f"INTERVAL '{n}' DAY")
    state = classify(F.when(F.col("o_orderstatus") == "O", "Active").otherwise(F.col("o_orderstatus")), plus(900), plus(700), day, plus(400), F.lit(NOW).cast("timestamp_ntz"))
    return orders.withColumn("state", state)


@query(f"SELECT o_orderkey, {_REAL} AS state FROM orders")
def realtime_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("o_orderkey", "state")


@query(f"""
SELECT n_nationkey AS country, n_name AS country_name, c_mktsegment AS area, o_orderpriority AS kind, {_REAL} AS state, count(*) AS count
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def counts_per_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    docs = _documents(spark, sf_dir).join(customers, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("area"), F.col("o_orderpriority").alias("kind"), "state")
    return count_states(docs, spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("projector_id"), F.col("event_id").alias("seq"), "ts", (F.col("event_id") * 3 + 1).alias("checkpoint"))


@query("SELECT user_id % 7 AS projector_id, arg_max(event_id * 3 + 1, event_id) AS checkpoint, arg_max(ts, event_id) AS ts FROM events GROUP BY 1")
def stats_last_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_checkpoints(_progress(spark, sf_dir))


@query("SELECT user_id % 7 AS projector_id, arg_max(event_id * 3 + 1, event_id) AS last_checkpoint, arg_max(ts, event_id) AS updated_utc, '/projectionStats/' || (user_id % 7) AS url FROM events GROUP BY 1")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_progress(spark, sf_dir), "/projectionStats")


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).cast("string").alias("projector_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("name"), F.col("value").cast("string").alias("value"))


@query("""
SELECT '3' AS projector_id, (SELECT max(event_id * 3 + 1) FROM events WHERE user_id % 7 = 3) AS last_checkpoint, event_type AS name, arg_max(event_id, event_id) AS seq, '/s/3/events' AS events_url
FROM events WHERE user_id % 7 = 3 GROUP BY event_type UNION ALL SELECT 'unknown', 0, NULL, NULL, '/s/unknown/events'""")
def stats_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of one projector with its properties, and that of an id that nobody has used."""
    progress = _progress(spark, sf_dir).withColumn("projector_id", F.col("projector_id").cast("string"))
    properties = _properties(spark, sf_dir).withColumn("value", F.col("seq"))  # so that the value says which call it is from
    both = [stats.detail(progress, properties, i, "/s") for i in ("3", "unknown")]
    rows = both[0].unionByName(both[1]).select("projector_id", "last_checkpoint", "events_url", F.explode_outer("properties").alias("p"))
    return rows.select("projector_id", "last_checkpoint", F.col("p.name").alias("name"), F.col("p.value").alias("seq"), "events_url")


@query("SELECT event_type AS body, ts FROM events WHERE user_id % 7 = 3")
def stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _properties(spark, sf_dir).select("projector_id", "seq", "ts", F.col("name").alias("body"))
    return stats.events(rows, "3").unionByName(stats.events(rows, "unknown"))


@query("""
WITH p AS (SELECT 'user ' || (user_id % 40) AS name, CAST(event_id AS VARCHAR) AS value, event_type = 'click' AS later, event_id FROM events WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 40 < 30))
SELECT 'p' AS projector_id, name, arg_max(value, event_id + CASE WHEN later THEN 1000000000000 ELSE 0 END) AS value FROM p GROUP BY name""")
def stats_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projector restored from stored properties, some of which later calls have replaced."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "ts", "user_id", F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_id").cast("string").alias("value"))
    stored = rows.where("event_type = 'view' and user_id % 40 < 30").groupBy("name").agg(F.max_by("value", "event_id").alias("value"), F.max_by("ts", "event_id").alias("ts"))
    _, properties, _ = stats.restored("p", stored, rows.select(F.col("event_type").alias("body"), "ts"))
    calls = rows.where("event_type = 'click'").select(F.lit("p").alias("projector_id"), F.col("event_id").alias("seq"), "ts", "name", "value")
    return stats.last_properties(properties.unionByName(calls)).select("projector_id", "name", "value")


@query("SELECT user_id % 7 AS projector_id, event_type AS name, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts FROM events GROUP BY 1, 2")
def stats_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).alias("projector_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("name"), "value")
    return stats.last_properties(rows)


def _sampler(name: str, threshold: int, keep: int) -> str:
    """Accepted records one after another: the next is the first more than ``threshold`` seconds later."""
    return f"""{name}_a(id, n, t, c, s) AS (SELECT id, 0, t, c, CAST(NULL AS FLOAT) FROM (SELECT id, arg_min(t, seq) AS t, arg_min(c, seq) AS c FROM p GROUP BY id)
  UNION ALL SELECT a.id, a.n + 1, b.t, b.c, CAST((b.c - a.c) / (b.t - a.t) AS FLOAT) FROM {name}_a a, LATERAL (SELECT t, c FROM p WHERE p.id = a.id AND p.t > a.t + {threshold} ORDER BY seq LIMIT 1) b),
{name} AS (SELECT id, n, s, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS back FROM {name}_a WHERE n > 0 QUALIFY back <= {keep})"""


_SPEED = f"""
WITH RECURSIVE p AS (SELECT user_id % 7 AS id, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_id * 3 + 1 AS c FROM events),
{_sampler("minute", 5, 12)},
{_sampler("ten", 60, 9)},
m AS (SELECT id, sum(s * w) / sum(w) AS speed FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY n) AS w FROM minute) GROUP BY id),
both_ AS (SELECT id, s, n FROM ten UNION ALL SELECT id, speed, 1000000000 FROM m),
speeds AS (SELECT id, sum(s * w) / sum(w) AS speed FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY n) AS w FROM both_) GROUP BY id)
"""


@query(_SPEED + "SELECT id AS projector_id, round(CAST(speed AS DOUBLE), 4) AS speed FROM speeds")
def stats_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level speeds in checkpoints a second, rounded because sums of 32-bit numbers depend on their order."""
    return stats.speeds(_progress(spark, sf_dir)).select("projector_id", F.round(F.col("speed").cast("double"), 4).alias("speed"))


@query(_SPEED + """SELECT id AS projector_id, last AS checkpoint, CASE WHEN last >= 25000 THEN 0 ELSE CAST(trunc((25000 - last) / speed / 60) AS BIGINT) END AS eta_minutes
FROM speeds JOIN (SELECT id, arg_max(c, seq) AS last FROM p GROUP BY id) USING (id)""")
def stats_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To minutes: the SQL's speeds are sums in another order. ``stats_eta_corners`` has whole seconds."""
    found = stats.time_to_reach(_progress(spark, sf_dir), 25000)
    return found.select("projector_id", "checkpoint", F.floor(F.col("eta_seconds") / 60).alias("eta_minutes"))


@query(SQL["project_user_state"])
def project_user_state_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with each user's history cut into ranges, as for users with very many events."""
    return Projector(_deleting(_users()), split_every=2_000).project(logs.events_log(spark, sf_dir)).state.withColumnRenamed("key", "user_id")


@query(SQL["project_user_state"])
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a stream: micro-batches are folded on snapshots in the shared folder."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store = SnapshotStore(spark, f"{path}/state")
    _dispatcher(spark, sf_dir).subscribe(Projector(_deleting(_users())), store, f"{path}/progress").awaitTermination()
    return store.read("users").withColumnRenamed("key", "user_id")


@query(SQL["project_user_state"])
def stream_user_state_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over four files, a batch each, on stored rows; stopped after the second file and subscribed again."""
    path, rows = f"{shared_folder(spark)}/restarted-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/events.parquet")
    store, id = SnapshotStore(spark, f"{path}/state"), f"restarted-{uuid.uuid4().hex}"
    stream = lambda options: logs.as_events_log(spark.readStream.schema(rows.schema).options(**options).parquet(f"{path}/events"))
    dispatcher = Dispatcher(stream, lambda: logs.as_events_log(spark.read.parquet(f"{path}/events")))
    options = SubscriptionOptions(id=id, reader_options={"maxFilesPerTrigger": "1"})
    for half in range(2):
        _quarters(spark, sf_dir, f"{path}/events", [2 * half, 2 * half + 1])
        dispatcher.subscribe(Projector(_deleting(_users())), store, f"{path}/progress", options=options).awaitTermination()
    return store.read("users").withColumnRenamed("key", "user_id")


def _strict() -> Projector:
    """Signups of users that are there are errors."""
    m = EventMapBuilder("users", "bigint", {"last_value": "double"})
    m.map("signup").as_create_of(_USER).using(last_value=lambda e, c: e.value)
    m.map("error").as_delete_of(_USER).ignoring_misses()
    return Projector(m.build())


@query(f"SELECT *, '1, 2, 3' AS attempts, 0 AS successes FROM ({SQL['policy_errors_cut']})")
def stream_retries_then_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fails is tried three times and then ignored: what came before the error stays, and it is no success."""
    path, asked, done = f"{shared_folder(spark)}/ignored-{uuid.uuid4().hex}", [], []

    def handler(error: Exception, attempts: int, info: Info) -> Resolution:
        asked.append(attempts)
        return Resolution.RETRY if attempts < 3 else Resolution.IGNORE

    store, options = SnapshotStore(spark, f"{path}/state"), SubscriptionOptions(id=f"ignored-{uuid.uuid4().hex}", exception_handler=handler, success_handler=done.append)
    _dispatcher(spark, sf_dir).subscribe(_strict(), store, f"{path}/progress", options=options).awaitTermination()
    return store.read("users").select(F.col("key").alias("user_id"), "last_value", F.lit(", ".join(map(str, asked))).alias("attempts"), F.lit(len(done)).alias("successes"))


@query(f"SELECT checkpoint, user_id, 1 AS attempts, 0 AS stored FROM ({_fold_sql(_ops_sql('false', kinds="('none')"), "SELECT ord + 1 AS checkpoint, key AS user_id FROM inc WHERE op = 'create' AND present ORDER BY ord LIMIT 1")})")
def stream_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fails ends its subscription: where, and that nothing of the batch was stored."""
    path, errors = f"{shared_folder(spark)}/aborted-{uuid.uuid4().hex}", []

    def handler(error: Exception, attempts: int, info: Info) -> Resolution:
        errors.append((error.event["checkpoint"], int(error.event["key"]), attempts))
        return Resolution.ABORT

    store, options = SnapshotStore(spark, f"{path}/state"), SubscriptionOptions(id=f"aborted-{uuid.uuid4().hex}", exception_handler=handler)
    query = _dispatcher(spark, sf_dir).subscribe(_strict(), store, f"{path}/progress", options=options)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        return spark.createDataFrame([(*e, store.count("users")) for e in errors], "checkpoint bigint, user_id bigint, attempts int, stored int")
    raise AssertionError("the subscription went on")


@query(f"SELECT *, 2 AS attempts FROM ({SQL['project_user_state']})")
def stream_restarts_when_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscriber that is beyond the log's end begins anew: what it had stored goes, the work before the restart is retried once."""
    path, tried = f"{shared_folder(spark)}/ahead-{uuid.uuid4().hex}", []

    def before(info: Info) -> None:
        tried.append(info.id)
        if len(tried) == 1:
            raise OSError("not now")

    store = SnapshotStore(spark, f"{path}/state")
    store.write("users", 7, spark.createDataFrame([(-1, "stale", 0.0)], "key bigint, last_type string, last_value double"))
    options = SubscriptionOptions(id=f"ahead-{uuid.uuid4().hex}", restart_when_ahead=True, before_restarting=before, exception_handler=lambda error, attempts, info: Resolution.RETRY)
    _dispatcher(spark, sf_dir).subscribe(Projector(_deleting(_users())), store, f"{path}/progress", from_checkpoint=1 << 40, options=options).awaitTermination()
    return store.read("users").withColumnRenamed("key", "user_id").withColumn("attempts", F.lit(len(tried)))


@query(SQL["project_user_state"])
def stream_waits_for_a_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription that goes on until it is stopped; the state is read once it has handled the log's last checkpoint."""
    path, id = f"{shared_folder(spark)}/waits-{uuid.uuid4().hex}", f"waits-{uuid.uuid4().hex}"
    store, dispatcher = SnapshotStore(spark, f"{path}/state"), _dispatcher(spark, sf_dir)
    end = logs.events_log(spark, sf_dir).agg(F.max("checkpoint")).first()[0]
    query = dispatcher.subscribe(Projector(_deleting(_users())), store, f"{path}/progress", options=SubscriptionOptions(id=id), available_now=False)
    try:
        if not has_subscription(spark, id) or not dispatcher.wait_until_checkpoint(query, end, timeout=600):
            raise TimeoutError(f"{id} has not come to {end}")
        catch_up(query)  # the batch that has come to it ends
    finally:
        query.stop()
    return store.read("users").withColumnRenamed("key", "user_id")


@query("SELECT 4 AS batches, count(*) AS n, CAST(sum(CASE WHEN n < 4 THEN 1 ELSE 0 END) AS BIGINT) AS in_some FROM (SELECT user_id, count(DISTINCT least(event_id // (SELECT max(event_id) // 4 + 1 FROM events), 3)) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) WHERE n > 0")
def stream_batches_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many batches each user has bought: what the accumulators of rows carry from one batch to the next."""
    path, rows = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/events.parquet")
    quarter = rows.agg(F.max("event_id")).first()[0] // 4 + 1
    store, handled = SnapshotStore(spark, f"{path}/state"), []
    for n in range(4):
        rows.where((F.col("event_id") >= n * quarter) & (F.col("event_id") < (n + 1) * quarter)).withColumn("batch", F.lit(n)).coalesce(1).write.mode("append").parquet(f"{path}/events")
    own = spark.read.parquet(f"{path}/events")
    log = lambda r: logs.make_log(r, checkpoint=F.col("event_id") + 1, event_type=F.col("event_type"), body=F.struct("user_id", "batch"))
    m = EventMapBuilder("seen", "bigint", {"last": "int", "n": "int"})
    m.map("purchase").as_create_of(_USER).handling_duplicates_using(lambda old, e, c: e.batch != old.last).using(last=lambda e, c: e.batch, n=lambda old, e, c: F.coalesce(old.n, F.lit(0)) + 1)
    stream = lambda options: log(spark.readStream.schema(own.schema).options(**options).parquet(f"{path}/events"))
    options = SubscriptionOptions(id=f"batches-{uuid.uuid4().hex}", success_handler=lambda info: handled.append(info.batch_id), reader_options={"maxFilesPerTrigger": "1"})
    Dispatcher(stream, lambda: log(own)).subscribe(Projector(m.build()), store, f"{path}/progress", options=options).awaitTermination()
    return store.read("seen").agg(F.lit(len(handled)).alias("batches"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") < 4, 1).otherwise(0)).alias("in_some"))



def _stream(spark: SparkSession, sf_dir: str, options: dict[str, str]) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return logs.as_events_log(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").options(**options).parquet(sf_dir))


def _dispatcher(spark: SparkSession, sf_dir: str) -> Dispatcher:
    return Dispatcher(lambda options: _stream(spark, sf_dir, options), lambda: logs.events_log(spark, sf_dir))


@query(SQL["project_user_state"])
def stream_user_state_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as keyed streaming state: each batch gives out the rows that it changed, and the last one of a key counts."""
    path = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    _keep_changes(stateful(_deleting(_users()), _stream(spark, sf_dir, {})), path)
    last = spark.read.parquet(f"{path}/changes").groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("exists", *FIELDS), "batch_id").alias("l"))
    return last.where("l.exists").select("user_id", *(F.col(f"l.{n}").alias(n) for n in FIELDS))


def _quarters(spark: SparkSession, sf_dir: str, path: str, which: list[int]) -> DataFrame:
    """Append quarters of ``events``, a file each, and give the table that they come from."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    quarter = rows.agg(F.max("event_id")).first()[0] // 4 + 1
    for n in which:
        rows.where((F.col("event_id") >= n * quarter) & (F.col("event_id") < (n + 1) * quarter)).coalesce(1).write.mode("append").parquet(path)
    return rows


def _keep_changes(changes: DataFrame, path: str) -> None:
    """Run a stream of changes to its end, each batch a folder."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{path}/changes/batch={n}")

    changes.writeStream.outputMode("append" if "past" in changes.columns else "update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


@query(SQL["project_accumulators"])
def stream_accumulators_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators as keyed state: begun with the rows of the first quarter of the log, a batch for each of the others, stopped and started again in between."""
    path = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    first = _quarters(spark, sf_dir, f"{path}/first", [0])
    before = Projector(_totals()).project(logs.as_events_log(spark.read.parquet(f"{path}/first"))).state
    before.write.parquet(f"{path}/before")
    for which in ([1, 2], [3]):
        _quarters(spark, sf_dir, f"{path}/events", which)
        log = logs.as_events_log(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events"))
        _keep_changes(stateful(_totals(), log, spark.read.parquet(f"{path}/before")), path)
    names = ["n", "total", "highest"]
    rows = spark.read.parquet(f"{path}/changes").select("key", "batch_id", "exists", *names).unionByName(spark.read.parquet(f"{path}/before").select("key", F.lit(-1).alias("batch_id"), F.lit(True).alias("exists"), *names))
    last = rows.groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("exists", *names), "batch_id").alias("l"))
    return last.where("l.exists").select("user_id", "l.n", F.round("l.total", 4).alias("total"), "l.highest")


@query(_fold_sql(_ops_sql(), """,
took AS (SELECT *, lag(ord) OVER w AS before, lag(op) OVER w AS op_before, lag(last_value) OVER w AS value_before FROM inc WHERE effective OR (op = 'delete' AND present) WINDOW w AS (PARTITION BY key ORDER BY ord))
SELECT ord + 1 AS checkpoint, key AS user_id, op, NOT (op = 'delete') AS "exists", CASE WHEN op <> 'delete' THEN last_value END AS last_value, before + 1 AS checkpoint_before,
       CASE WHEN op_before <> 'delete' THEN value_before END AS value_before FROM took"""))
def stream_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of the flagship from four batches, each with the state before it, which an earlier batch may have left."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    events = _quarters(spark, sf_dir, f"{path}/events", [0, 1, 2, 3])
    log = logs.as_events_log(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events"))
    _keep_changes(stateful_history(_deleting(_users()), log, keep=1), path)
    past = F.try_element_at("past", F.lit(1))
    return spark.read.parquet(f"{path}/changes").select("checkpoint", F.col("key").alias("user_id"), "op", "exists", "last_value", past["checkpoint"].alias("checkpoint_before"), past["last_value"].alias("value_before"))


@query("SELECT max(event_id + 1) AS checkpoint, 1 AS batches FROM events")
def stream_tracks_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription that handles each batch and then tracks its checkpoint: the last one tracked."""
    path, tracked = f"{shared_folder(spark)}/tracked-{uuid.uuid4().hex}", []
    options = SubscriptionOptions(id=f"tracked-{uuid.uuid4().hex}", success_handler=lambda info: tracked.append((options.id, info.batch_id, datetime.now(), info.checkpoint)))
    _dispatcher(spark, sf_dir).subscribe(Projector(_deleting(_users())), SnapshotStore(spark, f"{path}/state"), f"{path}/progress", options=options).awaitTermination()
    progress = spark.createDataFrame(tracked, "projector_id string, seq long, ts timestamp, checkpoint long")
    return stats.last_checkpoints(progress).select("checkpoint", F.lit(len(tracked)).alias("batches"))


@query(f"SELECT * FROM ({SQL['project_user_state']}) WHERE user_id % 3 <> 0 AND user_id <> 7")
def repository_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored state from which a range of keys and one key are removed, and what was removed of another is added again."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/repository-{uuid.uuid4().hex}")
    store.write("first", 0, Projector(_deleting(_users())).project(logs.events_log(spark, sf_dir)).state)
    whole, keys = store.read("first"), F.col("key")
    store.add_range("users", whole)
    store.remove_range("users", whole.where(keys % 3 == 0).select("key"))
    store.remove_by_key("users", 7)
    store.remove_range("users", whole.where(keys % 3 == 1).select("key"))
    store.add_range("users", whole.where((keys % 3 == 1) & (keys != 7)))
    return store.read("users").withColumnRenamed("key", "user_id")


@query("""
SELECT CAST(CASE WHEN user_id % 10 <> 0 THEN user_id + 1152921504606846976 END AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, CAST(max(CASE WHEN event_id % 3 <> 0 THEN event_id + 1152921504606846976 END) AS VARCHAR) AS last_id,
       arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1""")
def fold_null_and_large_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general fold over keys and values beyond doubles, and null ones."""
    large = 1 << 60
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ops = rows.select(
        F.when(F.col("user_id") % 10 != 0, F.col("user_id") + large).alias("key"), F.col("event_id").alias("checkpoint"), F.lit(0).alias("event_seq"), F.lit(0).alias("rule_seq"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") + large).alias("id"), "event_type",
    )

    def step(row: dict | None, op: dict) -> dict:
        row = row or {"n": 0, "last_id": None}
        return {"n": row["n"] + 1, "last_id": row["last_id"] if op["id"] is None else op["id"], "last_type": op["event_type"]}

    found = fold.fold_rows(ops, step, "key bigint, n bigint, last_id bigint, last_type string")
    return found.select(F.col("key").cast("string").alias("key"), "n", F.col("last_id").cast("string").alias("last_id"), "last_type")


@query(_fold_sql(_ops_sql("false"), _STATE))
def older_verbs_if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older names: create if there is none, update and delete if there is one."""
    m = EventMapBuilder("users", "bigint", FIELDS, TYPES)
    m.map("signup").as_create_if_does_not_exist_of(_USER).using(**_SET)
    for kind in ("click", "view", "purchase"):
        m.map(kind).as_update_if_exists_of(_USER).using(**_SET)
    m.map("error").as_delete_if_exists_of(_USER)
    return _state(m.build(), logs.events_log(spark, sf_dir))


@query(SQL["create_overwrite"])
def older_verbs_create_or_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EventMapBuilder("users", "bigint", FIELDS)
    m.map("signup").as_create_or_update_of(_USER).using(**_SET)
    m.map("error").as_delete_if_exists_of(_USER)
    return _state(m.build(), logs.events_log(spark, sf_dir))


@query("""
SELECT event_id + 1 AS checkpoint, 'lifecycle' AS action FROM events WHERE event_type IN ('signup', 'error') UNION ALL SELECT event_id + 1, 'error' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id + 1, 'any' FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def map_first_registered_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two mapped ancestors only the one registered first has its handlers run."""
    m = EventMapBuilder("types", registry=TypeRegistry(TYPES.parents | {"activity": "event", "lifecycle": "event"}))
    for name, kind in (("lifecycle", "lifecycle"), ("any", "event"), ("error", "error"), ("activity", "activity")):
        m.map(kind).as_action(name)
    return Projector(m.build()).project(logs.events_log(spark, sf_dir)).custom.select("checkpoint", "action")


@query("""
WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'signup'), bad AS (SELECT min(event_id) AS cut_at FROM s WHERE n = 2)
SELECT projection, user_id, last_value, error_checkpoint, child, projector FROM (
  SELECT unnest(['grandchild', 'child', 'parent']) AS projection, user_id, value AS last_value, cut_at + 1 AS error_checkpoint, 'grandchild' AS child, 'parent' AS projector FROM s, bad WHERE event_id < cut_at)""")
def children_stop_their_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels on one log: the innermost fails first, and no level keeps more than what came before; the error names it and the root."""

    def level(name: str, policy: str) -> ProjectionPlan:
        m = EventMapBuilder(name, "bigint", {"last_value": "double"})
        getattr(m.map("signup").as_create_of(_USER), policy)().using(last_value=lambda e, c: e.value)
        return m.build()

    throwing = EventMapBuilder("grandchild", "bigint", {"last_value": "double"})
    throwing.map("signup").as_create_of(_USER).using(last_value=lambda e, c: e.value)
    child = Projector(level("child", "overwriting_duplicates"), [Projector(throwing.build())])
    found = Projector(level("parent", "overwriting_duplicates"), [child]).project(logs.events_log(spark, sf_dir), on_error="cut")
    inner = found.children["child"]
    rows = [r.state.select(F.lit(n).alias("projection"), F.col("key").alias("user_id"), "last_value") for n, r in (("parent", found), ("child", inner), ("grandchild", inner.children["grandchild"]))]
    e = found.error
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("*", F.lit(e.event["checkpoint"]).alias("error_checkpoint"), F.lit(e.child).alias("child"), F.lit(e.projector).alias("projector"))


@query("""
SELECT 1 AS step, 'child' AS action, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT 2, 'first', count(*) FROM events WHERE event_type = 'signup'
UNION ALL SELECT 3, 'second fails', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 4, 'second', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT 5, 'third', count(*) FROM events WHERE event_type = 'view'""")
def actions_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's action runs before its parent's; the one that fails is retried, those that have finished are not run again."""
    ran: list[tuple[str, int]] = []

    def plan(name: str, **actions: str) -> ProjectionPlan:
        m = EventMapBuilder(name)
        for action, kind in actions.items():
            m.map(kind).as_action(action)
        return m.build()

    def action(name: str, fails: int = 0):
        def handle(events: DataFrame) -> None:
            tried = sum(n.startswith(name) for n, _ in ran)
            ran.append((f"{name} fails" if tried < fails else name, events.count()))
            if tried < fails:
                raise OSError("not now")

        return handle

    child = Projector(plan("inner", child="purchase"), actions={"child": action("child")})
    own = {"first": action("first"), "second": action("second", 1), "third": action("third")}
    Projector(plan("outer", first="signup", second="error", third="view"), [child], should_retry=lambda error, attempt: attempt < 3, actions=own).project(logs.events_log(spark, sf_dir))
    return spark.createDataFrame([(n + 1, name, count) for n, (name, count) in enumerate(ran)], "step int, action string, n bigint")


@query("""
SELECT 'big' AS action, CAST(count(*) AS BIGINT) AS n, 'before, run, after' AS steps FROM events WHERE event_type = 'purchase' AND value > 60
UNION ALL SELECT 'error', count(*), 'before, run, after' FROM events WHERE event_type = 'error'""")
def actions_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom actions of a keyed map, each decorated."""
    m, steps, counts = _users(), {}, {}
    m.map("purchase").when(lambda e, c: e.value > 60).as_action("big")
    m.map("error").as_action("error")

    def around(name: str, events: DataFrame, run) -> None:
        steps[name] = ["before"]
        run()
        steps[name].append("after")

    def action(name: str):
        def handle(events: DataFrame) -> None:
            counts[name] = events.count()
            steps[name].append("run")

        return handle

    Projector(m.build(), actions={n: action(n) for n in ("big", "error")}, around=around).project(logs.events_log(spark, sf_dir))
    return spark.createDataFrame([(n, counts[n], ", ".join(steps[n])) for n in counts], "action string, n bigint, steps string")


@query("""
WITH p AS (SELECT n_nationkey AS projector_id, CAST((n_nationkey - 5) * 10 / 100.0 AS FLOAT) AS speed, 1000 + (n_nationkey - 5) * 10 AS checkpoint, CASE WHEN n_nationkey % 7 = 6 THEN 9000000000000000000 ELSE 1000000 END AS goal FROM nation WHERE n_nationkey < 24),
e AS (SELECT *, CASE WHEN speed <> 0 THEN CAST(CAST(goal - checkpoint AS FLOAT) AS DOUBLE) / CAST(speed AS DOUBLE) END AS rest FROM p)
SELECT projector_id, checkpoint, round(CAST(speed AS DOUBLE), 6) AS speed, CASE WHEN abs(rest) <= 922337203685 THEN CAST(trunc(CAST(rest AS FLOAT)) AS BIGINT) END AS eta_seconds FROM e
UNION ALL SELECT n_nationkey, 1000, NULL, NULL FROM nation WHERE n_nationkey = 24""")
def stats_eta_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds below, at and over 0, a goal too far away, and a projector with one record."""
    n, begin = F.col("n_nationkey"), F.lit(datetime(2020, 1, 1))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.cast("long").alias("n_nationkey"))
    rows = nations.select(n.alias("projector_id"), F.explode(F.when(n == 24, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(100)))).alias("t"))
    progress = rows.select("projector_id", F.col("t").alias("seq"), F.timestamp_seconds(F.unix_timestamp(begin) + F.col("t")).alias("ts"), (1000 + F.col("t") / 10 * (F.col("projector_id") - 5)).cast("long").alias("checkpoint"))
    goal = F.when(F.col("projector_id") % 7 == 6, F.lit(9_000_000_000_000_000_000)).otherwise(1_000_000)
    return stats.time_to_reach(progress, goal).select("projector_id", "checkpoint", F.round(F.col("speed").cast("double"), 6).alias("speed"), "eta_seconds")


@query("""
WITH s AS (SELECT o_orderkey, CAST((o_orderkey % 2001 - 1000) * 997 AS BIGINT) AS x FROM orders)
SELECT o_orderkey, CAST(trunc(x / 86400.0) AS BIGINT) AS days, CAST(trunc(x / 3600.0) AS BIGINT) % 24 AS hours, CAST(trunc(x / 60.0) AS BIGINT) % 60 AS minutes, x % 60 AS seconds FROM s""")
def stats_eta_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", stats.eta_parts((F.col("o_orderkey") % 2001 - 1000) * 997).alias("p"))
    return rows.select("o_orderkey", "p.days", "p.hours", "p.minutes", "p.seconds")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS l_quantity FROM r WHERE n = 1""")
def nested_lines_with_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``nested_lines_per_order``; a returned line resets its quantity to NULL."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("v")).alias("l_quantity"))
    nested = nest(lines, "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey", "q"], ["l_partkey", "l_quantity"], "lines")
    return nested.select("l_orderkey", F.explode("lines").alias("x")).select("l_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_quantity")


#: Steps of an order's events as a document, after 100 times its key.
_KIND_OF = ("Warrant", "Certificate", "Audit", "Task", "IsolationCertificate")


def _register_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with all kinds of events, their lines as periods, nations as countries that are registered in between."""
    from foldspark.plans.documents import BODY, KINDS, PERIODS

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # dealt out by order, which serves both the distinct lines and the join
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n")).repartition("o_orderkey").distinct()
    lines = lines.join(orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    k, cust, day, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"), F.col("n")
    names = StructType.fromDDL(BODY)

    def events(rows: DataFrame, *kinds: tuple) -> DataFrame:
        """The events of ``rows`` from (condition, step, type, body) of each kind, in one pass over them."""
        each, number = rows.withColumn("_e", F.explode(F.array(*(F.lit(i) for i in range(len(kinds)))))), F.col("_e")

        def of(values: list) -> Column:
            """The value of the kind; what all kinds have ends in an ELSE, so that a filter on types that no kind gives leaves nothing to read."""
            *most, (last, otherwise) = values if len(values) == len(kinds) else [*values, (None, None)]
            out = None
            for i, x in most:
                out = F.when(number == i, x) if out is None else out.when(number == i, x)
            return F.lit(otherwise) if out is None else out if last is None else out.otherwise(otherwise)

        each = each.where(of([(i, x) for i, (x, *_) in enumerate(kinds)]))
        fields = [of([(i, body[f.name]) for i, (*_, body) in enumerate(kinds) if f.name in body]).cast(f.dataType).alias(f.name) for f in names.fields]
        step, kind = of([(i, F.lit(x) if isinstance(x, int) else x) for i, (_, x, _, _) in enumerate(kinds)]), of([(i, F.lit(x) if isinstance(x, str) else x) for i, (_, _, x, _) in enumerate(kinds)])
        return each.select((k * 100 + step).cast("long").alias("checkpoint"), kind.alias("event_type"), F.struct(*fields).alias("body"))

    always, number, later = F.lit(True), k.cast("string"), lambda d: day + F.make_dt_interval(F.lit(d) if isinstance(d, int) else d.cast("int"))
    country = lambda plus: ((cust + plus) % 25).cast("string")
    first, *others = KINDS
    creators = F.lit(first)
    for i, x in enumerate(others, 1):
        creators = F.when(k % 5 == i, x).otherwise(creators)
    opened = F.when(F.col("o_orderstatus") == "O", "Active").otherwise(F.col("o_orderstatus"))
    doc = {"DocumentNumber": number}
    period = doc | {"Sequence": n}
    made = lambda kind, plus, state: {"Number": number, "Kind": kind, "Country": country(plus), "InitialState": state}
    of_orders = events(
        orders,
        (always, 0, creators, made(F.col("o_orderpriority"), 0, opened)),
        (k % 11 == 0, 1, "ConstitutionEstablishedEvent", made(F.col("o_orderpriority"), 1, F.lit("P"))),
        (cust % 3 >= 1, 2, "AreaRestrictedEvent", doc | {"Area": F.concat(F.lit("A"), (cust % 4).cast("string"))}),
        (cust % 3 == 2, 3, "AreaRestrictionCancelledEvent", doc),
        (k % 13 == 0, 4, "CountryCorrectedEvent", doc | {"Country": country(7)}),
        (k % 4 == 0, 5, "NextReviewScheduledEvent", doc | {"NextReviewAt": later(900)}),
        (k % 6 < 2, 6, "LifetimeRestrictedEvent", doc | {"PeriodEnd": later(700)}),
        (k % 6 == 1, 7, "LifetimeRestrictionRemovedEvent", doc),
        ((k % 10).isin(1, 2), 8, "StateTransitionedEvent", doc | {"State": F.when(k % 10 == 1, "Closed").otherwise("Moved")}),
        (k % 20 == 2, 9, "StateRevertedEvent", doc | {"State": F.lit("Back")}),
        (k % 17 == 0, 90, "DocumentArchivedEvent", doc),
        (k % 34 == 0, 91, "LicenseGrantedEvent", made(F.lit("anew"), 2, F.lit("New"))),
    )
    of_lines = events(
        lines,
        (always, 20 + n, PERIODS[0], period | {"From": later(10 * n), "To": later(10 * n + 10 + F.when(n == 4, 1).otherwise(0))}),
        (n != 3, 40 + n, PERIODS[2], period),
        (n == 6, 60 + n, PERIODS[1], period),
        (n == 2, 60 + n, PERIODS[3], period | {"ClosedAt": later(10 * n + 5)}),
        (n == 5, 60 + n, PERIODS[4], period),
        ((n == 1) & (k % 3 == 0), 80, PERIODS[2], period),
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") * 500).alias("o_orderkey"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    registered = events(nations, (always, 50, "CountryRegisteredEvent", {"Code": F.col("code"), "Name": F.col("name")}))
    rows = of_orders.unionByName(of_lines).unionByName(registered)
    return logs.make_log(rows, checkpoint=F.col("checkpoint"), event_type=F.col("event_type"), body=F.col("body"))


_REGISTER = """
WITH RECURSIVE o AS (SELECT *, o_orderkey % 34 = 0 AS anew FROM orders WHERE o_orderkey % 17 <> 0 OR o_orderkey % 34 = 0),
l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN o ON o_orderkey = l_orderkey AND NOT anew),
late AS (SELECT DISTINCT k FROM l WHERE n = 1 AND k % 3 = 0),
p AS (SELECT l.k, n, CASE WHEN late.k IS NOT NULL AND n = 6 THEN NULL ELSE 10 * n END AS f,
             CASE WHEN late.k IS NOT NULL AND n = 6 THEN NULL WHEN late.k IS NOT NULL AND n = 2 THEN 10 * n + 5 ELSE 10 * n + 10 + CASE WHEN n = 4 THEN 1 ELSE 0 END END AS t
      FROM l LEFT JOIN late ON late.k = l.k WHERE n <> 3 AND NOT (late.k IS NOT NULL AND n IN (2, 5))),
c(k, n, f, t) AS (SELECT k, n, f, t FROM p q WHERE n = (SELECT max(n) FROM p WHERE p.k = q.k) UNION ALL SELECT p.k, p.n, p.f, p.t FROM c JOIN p ON p.k = c.k AND p.t IS NOT DISTINCT FROM c.f AND p.n < c.n),
v AS (SELECT k, min(n) AS low, max(n) AS high FROM c GROUP BY k),
bounds AS (SELECT v.k, a.f, b.t FROM v JOIN p a ON a.k = v.k AND a.n = v.low JOIN p b ON b.k = v.k AND b.n = v.high),
d AS (SELECT o.*, CASE WHEN anew THEN (o_custkey + 2) % 25 WHEN o_orderkey % 13 = 0 THEN (o_custkey + 7) % 25 WHEN o_orderkey % 11 = 0 THEN (o_custkey + 1) % 25 ELSE o_custkey % 25 END AS nat,
             o_orderkey * 100 + CASE WHEN anew THEN 91 WHEN o_orderkey % 13 = 0 THEN 4 WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS set_at FROM o),
r AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN anew THEN 'Audit' WHEN o_orderkey % 11 = 0 THEN 'Constitution' ELSE ['Warrant', 'Certificate', 'Audit', 'Task', 'IsolationCertificate'][CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS type,
       CASE WHEN anew THEN 'anew' ELSE o_orderpriority END AS kind, CAST(nat AS VARCHAR) AS country, CASE WHEN nat * 50000 + 50 < set_at THEN n_name ELSE '' END AS country_name,
       CASE WHEN anew THEN 'New' WHEN o_orderkey % 20 = 2 THEN 'Back' WHEN o_orderkey % 10 = 2 THEN 'Moved' WHEN o_orderkey % 11 = 0 THEN 'P' WHEN o_orderstatus = 'O' THEN 'Active' ELSE o_orderstatus END AS state,
       CASE WHEN NOT anew AND o_custkey % 3 = 1 THEN 'A' || (o_custkey % 4) END AS area, CASE WHEN NOT anew AND o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 900 DAY END AS next_review_at,
       CASE WHEN NOT anew AND o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 700 DAY END AS lifetime_end, o_orderdate + to_days(CAST(f AS INTEGER)) AS starts, o_orderdate + to_days(CAST(t AS INTEGER)) AS ends,
       CAST((SELECT count(*) FROM l WHERE l.k = o_orderkey) AS INTEGER) AS n_periods
FROM d JOIN nation ON n_nationkey = nat LEFT JOIN bounds ON bounds.k = o_orderkey)
"""


@query(_REGISTER + "SELECT * FROM r")
def document_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the register: kinds, lookups as of the event, cleared fields, periods with resets, closings and approvals, archived and created anew."""
    return documents.register(_register_log(spark, sf_dir)).select(
        "key", "type", "kind", "country", "country_name", "state", "area", "next_review_at", "lifetime_end", "starts", "ends", F.size("periods").alias("n_periods")
    )


@query(_REGISTER + """, s AS (SELECT country, area, kind, CASE WHEN state <> 'Active' THEN state WHEN TIMESTAMP '1997-06-15' > next_review_at THEN 'InReview' WHEN TIMESTAMP '1997-06-15' > lifetime_end THEN 'Expired'
  WHEN TIMESTAMP '1997-06-15' > ends THEN 'Revalidate' WHEN TIMESTAMP '1997-06-15' < starts THEN 'AwaitingActivation' ELSE 'Active' END AS state FROM r WHERE kind = '1-URGENT')
SELECT country, n_name AS country_name, area, kind, state, count(*) AS count FROM s JOIN nation ON CAST(n_nationkey AS VARCHAR) = country GROUP BY ALL""")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's counts by state at a time; each country must be registered exactly once."""
    log = _register_log(spark, sf_dir)
    names = Projector(documents.countries()).project(log).state
    return documents.counts_per_state(documents.register(log, NOW), names, kind="1-URGENT")


@query("""SELECT 'country 24 is missing from the lookup' AS error UNION ALL SELECT 'country 3 is more than once in the lookup' UNION ALL SELECT 'country 99 is missing from the lookup'""")
def required_lookup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    docs, errors = nations.select(F.col("key").alias("country"), F.lit("a").alias("area"), F.lit("k").alias("kind"), F.lit("s").alias("state")), []
    for lookup, country in ((nations.where("key <> '24'"), None), (nations.unionByName(nations.where("key = '3'")), None), (nations, "99")):
        try:
            documents.counts_per_state(docs, lookup, country=country)
        except LookupError as error:
            errors.append((str(error),))
    return spark.createDataFrame(errors, "error string")
