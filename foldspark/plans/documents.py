"""A document register as a worked example: lookups of countries, documents with states and validity periods, counts by state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.fold import ORDER, final_rows
from foldspark.operators.projector import Projector
from foldspark.plans.event_map import EventMapBuilder, ProjectionPlan
from foldspark.sources.tables import written

#: The kind that each creating event gives; the first is an update of a document that must exist.
KINDS = {
    "WarrantAssignedEvent": "Warrant",
    "CertificateIssuedEvent": "Certificate",
    "LicenseGrantedEvent": "Audit",
    "ContractNegotiatedEvent": "Task",
    "BondIssuedEvent": "IsolationCertificate",
}
#: The names of events of validity periods.
PERIODS = ["ValidityPeriodPlannedEvent", "ValidityPeriodResetEvent", "ValidityPeriodApprovedEvent", "ValidityPeriodClosedEvent", "ValidityPeriodCanceledEvent"]
BODY = "Code string, Name string, Number string, DocumentNumber string, Kind string, Country string, InitialState string, State string, Area string, NextReviewAt timestamp_ntz, PeriodEnd timestamp_ntz, Sequence int, `From` timestamp_ntz, `To` timestamp_ntz, ClosedAt timestamp_ntz"


def countries() -> ProjectionPlan:
    m = EventMapBuilder("countries", "string", {"name": "string"})
    m.map("CountryRegisteredEvent").as_create_of(lambda e, c: e.Code).using(name=lambda e, c: e.Name)
    return m.build()


def documents() -> ProjectionPlan:
    """Reads the name of a document's country from the child ``countries`` as it is when the country is set, empty if it is not registered then.

    Period events also update their document, so a period of a missing one is a miss.
    """
    m = EventMapBuilder("documents", "string", {"type": "string", "kind": "string", "country": "string", "country_name": "string", "state": "string", "area": "string", "next_review_at": "timestamp_ntz", "lifetime_end": "timestamp_ntz"})
    # functions that rules share are worked out once for all of them
    number, own, kind, initial, state = (lambda e, c, n=n: e[n] for n in ("DocumentNumber", "Number", "Kind", "InitialState", "State"))
    of_country = {"country": lambda e, c: e.Country, "country_name": lambda e, c: F.coalesce(c.child("countries", e.Country).name, F.lit(""))}
    for event, name in KINDS.items():
        m.map(event).as_create_of(own).using(type=F.lit(name), kind=kind, state=initial, **of_country)
    m.map("ConstitutionEstablishedEvent").as_update_of(own).using(type=F.lit("Constitution"), kind=kind, state=initial, **of_country)
    m.map("AreaRestrictedEvent").as_update_of(number).using(area=lambda e, c: e.Area)
    m.map("AreaRestrictionCancelledEvent").as_update_of(number).using(area=F.lit(None))
    m.map("CountryCorrectedEvent").as_update_of(number).using(**of_country)
    m.map("NextReviewScheduledEvent").as_update_of(number).using(next_review_at=lambda e, c: e.NextReviewAt)
    m.map("LifetimeRestrictedEvent").as_update_of(number).using(lifetime_end=lambda e, c: e.PeriodEnd)
    m.map("LifetimeRestrictionRemovedEvent").as_update_of(number).using(lifetime_end=F.lit(None))
    m.map("StateTransitionedEvent").when(lambda e, c: ~e.State.eqNullSafe(F.lit("Closed"))).as_update_of(number).using(state=state)
    m.map("StateRevertedEvent").as_update_of(number).using(state=state)
    m.map("DocumentArchivedEvent").as_delete_of(number)
    for event in PERIODS:
        m.map(event).as_update_of(number).using()
    return m.build()


#: A period as documents hold it.
PERIOD = "struct<sequence: int, `from`: timestamp_ntz, `to`: timestamp_ntz, status: string>"


def _touch() -> dict[str, Column]:
    """What an event does to a period of its document, as columns of its ops: NULL in ``touch`` if nothing."""
    planned, reset, approved, closed, canceled = PERIODS
    kind, b = F.col("event_type"), F.col("body")
    return {
        "touch": F.when(kind == planned, "planned").when(kind == reset, "reset").when(kind == approved, "Valid").when(kind == closed, "Closed").when(kind == canceled, "Canceled"),
        "sequence": b.Sequence, "starts": F.when(kind == planned, b["From"]), "ends": F.when(kind == planned, b["To"]).when(kind == closed, b.ClosedAt),
    }


def _touched(periods: Column, t: Column) -> Column:
    """``periods`` after the touch ``t``; one that is not there yet comes last."""

    def after(p: Column | None) -> Column:
        both, status = t["touch"].isin("planned", "reset"), t["touch"]
        none = lambda kind: F.lit(None).cast(kind)
        start, end, old = (none("timestamp_ntz"), none("timestamp_ntz"), none("string")) if p is None else (p["from"], p["to"], p["status"])
        return F.struct(
            t["sequence"].alias("sequence"), F.when(both, t["starts"]).otherwise(start).alias("from"),
            F.when(both | (status == "Closed"), t["ends"]).otherwise(end).alias("to"), F.when(both, old).otherwise(status).alias("status"),
        )

    same = lambda p: p["sequence"].eqNullSafe(t["sequence"])
    return F.when(F.exists(periods, same), F.transform(periods, lambda p: F.when(same(p), after(p)).otherwise(p))).otherwise(F.concat(periods, F.array(after(None))))


def adjoining(valid: Column) -> Column:
    """Of valid periods those that lead up to the last one, that one first: before each the one that ends where it starts, two NULLs being equal.

    Of several such the first touched one counts, and none counts twice.
    """

    def back(chain: Column, _: Column) -> Column:
        now = F.get(chain, F.size(chain) - 1)
        before = F.get(F.filter(valid, lambda p: p["to"].eqNullSafe(now["from"]) & ~F.exists(chain, lambda c: c["sequence"].eqNullSafe(p["sequence"]))), F.lit(0))
        return F.when(before.isNull(), chain).otherwise(F.concat(chain, F.array(before)))

    return F.aggregate(valid, F.slice(valid, F.greatest(F.size(valid), F.lit(1)), 1), back)


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents with periods, in order of first touch, starts and ends in place of ``touches``, what the ops of their incarnations did to periods.

    The dates are those of the chain that the last approval saw; later events leave them.
    """
    docs = docs.withColumn("touches", F.sort_array(F.filter("touches", lambda t: t["incarnation"] == F.col("last_incarnation"))))
    upto = F.array_max(F.transform("touches", lambda t, n: F.when(t["touch"] == "Valid", n + 1)))  # the last approval's place
    docs = docs.withColumn("upto", F.coalesce(upto, F.lit(0)))
    docs = docs.withColumn("seen", F.aggregate(F.slice("touches", 1, F.col("upto")), F.array().cast(f"array<{PERIOD}>"), _touched))
    docs = docs.withColumn("chain", F.filter("seen", lambda p: p["status"] == "Valid")).withColumn("chain", adjoining(F.col("chain")))
    # by sequence: the first one's start and the last one's end
    low = F.array_min(F.transform("chain", lambda p: F.struct(p["sequence"], p["from"].alias("at"))))
    high = F.array_max(F.transform("chain", lambda p: F.struct(p["sequence"], p["to"].alias("at"))))
    periods = F.aggregate(F.slice("touches", F.col("upto") + 1, F.size("touches")), F.col("seen"), _touched)
    return docs.withColumns({"periods": periods, "starts": low["at"], "ends": high["at"]}).drop("touches", "upto", "seen", "chain", "last_incarnation")


def realtime_state(state: Column, next_review_at: Column, expiration: Column, start: Column, end: Column, now: Column | datetime) -> Column:
    """What an Active document is at ``now``; other states are as they are. NULL bounds never hold."""
    at = now if isinstance(now, Column) else F.lit(now)
    derived = F.when(at > next_review_at, "InReview").when(at > expiration, "Expired").when(at > end, "Revalidate").when(at < start, "AwaitingActivation").otherwise("Active")
    return F.when(~state.eqNullSafe(F.lit("Active")), state).otherwise(derived)


def required(rows: DataFrame, lookup: DataFrame, key: str, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name``: the one ``lookup`` row (key, name) of each ``key``. A key that is missing there, or there more than once, is an error.

    The check is one row for each distinct key of ``rows``, or of ``wanted``, where keys must be there without having rows.
    """
    keys = (rows if wanted is None else wanted).select(F.col(key).alias("_key")).distinct()
    found = lookup.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias(name))
    bad = keys.join(found, F.col("_key").eqNullSafe(F.col("_k")), "left").where("_n is null or _n > 1").select("_key", F.coalesce("_n", F.lit(0)).alias("n")).orderBy("_key").take(1)
    if bad:
        raise LookupError(f"{key} {bad[0][0]} is {'missing from' if not bad[0].n else 'more than once in'} the lookup")
    return rows.drop(name).join(found, F.col(key).eqNullSafe(F.col("_k"))).drop("_k", "_n")


def counts_per_state(docs: DataFrame, lookup: DataFrame, kind: str | None = None, country: str | None = None) -> DataFrame:
    """(country, country_name, area, kind, state, count) over (country, area, kind, state) rows.

    The name comes from ``lookup`` as it is now, where each country must be exactly once (see ``required``).
    """
    rows = docs
    for column, value in (("kind", kind), ("country", country)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    # the small aggregate is worked out once, for the check and for the result
    counted = written(rows.groupBy("country", "area", "kind", "state").agg(F.count(F.lit(1)).alias("count")), "counts")
    wanted = None if country is None else docs.sparkSession.range(1).select(F.lit(country).alias("country"))
    return required(counted, lookup, "country", "country_name", wanted).select("country", "country_name", "area", "kind", "state", "count")


def register(log: DataFrame, now: datetime | None = None) -> DataFrame:
    """Documents at the end of ``log`` with their periods and validity; with ``now`` their state is the one that holds then.

    One shuffle and one sort by document serve the flags of its ops, its fields and its periods.
    """
    plan = documents()
    flagged = Projector(plan, [Projector(countries())]).flagged(log, **_touch())
    touches = F.collect_list(F.when(F.col("effective") & F.col("touch").isNotNull(), F.struct(*ORDER, "incarnation", "touch", "sequence", "starts", "ends")))
    docs = with_periods(final_rows(plan, flagged, touches=touches))
    if now is None:
        return docs
    return docs.withColumn("state", realtime_state(F.col("state"), F.col("next_review_at"), F.col("lifetime_end"), F.col("starts"), F.col("ends"), F.lit(now).cast("timestamp_ntz")))
