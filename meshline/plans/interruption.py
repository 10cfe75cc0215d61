"""The interruption layer: deduplication of polls and the rules that make
interruptions (ETL-14 to ETL-16)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.columns import content_hash, decode, joined, local_date_key
from meshline.operators.graph import keep_first

#: Seconds from which a trip is delayed, and severely.
DELAY, SEVERE_DELAY = 300, 900
#: What an alert's effect makes, and the label of each kind.
EFFECT_KIND = {
    "NO_SERVICE": "cancellation",
    "REDUCED_SERVICE": "service_change",
    "SIGNIFICANT_DELAYS": "delay",
    "DETOUR": "detour",
    "MODIFIED_SERVICE": "service_change",
    "STOP_MOVED": "service_change",
    "ACCESSIBILITY_ISSUE": "accessibility",
    "OTHER_EFFECT": "service_change",
}
KIND_LABEL = {"cancellation": "Cancellation", "delay": "Delay", "skip": "Skip", "detour": "Detour", "service_change": "ServiceChange", "accessibility": "Accessibility"}

COLUMNS = ("interruption_id", "interruption_type", "label", "cause", "effect", "severity", "start_time", "end_time", "description", "date")


@dataclass(frozen=True)
class Interruptions:
    interruptions: DataFrame
    sources: DataFrame
    affects_trip: DataFrame
    affects_route: DataFrame
    affects_stop: DataFrame


def dedup_hash(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Trip updates with `dedup_hash` over the trip's state and its stops' in
    sequence (STR-13, AG-15): one aggregation and one join."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    state = F.concat_ws(":", empty("stop_sequence"), empty("schedule_relationship"), empty("arrival_delay"), empty("departure_delay"))
    of_trip = stops.groupBy(F.col("parent_entity_id").alias("__id")).agg(joined(state, "|", F.coalesce("stop_sequence", F.lit(1 << 30)).alias("__seq")).alias("__states"))
    with_states = trips.join(of_trip, F.col("feed_entity_id") == F.col("__id"), "left")
    return with_states.withColumn("dedup_hash", content_hash(F.col("trip_id"), F.col("start_date"), F.col("schedule_relationship"), F.col("delay"), F.col("__states"))).drop("__id", "__states")


def unique_updates(trips: DataFrame) -> DataFrame:
    """One update for each hash, the first entity."""
    return keep_first(trips, ["dedup_hash"], [F.col("feed_entity_id")])


def trip_rules(trips: DataFrame, stops: DataFrame) -> Interruptions:
    """Rules 1 to 3: a cancelled trip; a delay of DELAY or more of one that
    isn't; a skipped stop. A skip whose trip update was a duplicate keeps nulls
    for the trip (Q-24)."""
    null = F.lit(None).cast("string")
    cancelled = F.col("schedule_relationship") == "CANCELED"
    late = (F.col("delay") >= DELAY) & ~cancelled
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    trip_name = F.coalesce(F.col("trip_id"), F.lit("None"))
    of_trips = trips.where(cancelled | late).select(
        F.concat(F.lit("int_tu_"), "feed_entity_id").alias("interruption_id"),
        F.when(cancelled, "cancellation").otherwise("delay").alias("interruption_type"),
        F.when(cancelled, "Cancellation").otherwise("Delay").alias("label"),
        null.alias("cause"),
        F.when(cancelled, "NO_SERVICE").otherwise("SIGNIFICANT_DELAYS").alias("effect"),
        F.when(cancelled | (F.col("delay") >= SEVERE_DELAY), "SEVERE").otherwise("WARNING").alias("severity"),
        F.col("timestamp").alias("start_time"),
        F.lit(None).cast("long").alias("end_time"),
        F.when(cancelled, text("Trip ", trip_name, " cancelled")).otherwise(text("Trip ", trip_name, " delayed ", F.col("delay").cast("string"), "s")).alias("description"),
        F.col("start_date").alias("date"),
        F.col("feed_entity_id").alias("source_entity_id"),
        "trip_id",
        "route_id",
        null.alias("stop_id"),
    )
    parent = trips.select(F.col("feed_entity_id").alias("__id"), "start_date", "timestamp", "trip_id", "route_id")
    skipped = stops.where("schedule_relationship = 'SKIPPED'").join(parent, F.col("parent_entity_id") == F.col("__id"), "left").select(
        F.concat(F.lit("int_skip_"), "parent_entity_id", F.lit("_"), F.coalesce(F.col("stop_sequence").cast("string"), F.lit("None"))).alias("interruption_id"),
        F.lit("skip").alias("interruption_type"),
        F.lit("Skip").alias("label"),
        null.alias("cause"),
        F.lit("STOP_MOVED").alias("effect"),
        F.lit("WARNING").alias("severity"),
        F.col("timestamp").alias("start_time"),
        F.lit(None).cast("long").alias("end_time"),
        text("Stop ", F.coalesce(F.col("stop_id"), F.lit("None")), " skipped").alias("description"),
        F.col("start_date").alias("date"),
        F.col("parent_entity_id").alias("source_entity_id"),
        "trip_id",
        "route_id",
        "stop_id",
    )
    every = of_trips.unionByName(skipped)
    affects = lambda c: every.where(F.col(c).isNotNull()).select("interruption_id", c).distinct()
    return Interruptions(every.select(*COLUMNS), every.select("interruption_id", "source_entity_id", F.lit("TripUpdate").alias("source_type")), affects("trip_id"), affects("route_id"), affects("stop_id"))


def alert_rules(alerts: DataFrame, selectors: DataFrame, zone: str = "America/New_York") -> Interruptions:
    """Rule 4: alerts of mapped effects; what they affect comes from their
    selectors. The date is that of the start in an explicit zone (Q-14)."""
    kind = decode(F.col("effect"), EFFECT_KIND)
    mapped = alerts.withColumn("interruption_type", kind).where("interruption_type is not null").withColumn("interruption_id", F.concat(F.lit("int_sa_"), "feed_entity_id"))
    rows = mapped.select(
        "interruption_id",
        "interruption_type",
        decode(F.col("interruption_type"), KIND_LABEL, "ServiceChange").alias("label"),
        "cause",
        "effect",
        F.coalesce("severity_level", F.lit("UNKNOWN_SEVERITY")).alias("severity"),
        F.col("active_period_start").alias("start_time"),
        F.col("active_period_end").alias("end_time"),
        F.col("header_text").alias("description"),
        local_date_key(F.col("active_period_start"), zone).alias("date"),
    )
    met = selectors.join(mapped.select(F.col("feed_entity_id").alias("parent_entity_id"), "interruption_id"), "parent_entity_id")
    affects = lambda c: met.where(F.col(c).isNotNull()).select("interruption_id", c).distinct()
    sources = mapped.select("interruption_id", F.col("feed_entity_id").alias("source_entity_id"), F.lit("ServiceAlert").alias("source_type"))
    return Interruptions(rows, sources, affects("trip_id"), affects("route_id"), affects("stop_id"))


def combined(*parts: Interruptions) -> Interruptions:
    return Interruptions(*(reduce(DataFrame.unionByName, (getattr(p, name) for p in parts)) for name in ("interruptions", "sources", "affects_trip", "affects_route", "affects_stop")))


def during_maintenance(interruptions: DataFrame, active_on: DataFrame, services: DataFrame) -> DataFrame:
    """Rule 6: (interruption_id, service_id) of interruptions on a date on which
    a maintenance service is active."""
    planned = active_on.join(services.where("label = 'Maintenance'").select("service_id"), "service_id", "left_semi").select("date", "service_id")
    return interruptions.select("interruption_id", "date").join(planned, "date").select("interruption_id", "service_id").distinct()
