"""Polled sources: incidents as JSON, real-time trip updates and alerts.

Landed polls are read as DataFrames of nested records, one schema for JSON and
for decoded protobuf, and flattened by explode.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.functions.columns import decode, largest_delay, translation
from meshline.session import cut
from meshline.sources.wire import messages

log = logging.getLogger(__name__)

#: Enumerations of the real-time format.
TRIP_RELATION = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED"}
STOP_RELATION = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA"}
CAUSE = {
    1: "UNKNOWN_CAUSE", 2: "OTHER_CAUSE", 3: "TECHNICAL_PROBLEM", 4: "STRIKE", 5: "DEMONSTRATION", 6: "ACCIDENT",
    7: "HOLIDAY", 8: "WEATHER", 9: "MAINTENANCE", 10: "CONSTRUCTION", 11: "POLICE_ACTIVITY", 12: "MEDICAL_EMERGENCY",
}
EFFECT = {
    1: "NO_SERVICE", 2: "REDUCED_SERVICE", 3: "SIGNIFICANT_DELAYS", 4: "DETOUR", 5: "ADDITIONAL_SERVICE", 6: "MODIFIED_SERVICE",
    7: "OTHER_EFFECT", 8: "UNKNOWN_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT", 11: "ACCESSIBILITY_ISSUE",
}
#: The order of effects that earlier results were made with.
EFFECT_COMPATIBLE = {
    1: "UNKNOWN_EFFECT", 2: "NO_SERVICE", 3: "REDUCED_SERVICE", 4: "SIGNIFICANT_DELAYS", 5: "DETOUR", 6: "ADDITIONAL_SERVICE",
    7: "MODIFIED_SERVICE", 8: "OTHER_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT", 11: "ACCESSIBILITY_ISSUE",
}
SEVERITY = {1: "UNKNOWN_SEVERITY", 2: "INFO", 3: "WARNING", 4: "SEVERE"}

TEXT = "array<struct<language:string,text:string>>"
ENTITY = f"""id string,
trip_update struct<
  trip: struct<trip_id:string, route_id:string, start_date:string, start_time:string, schedule_relationship:int>,
  delay:int, timestamp:long,
  stop_time_update: array<struct<stop_sequence:int, stop_id:string, schedule_relationship:int,
    arrival: struct<delay:int, time:long>, departure: struct<delay:int, time:long>>>>,
alert struct<cause:int, effect:int, severity_level:int, header_text:{TEXT}, description_text:{TEXT}, url:{TEXT},
  active_period: array<struct<start:long, end:long>>,
  informed_entity: array<struct<agency_id:string, route_id:string, stop_id:string, trip:struct<trip_id:string>>>>"""


def read_json(spark: SparkSession, path: str, schema: str, source: str = "") -> DataFrame:
    """Landed JSON lines (SRC-05), tagged with their source."""
    return spark.read.schema(schema).json(path).withColumn("source", F.lit(source))


def read_messages(spark: SparkSession, path: str, decode_message: Callable[[bytes], list[dict]] = messages, source: str = "") -> DataFrame:
    """Landed binary messages (SRC-06): files are read by Spark and decoded where
    they lie, a file a row; `decode_message` gives a message's entities as JSON
    text or dicts, by default those of a real-time feed message."""
    import json

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [e if isinstance(e, str) else json.dumps(e) for raw in batch.column(0).to_pylist() for e in decode_message(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["entity"])

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(run, "entity string").select(F.from_json("entity", ENTITY).alias("e"))
    return parsed.select("e.*", F.lit(source).alias("source"))


def read_all(sources: dict[str, Callable[[], DataFrame]], land: bool = True) -> DataFrame | None:
    """The union of all sources that answer, each row tagged; one that fails is
    left out and logged (SRC-07). land: each source is read and written to the
    shared folder by itself, so one that can't be read to its end fails alone."""
    out = None
    for name, read in sources.items():
        try:
            part = read().withColumn("source", F.lit(name))
            part = cut(part, "source") if land else part.select("*")  # a missing path fails in analysis
        except Exception as e:  # any source can be down
            log.warning("source %s is left out: %s", name, str(e).splitlines()[0])
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def trip_updates(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trip_updates, stop_time_updates) of entities (SRC-08). A trip's delay is
    its own, else the largest non-zero delay of its stops."""
    tu = entities.where("trip_update is not null")
    stops = F.col("trip_update.stop_time_update")
    delays = F.concat(F.coalesce(F.transform(stops, lambda s: s["arrival"]["delay"]), F.array().cast("array<int>")), F.coalesce(F.transform(stops, lambda s: s["departure"]["delay"]), F.array().cast("array<int>")))
    trip = F.col("trip_update.trip")
    trips = tu.select(
        F.col("id").alias("feed_entity_id"),
        trip["trip_id"].alias("trip_id"),
        trip["route_id"].alias("route_id"),
        trip["start_date"].alias("start_date"),
        trip["start_time"].alias("start_time"),
        decode(trip["schedule_relationship"], TRIP_RELATION, "SCHEDULED").alias("schedule_relationship"),
        largest_delay(F.col("trip_update.delay"), delays).alias("delay"),
        F.col("trip_update.timestamp").alias("timestamp"),
        "source",
    )
    s = tu.select(F.col("id").alias("parent_entity_id"), F.explode(stops).alias("s"))
    each = s.select(
        "parent_entity_id",
        "s.stop_sequence",
        "s.stop_id",
        F.col("s.arrival.delay").alias("arrival_delay"),
        F.col("s.arrival.time").alias("arrival_time"),
        F.col("s.departure.delay").alias("departure_delay"),
        F.col("s.departure.time").alias("departure_time"),
        decode(F.col("s.schedule_relationship"), STOP_RELATION, "SCHEDULED").alias("schedule_relationship"),
    )
    return trips, each


def service_alerts(entities: DataFrame, effects: dict = EFFECT_COMPATIBLE) -> tuple[DataFrame, DataFrame]:
    """(service_alerts, entity_selectors) of entities (SRC-09): the first active
    period; selectors are numbered within their alert."""
    a = entities.where("alert is not null")
    period = F.try_element_at("alert.active_period", F.lit(1))
    alerts = a.select(
        F.col("id").alias("feed_entity_id"),
        decode(F.col("alert.cause"), CAUSE, "UNKNOWN_CAUSE").alias("cause"),
        decode(F.col("alert.effect"), effects, "UNKNOWN_EFFECT").alias("effect"),
        decode(F.col("alert.severity_level"), SEVERITY, "UNKNOWN_SEVERITY").alias("severity_level"),
        translation(F.col("alert.header_text")).alias("header_text"),
        translation(F.col("alert.description_text")).alias("description_text"),
        translation(F.col("alert.url")).alias("url"),
        period["start"].alias("active_period_start"),
        period["end"].alias("active_period_end"),
        "source",
    )
    s = a.select(F.col("id").alias("parent_entity_id"), F.posexplode("alert.informed_entity").alias("i", "s"))
    selectors = s.select("parent_entity_id", F.concat_ws("_sel_", "parent_entity_id", F.col("i").cast("string")).alias("selector_group_id"), "s.agency_id", "s.route_id", "s.stop_id", F.col("s.trip.trip_id").alias("trip_id"))
    return alerts, selectors


#: The incident source's records.
INCIDENT = "UnitName string, UnitType string, UnitStatus string, StationCode string, StationName string, LocationDescription string, SymptomCode string, SymptomDescription string, TimeOutOfService string, TimeUpdated string, DisplayOrder int, DateOutOfService string, DateUpdated string, EstimatedReturnToService string"


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Outage incidents: a document with a list, or one record a line."""
    raw = spark.read.schema(f"ElevatorIncidents array<struct<{INCIDENT.replace(' string', ':string').replace(' int', ':int')}>>, {INCIDENT}").option("multiLine", True).json(path)
    listed = raw.where("ElevatorIncidents is not null").select(F.explode("ElevatorIncidents").alias("i")).select("i.*")
    return listed.unionByName(raw.where("ElevatorIncidents is null").drop("ElevatorIncidents"))
