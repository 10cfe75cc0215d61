"""The checks of each layer, before its tables are made and after they are
written (VAL-01 to VAL-05). Each list is run by operators.validate.run_checks,
which counts all conditions on a table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.operators.validate import Check, Result, run_checks

#: What the known feed has; a difference is a warning.
EXPECTED_ZONES, EXPECTED_LEG_RULES = 42, 9509
#: Share of active outages that should have a pathway.
MATCH_RATE = 0.95


def child() -> F.Column:
    kind, stop = F.col("location_type").try_cast("int"), F.col("stop_id")
    return (kind == 2) | F.contains(stop, F.lit("_FG_")) | (kind.isin(0, 4) & F.upper(stop).startswith("PF_"))


def physical_before() -> list[Check]:
    """Over raw `stops`, `pathways`; `children` are stops() that need a parent."""
    mode = F.col("pathway_mode").try_cast("int")
    return [
        Check("stops: one row for each id", "stops", unique=("stop_id",)),
        Check("children: the parent exists", "children", refers=("parent_station", "stops", "stop_id")),
        Check("children: a parent is named", "children", F.col("parent_station").isNull(), "warning"),
        Check("pathways: the first end exists", "pathways", refers=("from_stop_id", "stops", "stop_id"), level="warning"),
        Check("pathways: the second end exists", "pathways", refers=("to_stop_id", "stops", "stop_id"), level="warning"),
        Check("pathways: mode from 1 to 7", "pathways", F.coalesce(~mode.between(1, 7), F.lit(True)), "warning"),
        Check("stops: some", "stops", non_empty=True),
        Check("pathways: some", "pathways", non_empty=True),
    ]


def physical_after() -> list[Check]:
    """Over node tables and `links`, `contains`, `level_links`."""
    has = lambda name: F.array_contains("labels", name)
    return [
        Check("Station: one for each id", "Station", unique=("id",)),
        Check("Platform: one for each id", "Platform", unique=("id",)),
        Check("FareGate: one for each id", "FareGate", unique=("id",)),
        Check("Pathway: mode 4 is an Escalator", "Pathway", (F.col("mode") == 4) & ~has("Escalator")),
        Check("Pathway: mode 5 is an Elevator", "Pathway", (F.col("mode") == 5) & ~has("Elevator")),
        Check("Pathway: linked", "Pathway", refers=("pathway_id", "links", "pathway_id"), level="warning"),
        Check("Station: has a platform", "Station", refers=("id", "platforms", "station_id"), level="warning"),
        Check("Level: linked", "Level", refers=("level_id", "level_links", "level_id"), level="warning"),
    ]


def schedule_before() -> list[Check]:
    """Over raw tables; `shape_routes` is distinct (shape_id, route_id), `services` every service id."""
    return [
        Check("trips: one row for each id", "trips", unique=("trip_id",)),
        Check("shapes: of one route", "shape_routes", unique=("shape_id",)),
        Check("trips: the service exists", "trips", refers=("service_id", "services", "service_id")),
        Check("stop_times: the stop exists", "stop_times", refers=("stop_id", "stops", "stop_id"), level="warning"),
        Check("trips: a shape is named", "trips", F.col("shape_id").isNull(), "warning"),
        Check("calendar: maintenance beyond the feed", "calendar", F.col("service_id").endswith("_R") & (F.col("end_date") > F.col("feed_end_date")), "info"),
    ]


def schedule_after() -> list[Check]:
    return [
        Check("Trip: one for each id", "Trip", unique=("trip_id",)),
        Check("RoutePattern: one for each id", "RoutePattern", unique=("shape_id",)),
        Check("Route: one for each id", "Route", unique=("route_id",)),
        Check("ServicePattern: one for each id", "ServicePattern", unique=("service_id",)),
        Check("Date: one for each date", "Date", unique=("date",)),
        Check("Trip: of one service", "operated_on", unique=("trip_id",)),
        Check("Trip: has a service", "Trip", refers=("trip_id", "operated_on", "trip_id")),
        Check("Trip: of one pattern", "follows", unique=("trip_id",)),
        Check("active_on: once for each date", "active_on", unique=("service_id", "date")),
        Check("Date: inside the feed", "Date", (F.col("date") < F.col("feed_start_date")) | (F.col("date") > F.col("feed_end_date")), "warning"),
    ]


def fare_before() -> list[Check]:
    """`areas` is (area_id) of rail rules, `zones` distinct (stop_id, zone_id), `gates` gate zones beside their station's."""
    return [
        Check("areas: in a zone", "areas", refers=("area_id", "zones", "stop_id")),
        Check("rules: a rail rule with a price has a first area", "rail_rules", F.col("from_area_id").isNull() & ~F.col("fare_product_id").startswith("metrorail_free")),
        Check("zones: one for each stop", "zones", unique=("stop_id",)),
        Check("gates: the station's zone", "gates", F.col("zone_id") != F.col("station_zone")),
        Check("gates: a parent is named", "gates", F.col("parent_station").isNull(), "warning"),
    ]


def fare_after() -> list[Check]:
    return [
        Check("FareGate: of a station", "FareGate", refers=("parent_station", "Station", "id")),
        Check("FareLegRule: from a zone", "rail_rules", refers=("rule_id", "from_area", "rule_id")),
        Check("FareGate: a zone", "FareGate", F.col("zone_id").isNull()),
    ]


def expected_counts(zones: DataFrame, rules: DataFrame, result: Result) -> Result:
    """Counts that differ from the known feed's are warnings."""
    for name, df, want in (("fare zones", zones, EXPECTED_ZONES), ("fare leg rules", rules, EXPECTED_LEG_RULES)):
        if (n := df.count()) != want:
            result.warnings.append(f"{name}: {n}, {want} expected")
    return result


def interruption_before() -> list[Check]:
    known = F.col("interruption_id").rlike("^int_(tu|sa|skip)_")
    return [
        Check("trip updates: one for each hash", "trip_updates", unique=("dedup_hash",)),
        Check("alerts: one for each entity", "service_alerts", unique=("feed_entity_id",)),
        Check("interruptions: one for each id", "interruptions", unique=("interruption_id",)),
        Check("interruptions: a known prefix", "interruptions", ~known, "warning"),
        Check("sources: of a known interruption", "sources", refers=("interruption_id", "interruptions", "interruption_id")),
        Check("trip updates: a trip is named", "trip_updates", F.col("trip_id").isNull(), "warning"),
        Check("alerts: an effect that makes one", "service_alerts", ~F.col("effect").isin("NO_SERVICE", "REDUCED_SERVICE", "SIGNIFICANT_DELAYS", "DETOUR", "MODIFIED_SERVICE", "STOP_MOVED", "ACCESSIBILITY_ISSUE", "OTHER_EFFECT"), "warning"),
    ]


def interruption_after() -> list[Check]:
    return [
        Check("TripUpdate: one for each hash", "TripUpdate", unique=("dedup_hash",)),
        Check("ServiceAlert: one for each entity", "ServiceAlert", unique=("feed_entity_id",)),
        Check("Interruption: one for each id", "Interruption", unique=("interruption_id",)),
        Check("Interruption: has a source", "Interruption", refers=("interruption_id", "sources", "interruption_id")),
        Check("Interruption: on a date", "Interruption", F.col("date").isNull(), "warning"),
        Check("Cancellation and Delay: a trip", "late_or_cancelled", refers=("interruption_id", "affects_trip", "interruption_id"), level="warning"),
    ]


def accessibility_before() -> list[Check]:
    return [Check("outages: one for each key", "outages", unique=("composite_key",)), Check("outages: severity from 2 to 4", "outages", ~F.col("severity").isin(2, 3, 4), "warning")]


def match_rate(outages: DataFrame, affects: DataFrame, least: float = MATCH_RATE) -> Result:
    """Active outages: none, or fewer with a pathway than `least`, is a warning."""
    result = Result()
    found = outages.where("status = 'active'").select("composite_key").distinct().join(affects.select("composite_key").distinct().withColumn("hit", F.lit(1)), "composite_key", "left")
    n, hit = found.agg(F.count("*"), F.count("hit")).first()
    if not n:
        result.warnings.append("no active outage")
    elif hit < least * n:
        result.warnings.append(f"{hit} of {n} active outages have a pathway")
    else:
        result.infos.append(f"{hit} of {n} active outages have a pathway")
    return result


def gate(tables: dict[str, DataFrame], checks: list[Check], blocking: bool = True) -> Result:
    """Run a list; errors stop the layer unless it doesn't block."""
    result, _ = run_checks(tables, checks)
    if blocking:
        result.raise_if_failed()
    return result
