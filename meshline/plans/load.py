"""Loading layers: read, check, transform, write node and edge tables, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators.graph import PropertyGraph
from meshline.plans import checks, fare, physical, schedule
from meshline.sources.feeds import tables_of
from meshline.sources.sinks import write_table


def load_physical(feed: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Stations, platforms, gates, entrances, pathways, levels and their edges,
    written below `out`; the tables as read again."""
    t = tables_of(feed, "physical")
    spark = t["stops"].sparkSession
    checks.gate({**t, "children": t["stops"].where(checks.child())}, checks.physical_before())
    kinds = physical.stop_kinds(t["stops"])
    ends = physical.endpoints(t["pathways"], kinds)
    physical.require_endpoints(ends)
    links = physical.links(t["pathways"], kinds)
    contains = physical.contains(kinds)
    level = physical.level_links(t["pathways"], kinds, t["levels"])
    tables = {
        "Station": kinds.where("is_station"), "Platform": kinds.where("is_platform"), "FareGate": kinds.where("is_gate"), "StationEntrance": kinds.where("is_entrance"), "BusStop": kinds.where("is_bus_stop"),
        "Pathway": physical.sides(t["pathways"], kinds), "Level": t["levels"].drop("_ordinal"), "links": links, "chains": physical.chains(t["pathways"], ends), "contains": contains, "station_pathways": physical.station_pathways(contains, links), **level,
    }
    done = written(spark, tables, out)
    every = done["on_level"].unionByName(done["starting_level"]).unionByName(done["ending_level"])
    checks.gate({**done, "platforms": done["contains"].where("label = 'Platform'"), "level_links": every}, checks.physical_after())
    return done


def load_schedule(feed: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    t = tables_of(feed, "service_schedule")
    spark = t["trips"].sparkSession
    services = t["calendar"].select("service_id")
    if "calendar_dates" in t:
        services = services.unionByName(t["calendar_dates"].select("service_id"))
    window = t["feed_info"].select("feed_start_date", "feed_end_date").limit(1)
    checks.gate({**t, "shape_routes": t["trips"].where("shape_id is not null").select("shape_id", "route_id").distinct(), "services": services, "calendar": t["calendar"].crossJoin(F.broadcast(window))}, checks.schedule_before())
    patterns_of, active = schedule.calendar(t["calendar"], t.get("calendar_dates"), t["feed_info"])
    routes = schedule.routes(t["routes"])
    patterns = schedule.patterns(t["trips"])
    stops_at = schedule.pattern_stops(t["stop_times"], t["trips"])
    tables = {
        "Agency": t["agency"], "Route": routes, "RoutePattern": patterns, "Trip": t["trips"], "ServicePattern": patterns_of, "Date": schedule.dates(active), "active_on": active,
        "operated_on": t["trips"].select("trip_id", "service_id").distinct(), "follows": t["trips"].where("shape_id is not null").select("trip_id", "shape_id").distinct(),
        "scheduled_at": schedule.scheduled_at(t["stop_times"], t["trips"], routes), "stops_at": stops_at, "serves": schedule.serves(stops_at, patterns, t["stops"]), "FeedInfo": t["feed_info"],
    }
    done = written(spark, {k: v.drop("_ordinal") for k, v in tables.items()}, out, {"scheduled_at": ["mode"]})
    checks.gate({**done, "Date": done["Date"].crossJoin(F.broadcast(window))}, checks.schedule_after())
    return done


def load_fare(feed: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    t = tables_of(feed, "fare")
    spark = t["stops"].sparkSession
    zones, stations, gates = fare.zones(t["stops"])
    products, accepted = fare.products(t["fare_products"])
    rules = fare.leg_rules(t["fare_leg_rules"], t["stops"], t["fare_products"])
    tables = {"FareZone": zones, "in_zone": stations, "FareGate": gates, "FareMedia": t["fare_media"].drop("_ordinal"), "FareProduct": products, "accepts": accepted, "FareTransferRule": fare.transfer_rules(t.get("fare_transfer_rules"), spark), **rules}
    done = written(spark, tables, out)
    rail = done["leg_rules"].where(F.col("network_id").isin(*fare.RAIL_NETWORKS)).join(done["from_area"].select("rule_id"), "rule_id", "left_semi")
    checks.gate({**done, "Station": t["stops"].select(F.col("stop_id").alias("id")), "rail_rules": rail}, checks.fare_after())
    return done


def written(spark: SparkSession, tables: dict[str, DataFrame], out: str, partitions: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    for name, df in tables.items():
        write_table(df, f"{out}/{name}", (partitions or {}).get(name))
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def transit_graph(physical_tables: dict[str, DataFrame], schedule_tables: dict[str, DataFrame]) -> PropertyGraph:
    """The written tables as a graph for patterns and algorithms."""
    s = schedule_tables
    edge = lambda df, a, b, *more: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *more)
    return PropertyGraph(
        nodes={
            "Station": physical_tables["Station"],
            "Platform": physical_tables["Platform"],
            "Pathway": physical_tables["Pathway"].withColumnRenamed("pathway_id", "id"),
            "Route": s["Route"].withColumnRenamed("route_id", "id"),
            "Trip": s["Trip"].withColumnRenamed("trip_id", "id"),
            "ServicePattern": s["ServicePattern"].withColumnRenamed("service_id", "id"),
            "Date": s["Date"].withColumnRenamed("date", "id"),
        },
        edges={
            "SERVES": (edge(s["serves"].where("label = 'Station'"), "route_id", "stop_id"), "Route", "Station"),
            "LINKS": (edge(physical_tables["links"], "stop_id", "pathway_id", "direction"), "Platform", "Pathway"),
            "CONTAINS": (edge(physical_tables["contains"].where("label = 'Platform'"), "station_id", "id"), "Station", "Platform"),
            "RUNS": (edge(s["Trip"], "route_id", "trip_id"), "Route", "Trip"),
            "OPERATED_ON": (edge(s["operated_on"], "trip_id", "service_id"), "Trip", "ServicePattern"),
            "ACTIVE_ON": (edge(s["active_on"], "service_id", "date", "holiday_name"), "ServicePattern", "Date"),
            "SCHEDULED_AT": (edge(s["scheduled_at"], "trip_id", "stop_id", "stop_sequence", "arrival", "departure", "mode"), "Trip", "Platform"),
        },
    )
