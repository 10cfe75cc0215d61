"""The service-schedule layer: calendars, routes, patterns, stop times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.columns import clean, date_key, date_of, day_name, federal_holidays, service_class, service_seconds
from meshline.operators.graph import keep_first
from meshline.sources.feeds import column_or_null

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def calendar(calendars: DataFrame, exceptions: DataFrame | None, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(service_patterns: service_id, label; active_on: service_id, date,
    holiday_name) (ETL-07). Ranges are clipped to the feed's window; of several
    exceptions for a service and date the last in file order decides. A service
    that only exceptions name is a Holiday."""
    c = calendars.withColumn("service_id", F.trim("service_id"))
    flags = [F.coalesce(F.col(d).try_cast("int"), F.lit(0)) for d in DAYS]
    window = feed.select(date_of(F.col("feed_start_date")).alias("fs"), date_of(F.col("feed_end_date")).alias("fe")).limit(1)
    ranged = c.crossJoin(F.broadcast(window)).select("service_id", F.array(*flags).alias("flags"), F.greatest(date_of(F.col("start_date")), "fs").alias("a"), F.least(date_of(F.col("end_date")), "fe").alias("b"))
    # sequence() counts down when its ends are swapped, so empty ranges go first
    days = ranged.where("a <= b").select("service_id", "flags", F.explode(F.sequence("a", "b")).alias("d")).where("flags[weekday(d)] = 1").select("service_id", date_key(F.col("d")).alias("date")).distinct()
    labels = c.select("service_id", service_class(F.col("service_id"), [F.col(d) for d in DAYS]).alias("label")).dropDuplicates(["service_id"])
    if exceptions is not None:
        x = exceptions.select(F.trim("service_id").alias("service_id"), F.trim("date").alias("date"), F.col("exception_type").try_cast("int").alias("kind"), "_ordinal").where("kind in (1, 2)")
        last = keep_first(x, ["service_id", "date"], [-F.col("_ordinal")]).select("service_id", "date", "kind")
        joined = days.withColumn("base", F.lit(True)).join(last, ["service_id", "date"], "full_outer")
        days = joined.where("kind = 1 or (base and kind is null)").select("service_id", "date")
        only = exceptions.select(F.trim("service_id").alias("service_id")).distinct().join(labels, "service_id", "left_anti").withColumn("label", F.lit("Holiday"))
        labels = labels.unionByName(only)
    years = window.select(F.year("fs").alias("a"), F.year("fe").alias("b")).first()
    spark = calendars.sparkSession
    names = spark.createDataFrame(federal_holidays(years["a"], years["b"]) if years and years["a"] else [], "date string, holiday_name string")
    return labels, days.join(F.broadcast(names), "date", "left").select("service_id", "date", "holiday_name")


def dates(active_on: DataFrame) -> DataFrame:
    return active_on.select("date").distinct().withColumn("day_of_week", day_name(date_of(F.col("date"))))


def routes(raw: DataFrame) -> DataFrame:
    """Routes with their mode: type 1 is rail, every other bus (ETL-08)."""
    kind = F.col("route_type").try_cast("int")
    mode = F.when(kind == 1, "Rail").otherwise("Bus")
    return raw.withColumns({"route_type": kind, "mode": mode, "labels": F.array(F.lit("Route"), mode)})


def patterns(trips: DataFrame) -> DataFrame:
    """(shape_id, route_id, headsign, direction_id): the first value that isn't
    null in file order, each column for itself (ETL-09, AG-13)."""
    t = trips.where(clean(F.col("shape_id")).isNotNull())
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ordinal"))).alias(c)
    return t.groupBy("shape_id").agg(first("route_id"), first("trip_headsign"), first("direction_id")).withColumnRenamed("trip_headsign", "headsign")


def scheduled_at(stop_times: DataFrame, trips: DataFrame, route_table: DataFrame) -> DataFrame:
    """Stop times with mode and times as seconds of the service day (ETL-10)."""
    mode = trips.select("trip_id", "route_id").join(route_table.select("route_id", "mode"), "route_id").select("trip_id", "mode")
    return stop_times.join(mode, "trip_id").select(
        "trip_id",
        "stop_id",
        F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
        F.lower("mode").alias("mode"),
        service_seconds(F.trim("arrival_time")).alias("arrival"),
        service_seconds(F.trim("departure_time")).alias("departure"),
        column_or_null(stop_times, "shape_dist_traveled", "double").alias("shape_dist_traveled"),
        column_or_null(stop_times, "timepoint", "int").alias("timepoint"),
    )


def pattern_stops(stop_times: DataFrame, trips: DataFrame, collapse: bool = False) -> DataFrame:
    """(shape_id, stop_id, stop_sequence, is_terminus) of each pattern's first
    trip in file order (ETL-11). collapse: one row for a stop that a loop visits
    twice, the last sequence (Q-13)."""
    first = trips.where(clean(F.col("shape_id")).isNotNull()).groupBy("shape_id").agg(F.min_by("trip_id", "_ordinal").alias("trip_id"))
    rows = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence")).join(first, "trip_id")
    ends = rows.groupBy("shape_id").agg(F.min("stop_sequence").alias("lo"), F.max("stop_sequence").alias("hi"))
    out = rows.join(ends, "shape_id").select("shape_id", "stop_id", "stop_sequence", F.col("stop_sequence").isin(F.col("lo"), F.col("hi")).alias("is_terminus"))
    return keep_first(out, ["shape_id", "stop_id"], [-F.col("stop_sequence")]) if collapse else out


def serves(pattern_stop_rows: DataFrame, pattern_rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Distinct (route_id, stop_id, label): rail platforms by their parent
    station, numeric bus stops themselves (ETL-12)."""
    at = pattern_stop_rows.join(pattern_rows.select("shape_id", "route_id"), "shape_id").join(stops.select("stop_id", clean(F.col("parent_station")).alias("parent")), "stop_id")
    bus = F.col("stop_id").rlike("^[0-9]+$")
    station = F.when(F.upper("stop_id").startswith("PF_"), F.col("parent"))
    return at.select("route_id", F.when(bus, F.col("stop_id")).otherwise(station).alias("stop_id"), F.when(bus, "BusStop").otherwise("Station").alias("label")).where("stop_id is not null").distinct()


def summary(route_rows: DataFrame, trips: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """One row of counts: trips, bus and rail routes, patterns."""
    counts = route_rows.agg(F.count(F.when(F.col("mode") == "Bus", 1)).alias("bus_routes"), F.count(F.when(F.col("mode") == "Rail", 1)).alias("rail_routes"))
    return counts.crossJoin(trips.agg(F.count("*").alias("trips"))).crossJoin(pattern_rows.agg(F.count("*").alias("patterns")))
