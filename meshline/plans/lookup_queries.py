"""Catalogue queries that start at one named thing: a zone, a route, a station,
a pair of stations; and the plain counts of the fare and service layers.

A station's units are the riders of a zone, lifts and escalators are stations of
small and large size, a route's name is a market segment where interruptions are
meant. Parameters are the anchors that a caller would pass.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import columns as C
from meshline.operators import graph as G
from meshline.operators import paths as P
from meshline.operators.graph import Match
from meshline.plans.binding import graph, interruptions, query, serves, table
from meshline.plans.domain_queries import outages

OFFSET = 1_000_000_000


# --- fares ----------------------------------------------------------------------------


@query("SELECT p_type AS product, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS accepted_via FROM part GROUP BY 1")
def fa02_media_per_product(spark, d):
    s = graph(spark, d).node("Station")
    return s.groupBy(F.col("type").alias("product")).agg(F.array_join(F.sort_array(F.collect_set("brand")), ",").alias("accepted_via"))


@query(
    "SELECT o_orderkey AS rule, a.l_suppkey AS from_leg, b.l_suppkey AS to_leg, CASE o_orderstatus WHEN 'F' THEN 'free' WHEN 'O' THEN 'add product cost' ELSE o_orderstatus END AS transfer_type, p_name AS discount_product "
    "FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2 LEFT JOIN part ON p_partkey = a.l_partkey AND a.l_discount >= 0.05"
)
def fa05_transfer_rules(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")  # noqa: E741
    a = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("rule"), F.col("l_suppkey").alias("from_leg"), F.when(F.col("l_discount") >= 0.05, F.col("l_partkey")).alias("part"))
    b = l.where("l_linenumber = 2").select(F.col("l_orderkey").alias("other"), F.col("l_suppkey").alias("to_leg"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    out = o.join(a, o.o_orderkey == a.rule).join(b, F.col("rule") == F.col("other")).join(p, F.col("part") == p.p_partkey, "left")
    return out.select("rule", "from_leg", "to_leg", F.when(F.col("s") == "F", "free").when(F.col("s") == "O", "add product cost").otherwise(F.col("s")).alias("transfer_type"), F.col("p_name").alias("discount_product"))


@query("SELECT n_name AS zone, count(*) AS outbound_rules FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def fa06_zones_by_outbound_rules(spark, d):
    # rules are counted for each route first, so that few rows meet the zones
    l, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    own = l.groupBy("l_suppkey").agg(F.count("*").alias("k"))
    out = own.join(s, own.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("zone")).agg(F.sum("k").alias("outbound_rules"))
    return out.orderBy(F.desc("outbound_rules"), "zone").limit(10)


LEGS = (
    "legs AS (SELECT s_nationkey AS from_zone, c_nationkey AS to_zone, l_partkey AS part, l_extendedprice AS fare, l_discount AS charge, l_returnflag AS timeframe "
    "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"
)


def legs(spark, d, from_zone, to_zone):
    """Fare rules between the zones of two one-row tables (zone): the ends are
    filtered before the rules move."""
    l, s, o, c = (table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    start = s.join(F.broadcast(from_zone.select(F.col("zone").alias("from_zone"))), F.col("s_nationkey") == F.col("from_zone")).select("s_suppkey", "from_zone")
    end = c.join(F.broadcast(to_zone.select(F.col("zone").alias("to_zone"))), F.col("c_nationkey") == F.col("to_zone")).select("c_custkey", "to_zone")
    out = l.join(start, l.l_suppkey == F.col("s_suppkey")).join(o.join(end, o.o_custkey == F.col("c_custkey")).select("o_orderkey", "to_zone"), l.l_orderkey == F.col("o_orderkey"))
    return out.select("from_zone", "to_zone", F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("fare"), F.col("l_discount").alias("charge"), F.col("l_returnflag").alias("timeframe"))


def zone_of(spark, d, kind, key):
    """The zone of one route or rider, by its id."""
    at = graph(spark, d)
    return at.node("Route").where(F.col("id") == key).select(F.col("zone_id").alias("zone")) if kind == "Route" else at.edge("LIVES_IN").where(F.col("src") == key).select(F.col("dst").alias("zone"))


@query(f"WITH {LEGS} SELECT a.s_name AS from_station, b.s_name AS to_station, n_name AS shared_zone, p_name AS product, fare, timeframe FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey JOIN nation ON n_nationkey = a.s_nationkey JOIN legs ON from_zone = n_nationkey AND to_zone = n_nationkey JOIN part ON p_partkey = part WHERE a.s_suppkey = 1 AND charge = 0")
def fa07_free_transfers(spark, d):
    s, n, p = (table(spark, d, t) for t in ("supplier", "nation", "part"))
    zone = zone_of(spark, d, "Route", 1)
    free = legs(spark, d, zone, zone).where("charge = 0")
    a = s.where("s_suppkey = 1").select(F.col("s_name").alias("from_station"), F.col("s_nationkey").alias("z"))
    ends = a.join(s, a.z == s.s_nationkey).select("from_station", F.col("s_name").alias("to_station"), "z").join(n, F.col("z") == n.n_nationkey)
    out = free.join(ends, F.col("from_zone") == F.col("z")).join(p, F.col("part") == p.p_partkey)
    return out.select("from_station", "to_station", F.col("n_name").alias("shared_zone"), F.col("p_name").alias("product"), "fare", "timeframe")


@query(f"WITH {LEGS} SELECT s_name AS from_station, c_name AS to_station, p_name AS product, timeframe, fare, 'USD' AS currency FROM supplier JOIN customer ON c_custkey = 1 JOIN legs ON from_zone = s_nationkey AND to_zone = c_nationkey JOIN part ON p_partkey = part WHERE s_suppkey = 2")
def fa08_fare_lookup(spark, d):
    a = Match(graph(spark, d)).start("a", "Route", lambda t: t.id == 2).select(F.col("a__name").alias("from_station"))
    b = Match(graph(spark, d)).start("b", "Rider", lambda t: t.id == 1).select(F.col("b__name").alias("to_station"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("product"))
    rules = legs(spark, d, zone_of(spark, d, "Route", 2), zone_of(spark, d, "Rider", 1)).join(p, F.col("part") == F.col("p_partkey"))
    return rules.crossJoin(F.broadcast(a.crossJoin(b))).select("from_station", "to_station", "product", "timeframe", "fare", F.lit("USD").alias("currency"))


@query("SELECT n_name AS station, r_name AS zone, count(*) AS gate_count FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 15")
def fa10_gates_per_station(spark, d):
    m = Match(graph(spark, d)).start("g", "Rider").out("LIVES_IN", "s", "Zone").out("PART_OF", "z", "Region").df
    return m.groupBy(F.col("s__name").alias("station"), F.col("z__name").alias("zone")).agg(F.count("*").alias("gate_count")).orderBy(F.desc("gate_count"), "station").limit(15)


# --- transfers: the latest date, then matched again ------------------------------------------


@query("WITH c AS (SELECT i.*, c_mktsegment AS route FROM intr i JOIN customer ON c_custkey = user_id WHERE severity = 'SEVERE' AND c_mktsegment = 'BUILDING') SELECT route, count(DISTINCT id) AS cancelled_trips, date FROM c WHERE date = (SELECT max(date) FROM c) GROUP BY 1, 3", "intr")
def ti02_cancellations_latest(spark, d):
    c = Match(graph(spark, d)).start("i", "Interruption", lambda t: t.severity == "SEVERE").out("AFFECTS", "r", "Rider", where=lambda t: t.segment == "BUILDING").df
    return G.latest(c, "i__date").groupBy(F.col("r__segment").alias("route"), F.col("i__date").alias("date")).agg(F.countDistinct("i__id").alias("cancelled_trips"))


@query("WITH c AS (SELECT id, date, c_name AS route FROM intr JOIN customer ON c_custkey = user_id WHERE event_type = 'view' AND c_nationkey >= 12) SELECT route, count(id) AS skipped_trips, date FROM c WHERE date = (SELECT max(date) FROM c) GROUP BY 1, 3 ORDER BY 2 DESC, 1 LIMIT 10", "intr")
def ti03_most_skipped_latest(spark, d):
    c = Match(graph(spark, d)).start("i", "Interruption", lambda t: t.event_type == "view").out("AFFECTS", "r", "Rider").out("LIVES_IN", "z").where("z__id >= 12").df
    n = G.latest(c, "i__date").groupBy(F.col("r__name").alias("route"), F.col("i__date").alias("date")).agg(F.count("i__id").alias("skipped_trips"))
    return n.orderBy(F.desc("skipped_trips"), "route").limit(10)


@query("WITH c AS (SELECT id, date, user_id, c_mktsegment AS route FROM intr JOIN customer ON c_custkey = user_id WHERE event_type = 'view' AND c_mktsegment = 'FURNITURE') SELECT route, count(DISTINCT o_orderkey) AS skipped_services, date FROM c JOIN orders ON o_custkey = user_id WHERE date = (SELECT max(date) FROM c) GROUP BY 1, 3", "intr")
def ti04_skipped_services(spark, d):
    m = Match(graph(spark, d)).start("i", "Interruption", lambda t: t.event_type == "view").out("AFFECTS", "r", "Rider", where=lambda t: t.segment == "FURNITURE")
    # the latest date is found before trips multiply the rows
    last = Match(m.graph, G.latest(m.df, "i__date"), "r", m.fresh).out("PLACED", "t").df
    return last.groupBy(F.col("r__segment").alias("route"), F.col("i__date").alias("date")).agg(F.countDistinct("t__id").alias("skipped_services"))


@query("SELECT n_name AS station, n_nationkey AS station_id, count(DISTINCT id) AS disruption_count FROM nation LEFT JOIN (SELECT c_nationkey, id FROM customer JOIN intr ON user_id = c_custkey) ON c_nationkey = n_nationkey WHERE contains(n_name, 'ION_1') GROUP BY 1, 2", "intr")
def ti07_disruptions_at_station(spark, d):
    m = Match(graph(spark, d)).start("s", "Zone", lambda t: t.name.contains("ION_1")).optional(lambda q: q.inn("LIVES_IN", "r").inn("AFFECTS", "i"))
    return m.df.groupBy(F.col("s__name").alias("station"), F.col("s__id").alias("station_id")).agg(F.countDistinct("i__id").alias("disruption_count"))


# --- across layers --------------------------------------------------------------------------


@query("SELECT p_name AS station, mode, rail.id AS route, rail.name AS route_name FROM serves JOIN part ON p_partkey = dst JOIN rail ON rail.id = src WHERE dst = 7", "serves", "rail")
def cl03_routes_of_station(spark, d):
    m = Match(graph(spark, d)).start("s", "Station", lambda t: t.id == 7).inn("SERVES", "r", "Route")
    return m.select(F.col("s__name").alias("station"), F.col("r__mode").alias("mode"), F.col("r__id").alias("route"), F.col("r__name").alias("route_name")).orderBy("mode", "route")


@query(
    "WITH p AS (SELECT p_partkey AS id, p_size, 38.5 + (p_partkey * 7919 % 1000) / 2500.0 AS lat, -77.5 + (p_partkey * 104729 % 1000) / 2000.0 AS lon FROM part), "
    "m AS (SELECT a.id AS station, b.id AS stop, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS distance_m FROM p a, p b WHERE a.p_size > 25 AND b.p_size <= 25), "
    "s AS (SELECT dst, id, mode FROM serves JOIN rail ON id = src) SELECT station, x.id AS rail_line, y.id AS bus_route, distance_m, stop AS bus_stop FROM m JOIN s x ON x.dst = station AND x.mode = 'Rail' JOIN s y ON y.dst = stop AND y.mode = 'Bus' WHERE distance_m < 40000 ORDER BY station, distance_m, rail_line, bus_route, bus_stop LIMIT 25",
    "serves",
    "rail",
)
def cl05_bus_near_rail(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), "p_size", (F.lit(38.5) + (k * 7919 % 1000) / 2500.0).alias("lat"), (F.lit(-77.5) + (k * 104729 % 1000) / 2000.0).alias("lon"))
    route = graph(spark, d).node("Route").select(F.col("id").alias("route"), "mode")
    s = serves(spark, d).join(route, F.col("src") == F.col("route")).select("dst", "route", "mode")
    rail = s.where("mode = 'Rail'").select(F.col("dst").alias("station"), F.col("route").alias("rail_line"))
    bus = s.where("mode = 'Bus'").select(F.col("dst").alias("bus_stop"), F.col("route").alias("bus_route"))
    # only stations that a line serves are laid out in cells
    left = p.where("p_size > 25").join(rail.select(F.col("station").alias("id")).distinct(), "id", "left_semi")
    right = p.where("p_size <= 25").join(bus.select(F.col("bus_stop").alias("id")).distinct(), "id", "left_semi")
    near = G.near(left, right, 40_000.0).select(F.col("a").alias("station"), F.col("b").alias("bus_stop"), F.round("metres").alias("distance_m")).where("distance_m < 40000")
    out = near.join(rail, "station").join(bus, "bus_stop").select("station", "rail_line", "bus_route", "distance_m", "bus_stop")
    return out.orderBy("station", "distance_m", "rail_line", "bus_route", "bus_stop").limit(25)


@query(f"WITH {LEGS} SELECT s_name AS from_station, c_name AS to_station, timeframe, fare FROM supplier JOIN customer ON c_custkey = 3 JOIN legs ON from_zone = s_nationkey AND to_zone = c_nationkey WHERE s_suppkey = 4")
def cl12_fare_across_timeframes(spark, d):
    a = Match(graph(spark, d)).start("a", "Route", lambda t: t.id == 4).select(F.col("a__name").alias("from_station"))
    b = Match(graph(spark, d)).start("b", "Rider", lambda t: t.id == 3).select(F.col("b__name").alias("to_station"))
    rules = legs(spark, d, zone_of(spark, d, "Route", 4), zone_of(spark, d, "Rider", 3))
    return rules.crossJoin(F.broadcast(a.crossJoin(b))).select("from_station", "to_station", "timeframe", "fare").orderBy("fare")


# --- service --------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM supplier) AS routes, (SELECT count(*) FROM orders) AS trips, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) AS patterns, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS services, (SELECT count(DISTINCT strftime(o_orderdate, '%Y%m%d')) FROM orders) AS dates")
def ss01_node_counts(spark, d):
    g = graph(spark, d)
    n = lambda df, *aggs: F.broadcast(df.agg(*aggs))
    out = n(g.node("Route"), F.count("*").alias("routes")).crossJoin(n(g.edge("RUNS"), F.count("*").alias("patterns")))
    return out.crossJoin(n(g.node("Trip"), F.count("*").alias("trips"), F.countDistinct("service").alias("services"), F.countDistinct("date").alias("dates")))


@query("SELECT labels, count(*) AS n, string_agg(service, ',' ORDER BY service) AS service_ids FROM (SELECT DISTINCT o_orderpriority AS service, 'ServicePattern,' || CASE WHEN o_orderpriority < '3' THEN 'Weekday' WHEN o_orderpriority < '5' THEN 'Saturday' ELSE 'Sunday' END AS labels FROM orders) GROUP BY 1")
def ss03_patterns_by_label(spark, d):
    s = F.col("service")
    labels = F.array(F.lit("ServicePattern"), F.when(s < "3", "Weekday").when(s < "5", "Saturday").otherwise("Sunday"))
    patterns = graph(spark, d).node("Trip").select("service").distinct().withColumn("labels", labels)
    out = patterns.groupBy("labels").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("service")), ",").alias("service_ids"))
    return out.withColumn("labels", F.array_join("labels", ","))


@query("SELECT a.o_custkey AS block, count(*) AS chain_length FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ss10_block_chains(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("block")).agg(F.count("*").alias("n")).where("n > 1")
    return n.select("block", F.expr("n * (n - 1) div 2").alias("chain_length")).orderBy(F.desc("chain_length"), "block").limit(10)


@query("SELECT o_orderpriority AS service, strftime(o_orderdate, '%Y%m%d') AS date, s_name AS route, count(DISTINCT o_orderkey) AS trips FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2, 3")
def ss11_maintenance_service(spark, d):
    m = Match(graph(spark, d)).start("t", "Trip", lambda t: t.service == "5-LOW").inn("RUNS", "r", "Route").df
    return m.groupBy(F.col("t__service").alias("service"), F.col("t__date").alias("date"), F.col("r__name").alias("route")).agg(F.count("*").alias("trips"))


# --- accessibility and delays ------------------------------------------------------------------


@query("SELECT n_name AS station, count(DISTINCT c_custkey) AS total_elevators, count(DISTINCT event_id) AS active_outages, string_agg(DISTINCT CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS elevator_ids FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' AND value >= 150 WHERE n_nationkey = 7 GROUP BY 1")
def ac04b_lifts_of_station(spark, d):
    m = Match(graph(spark, d)).start("s", "Zone", lambda t: t.id == 7).optional(lambda q: q.inn("LIVES_IN", "e")).df.select(F.col("s__name").alias("station"), F.col("e__id").alias("unit"))
    o = outages(spark, d).where("value >= 150").groupBy(F.col("user_id").alias("u")).agg(F.countDistinct("id").alias("n"))
    out = m.join(o, F.col("unit") == F.col("u"), "left").groupBy("station")
    ids = F.array_join(F.sort_array(F.collect_set(F.col("unit").cast("string"))), ",")
    return out.agg(F.countDistinct("unit").alias("total_elevators"), F.coalesce(F.sum("n"), F.lit(0)).alias("active_outages"), F.when(ids != "", ids).alias("elevator_ids"))


@query("SELECT n_name AS station, c_custkey AS escalator_id, event_id AS outage_unit, CASE WHEN value >= 150 THEN 'active' WHEN value IS NOT NULL THEN 'resolved' END AS status, CASE WHEN user_id % 3 <> 0 THEN strftime(ts + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%SZ') END AS eta FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' WHERE n_nationkey = 3")
def ac05_escalator_outages(spark, d):
    m = Match(graph(spark, d)).start("s", "Zone", lambda t: t.id == 3).inn("LIVES_IN", "e").df.select(F.col("s__name").alias("station"), F.col("e__id").alias("escalator_id"))
    o = outages(spark, d)
    status = F.when(F.col("value") >= 150, "active").when(F.col("value").isNotNull(), "resolved")
    returns = F.when(F.col("user_id") % 3 != 0, F.unix_millis(F.col("ts").cast("timestamp") + F.expr("interval 2 days")))  # epoch ms; null means no estimate
    out = m.join(o, m.escalator_id == o.user_id, "left").orderBy(F.desc("ts"))
    return out.select("station", "escalator_id", F.col("id").alias("outage_unit"), status.alias("status"), C.iso_of_millis(returns).alias("eta"))


WALKS = (
    "u AS (SELECT src || '-' || dst AS e, src AS a, OFS + dst AS b FROM serves UNION ALL SELECT src || '-' || dst, OFS + dst, src FROM serves), s AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(s_name, '00000000')), "
    "w AS (SELECT s.id, s.name, x.b AS node FROM s JOIN u x ON x.a = s.id UNION SELECT s.id, s.name, z.b FROM s JOIN u x ON x.a = s.id JOIN u y ON y.a = x.b AND y.e <> x.e JOIN u z ON z.a = y.b AND z.e <> y.e AND z.e <> x.e)"
).replace("OFS", str(OFFSET))


def reachable(spark, d, units):
    """(entrance, entrance_name, unit) of `units` within three links of the
    entrances whose name holds a string; links are walked both ways."""
    starts = graph(spark, d).node("Route").where(F.col("name").contains("00000000")).select("id", F.col("name").alias("entrance_name"))
    e = serves(spark, d).select(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("eid"), "src", (F.col("dst") + OFFSET).alias("dst"))
    ends = P.trail_ends(starts, e, 1, 3)
    found = ends.join(units.select((F.col("id") + OFFSET).alias("node"), F.col("id").alias("unit")), "node")
    return found.join(starts, found.start == starts.id).select("entrance_name", "unit").distinct()


@query(f"WITH {WALKS} SELECT DISTINCT name AS entrance_name, p_partkey AS escalator_id FROM w JOIN part ON p_partkey + {OFFSET} = node WHERE p_size >= 40", "serves")
def ac07_reachable_escalators(spark, d):
    return reachable(spark, d, graph(spark, d).node("Station").where("size >= 40")).withColumnRenamed("unit", "escalator_id")


@query(f"WITH {WALKS} SELECT DISTINCT name AS entrance_name, p_partkey AS elevator_id, event_id AS outage_unit, CASE WHEN event_id IS NOT NULL THEN 'active' END AS outage_status FROM w JOIN part ON p_partkey + {OFFSET} = node LEFT JOIN events ON user_id = p_partkey AND event_type = 'error' AND value >= 150 WHERE p_size < 10", "serves")
def ac08_reachable_lifts(spark, d):
    near = reachable(spark, d, graph(spark, d).node("Station").where("size < 10")).withColumnRenamed("unit", "elevator_id")
    o = outages(spark, d).where("value >= 150").select("user_id", F.col("id").alias("outage_unit"), F.lit("active").alias("outage_status"))
    return near.join(o, near.elevator_id == o.user_id, "left").drop("user_id")


@query("SELECT id AS delay_id, severity, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS started FROM intr JOIN customer ON c_custkey = user_id WHERE event_type = 'click' AND c_name = 'Customer#000000012' ORDER BY ts DESC, id LIMIT 10", "intr")
def dp08_delays_without_date(spark, d):
    m = Match(graph(spark, d)).start("r", "Rider", lambda t: t.name == "Customer#000000012").inn("AFFECTS", "i", "Interruption", where=lambda t: t.event_type == "click")
    return m.df.orderBy(F.desc("i__ts"), "i__id").limit(10).select(F.col("i__id").alias("delay_id"), F.col("i__severity").alias("severity"), F.date_format("i__ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"))
