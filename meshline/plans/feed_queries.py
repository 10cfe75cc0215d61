"""The layers' rules over a feed that is shaped from the driver's tables, each
with its SQL equivalent: sources, text and time functions, physical and schedule
layers, checks, retrieval set-up.

The feed: a part is a stop of the kind that its key gives (station, entrance,
platform, gate, generic node, bus stop); a line item is a pathway between two
parts; an order is a trip of its customer's shape, its line items the stop times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import columns as C
from meshline.operators import algorithms as A
from meshline.operators import expand as X
from meshline.operators import resolve as R
from meshline.operators.validate import guard_sql, run_checks, targets_exist
from meshline.plans import checks, interruption, physical, schedule
from meshline.plans.binding import graph, query, table
from meshline.session import scratch_path
from meshline.sources import feeds, realtime, sinks

# --- the feed -------------------------------------------------------------------------

STOP_SQL = (
    "stops AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'STN_' || p_partkey WHEN 1 THEN 'ENT_' || p_partkey WHEN 2 THEN 'PF_' || p_partkey WHEN 3 THEN 'NODE_' || p_partkey || '_FG_PAID' WHEN 4 THEN 'NODE_' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id, "
    "CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS kind, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN 'STN_' || (p_partkey - p_partkey % 6) END AS parent, CASE WHEN p_size % 5 < 4 THEN 'L' || (p_size % 4) END AS level, p_size % 4 AS idx FROM part)"
)
PATH_SQL = (
    "paths AS (SELECT DISTINCT l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id, l_linenumber AS mode, coalesce(a.id, 'GONE_' || l_partkey) AS f, coalesce(b.id, 'GONE_' || (l_partkey + l_suppkey)) AS t, l_returnflag = 'N' AS two FROM lineitem LEFT JOIN stops a ON a.k = l_partkey LEFT JOIN stops b ON b.k = l_partkey + l_suppkey)"
)


def stops(spark, d):
    k = F.col("p_partkey")
    text, r = k.cast("string"), F.col("p_partkey") % 6
    name = F.concat(F.when(r == 0, "STN_").when(r == 1, "ENT_").when(r == 2, "PF_").when(r.isin(3, 4), "NODE_").otherwise(""), text, F.when(r == 3, "_FG_PAID").otherwise(""))
    kind = F.when(r == 0, "1").when(r == 1, "2").when(r.isin(3, 4), "3").otherwise("0")
    parent = F.when(r.between(1, 4), F.concat(F.lit("STN_"), (k - r).cast("string")))
    level = F.when(F.col("p_size") % 5 < 4, F.concat(F.lit("L"), (F.col("p_size") % 4).cast("string")))
    return table(spark, d, "part").select(k.alias("key"), name.alias("stop_id"), kind.alias("location_type"), parent.alias("parent_station"), level.alias("level_id"), F.col("p_name").alias("stop_name"))


def pathways(spark, d):
    l, s = table(spark, d, "lineitem"), stops(spark, d).select("key", "stop_id")  # noqa: E741
    raw = l.select(
        F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))).alias("pathway_id"), F.col("l_linenumber").cast("string").alias("pathway_mode"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_suppkey")).alias("b"), F.when(F.col("l_returnflag") == "N", "1").otherwise("0").alias("is_bidirectional")
    ).distinct()
    a, b = (s.select(F.col("key").alias(f"{x}_key"), F.col("stop_id").alias(f"{x}_stop")) for x in "ab")
    met = raw.join(a, raw.a == F.col("a_key"), "left").join(b, raw.b == F.col("b_key"), "left")
    end = lambda x: F.coalesce(f"{x}_stop", F.concat(F.lit("GONE_"), F.col(x).cast("string")))
    return met.select("pathway_id", "pathway_mode", end("a").alias("from_stop_id"), end("b").alias("to_stop_id"), "is_bidirectional").distinct()


def kinds(spark, d):
    return physical.stop_kinds(stops(spark, d))


def trips(spark, d):
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        o.cast("string").alias("trip_id"), F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("SH"), (F.col("o_custkey") % 40).cast("string"))).alias("shape_id"),
        F.when(o % 3 != 0, F.concat(F.lit("R"), (F.col("o_custkey") % 11).cast("string"))).alias("route_id"), F.when(o % 4 != 0, F.col("o_orderpriority")).alias("trip_headsign"), (o % 2).cast("string").alias("direction_id"),
        F.concat(F.lit("SV"), (F.col("o_custkey") % 6).cast("string")).alias("service_id"), o.alias("_ordinal"),
    )


TRIP_SQL = "trips AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 <> 0 THEN 'SH' || (o_custkey % 40) END AS shape, CASE WHEN o_orderkey % 3 <> 0 THEN 'R' || (o_custkey % 11) END AS route, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS headsign, CAST(o_orderkey % 2 AS VARCHAR) AS direction, 'SV' || (o_custkey % 6) AS service FROM orders)"
CALL_SQL = "calls AS (SELECT l_orderkey AS trip, l_linenumber AS seq, s.id AS stop, (l_orderkey * 37 + l_linenumber * 611) % 100000 AS secs FROM lineitem JOIN stops s ON s.k = l_partkey)"


def stop_times(spark, d):
    s = stops(spark, d).select("key", "stop_id")
    at = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 611) % 100000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.floor(at / 3600)), two(F.floor(at % 3600 / 60)), two(at % 60))
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.join(s, l.l_partkey == s.key).select(F.col("l_orderkey").cast("string").alias("trip_id"), "stop_id", F.col("l_linenumber").cast("string").alias("stop_sequence"), F.concat(F.lit(" "), text).alias("arrival_time"), text.alias("departure_time"))


def route_table(spark, d):
    k = F.col("id")
    return schedule.routes(spark.range(11).select(F.concat(F.lit("R"), k.cast("string")).alias("route_id"), F.when(k % 4 == 0, "1").when(k % 4 == 1, "3").when(k % 4 == 2, "x").otherwise("1 ").alias("route_type")))


# --- sources and sinks -------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS agency_id, s_name AS agency_name FROM supplier")
def src03_csv_scan(spark, d):
    """Tables written as text files and read back, names trimmed, ids as text."""
    folder = scratch_path(spark, "feed")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("agency_id "), F.col("s_name").alias(" agency_name"))
    rows.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(f"{folder}/agency.txt")
    return feeds.read_feed(spark, folder)["agency"].select("agency_id", "agency_name")


@query("SELECT 'agency' AS name, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'stops', (SELECT count(*) FROM part)")
def src04_many_tables(spark, d):
    folder = scratch_path(spark, "feed")
    for name, source in (("agency", "supplier"), ("stops", "part")):
        table(spark, d, source).write.option("header", True).csv(f"{folder}/{name}.txt")
    found = feeds.read_feed(spark, folder)
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in sorted(found.items())]
    return counts[0].unionAll(counts[1])


@query("SELECT 'physical' AS layer, string_agg(t, ',' ORDER BY t) AS tables FROM (SELECT unnest(['stops', 'pathways', 'levels']) AS t)")
def src12_required_tables(spark, d):
    found = {name: table(spark, d, "region") for name in ("stops", "pathways", "levels", "agency", "shapes")}
    own = {n for n in feeds.tables_of(found, "physical") if n in ("stops", "pathways", "levels")}
    return spark.createDataFrame([("physical", ",".join(sorted(own)))], "layer string, tables string")


@query("SELECT 'U' || user_id AS unit, event_type AS kind, count(*) AS n, 'rail' AS source FROM events GROUP BY 1, 2")
def src05_json_incidents(spark, d):
    path = scratch_path(spark, "incidents")
    table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("UnitName"), F.col("event_type").alias("UnitType")).write.json(path)
    rows = realtime.read_json(spark, path, "UnitName string, UnitType string", "rail")
    return rows.groupBy(F.col("UnitName").alias("unit"), F.col("UnitType").alias("kind"), "source").agg(F.count("*").alias("n"))


def entities(spark, d):
    """Real-time entities of the events, written as JSON lines and read back."""
    path = scratch_path(spark, "entities")
    e = table(spark, d, "events")
    k = F.col("event_id")
    words = lambda text, lang: F.struct(F.lit(lang).alias("language"), F.lit(text).alias("text"))
    trip = F.struct(F.col("user_id").cast("string").alias("trip_id"), F.lit("R1").alias("route_id"), F.lit("20240105").alias("start_date"), (k % 5).cast("int").alias("schedule_relationship"))
    stop = F.struct((k % 7).cast("int").alias("stop_sequence"), F.lit("S").alias("stop_id"), (k % 3).cast("int").alias("schedule_relationship"), F.struct((k % 900).cast("int").alias("delay")).alias("arrival"))
    update = F.when(k % 2 == 0, F.struct(trip.alias("trip"), F.when(k % 4 == 0, (k % 100).cast("int")).alias("delay"), k.alias("timestamp"), F.array(stop).alias("stop_time_update")))
    texts = F.when(k % 3 == 0, F.array(words("hola", "es"), words("hello", "en"))).otherwise(F.array(words("bonjour", "fr"), words("hola", "es")))
    alert = F.when(k % 2 == 1, F.struct((k % 14).cast("int").alias("cause"), (k % 13).cast("int").alias("effect"), (k % 6).cast("int").alias("severity_level"), texts.alias("header_text"), F.array(F.struct(k.alias("start"), (k + 9).alias("end")), F.struct(F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end"))).alias("active_period"), F.array(F.struct(F.lit("R1").alias("route_id"), F.lit(None).cast("string").alias("stop_id")), F.struct(F.lit(None).cast("string").alias("route_id"), F.col("user_id").cast("string").alias("stop_id"))).alias("informed_entity")))
    e.select(k.cast("string").alias("id"), update.alias("trip_update"), alert.alias("alert")).write.json(path)
    return realtime.read_json(spark, path, realtime.ENTITY, "feed")


RELATION = "CASE event_id % 5 WHEN 1 THEN 'ADDED' WHEN 2 THEN 'UNSCHEDULED' WHEN 3 THEN 'CANCELED' ELSE 'SCHEDULED' END"


@query(f"SELECT schedule_relationship, count(*) AS n, CAST(sum(delay) AS BIGINT) AS delays FROM (SELECT {RELATION} AS schedule_relationship, CASE WHEN event_id % 4 = 0 THEN event_id % 100 WHEN event_id % 900 <> 0 THEN event_id % 900 END AS delay FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def src08_trip_updates(spark, d):
    rows, _ = realtime.trip_updates(entities(spark, d))
    return rows.groupBy("schedule_relationship").agg(F.count("*").alias("n"), F.sum("delay").alias("delays"))


@query("SELECT event_id % 7 AS stop_sequence, count(*) AS n, CAST(sum(event_id % 900) AS BIGINT) AS delays FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def src06_stop_time_updates(spark, d):
    _, rows = realtime.trip_updates(entities(spark, d))
    return rows.groupBy("stop_sequence").agg(F.count("*").alias("n"), F.sum("arrival_delay").alias("delays"))


EFFECTS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in realtime.EFFECT.items())
SEVERITIES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in realtime.SEVERITY.items())


@query(f"SELECT CASE event_id % 13 {EFFECTS} ELSE 'UNKNOWN_EFFECT' END AS effect, CASE event_id % 6 {SEVERITIES} ELSE 'UNKNOWN_SEVERITY' END AS severity_level, CASE WHEN event_id % 3 = 0 THEN 'hello' ELSE 'bonjour' END AS header_text, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS starts FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2, 3")
def src09_alerts(spark, d):
    """Alerts flattened: first period, first English text, decoded enumerations."""
    rows, _ = realtime.service_alerts(entities(spark, d), realtime.EFFECT)
    return rows.groupBy("effect", "severity_level", "header_text").agg(F.count("*").alias("n"), F.sum("active_period_start").alias("starts"))


@query("SELECT count(*) AS selectors, count(DISTINCT user_id) AS stops FROM (SELECT user_id FROM events WHERE event_id % 2 = 1 UNION ALL SELECT NULL FROM events WHERE event_id % 2 = 1)")
def src11_alert_selectors(spark, d):
    _, rows = realtime.service_alerts(entities(spark, d), realtime.EFFECT)
    return rows.agg(F.count("*").alias("selectors"), F.countDistinct("stop_id").alias("stops"))


@query("SELECT event_type, count(*) AS n, 'a' AS source FROM events GROUP BY 1 UNION ALL SELECT event_type, count(*), 'b' FROM events GROUP BY 1")
def src07_sources_that_answer(spark, d):
    """Two sources answer, one is missing and one can't be read to its end."""
    broken = scratch_path(spark, "broken")
    spark.createDataFrame([("not a table",)], "value string").write.text(broken)
    schema = table(spark, d, "events").schema
    found = realtime.read_all(
        {"a": lambda: table(spark, d, "events").select("event_type"), "b": lambda: table(spark, d, "events").select("event_type"), "c": lambda: spark.read.parquet(f"{broken}-none"), "d": lambda: spark.read.schema(schema).option("pathGlobFilter", "*.txt").parquet(broken).select("event_type")}
    )
    return found.groupBy("event_type", "source").agg(F.count("*").alias("n"))


@query("SELECT unnest(['first', 'second']) AS name, unnest(['MATCH (a)', 'MATCH (b) RETURN b']) AS body")
def src18_statements(spark, d):
    found = sinks.statements("// ── first ──\nMATCH (a);\n\n// ── second ──\nMATCH (b) RETURN b;\n")
    return spark.createDataFrame(sorted(found.items()), "name string, body string")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def snk01_partitioned_write(spark, d):
    path = scratch_path(spark, "written")
    sinks.write_table(table(spark, d, "orders"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


# --- text and time ------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS seq FROM part")
def str07_number_in_stop(spark, d):
    r, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.concat(F.when(r == 0, "NODE_A01_ESC").when(r == 1, "node_a01_ele").when(r == 2, "X_ELV").otherwise("PF_"), n, F.lit("_BT"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.seq_in_stop(text).alias("seq"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'mezzanine of ' || p_name WHEN 1 THEN 'platform' WHEN 2 THEN 'intermediate passage and street' WHEN 3 THEN 'upper' ELSE 'levels ' || p_name END AS text FROM part")
def str09_synonyms(spark, d):
    r, n = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(r == 0, F.concat(F.lit("Mezzanine Level of "), n)).when(r == 1, "Red Line Platform").when(r == 2, "middle landing and Main Entrance").when(r == 3, "Upper Level").otherwise(F.concat(F.lit("Levels "), n))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.with_synonyms(text).alias("text"))


@query(r"SELECT p_partkey AS id, 'a\+b ' || replace(p_brand, '#', '\:') || ' \(x\) c\/d' AS text FROM part")
def str14_search_escape(spark, d):
    text = F.concat(F.lit("a+b "), F.regexp_replace("p_brand", "#", ":"), F.lit(" (x) c/d"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.escape_search(text).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def str15_fenced_json(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit(" ```"), "props", F.lit("``` ")))
    return table(spark, d, "events").select("event_id", F.from_json(C.unfence(text), "k int")["k"].alias("k"))


@query("SELECT l_orderkey AS trip, l_linenumber AS stop, count(*) AS n, max(CASE WHEN l_linenumber % 5 <> 4 THEN (l_orderkey % 40) * 3600 + l_linenumber * 60 + 7 END) AS seconds FROM lineitem GROUP BY 1, 2")
def dt02_loose_time(spark, d):
    h, n = (F.col("l_orderkey") % 40).cast("string"), F.col("l_linenumber")
    text = F.when(n % 5 == 4, h).otherwise(F.concat_ws(":", h, n.cast("string"), F.lit("07 ")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), n.alias("stop"), C.service_seconds_loose(text).cast("long").alias("s"))
    return rows.groupBy("trip", "stop").agg(F.count("*").alias("n"), F.max("s").alias("seconds"))


@query(
    "WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS mon, c_custkey % 5 = 0 AS sat, c_custkey % 7 = 0 AS sun, c_custkey % 11 = 0 AS r FROM customer) "
    "SELECT k AS service, CASE WHEN r THEN 'Maintenance' WHEN NOT mon AND NOT sat AND NOT sun THEN 'Holiday' WHEN NOT mon AND sat AND NOT sun THEN 'Saturday' WHEN NOT mon AND sun AND NOT sat THEN 'Sunday' ELSE 'Weekday' END AS label FROM c"
)
def dt09_service_class(spark, d):
    k = F.col("c_custkey")
    flag = lambda n: F.when(k % n == 0, "1").otherwise("0")
    days = [flag(3)] + [F.lit("0")] * 4 + [flag(5), flag(7)]
    name = F.concat(F.lit("S"), k.cast("string"), F.when(k % 11 == 0, "_R").otherwise(""))
    return table(spark, d, "customer").select(k.alias("service"), C.service_class(name, days).alias("label"))


@query("SELECT event_id, strftime(to_timestamp(1704067200 + event_id * 7919) AT TIME ZONE 'UTC' - INTERVAL 5 HOUR, '%Y%m%d') AS date FROM events")
def dt12_local_date(spark, d):
    """Epoch seconds as a date of an explicit zone, here one without summer time."""
    return table(spark, d, "events").select("event_id", C.local_date_key(F.lit(1704067200) + F.col("event_id") * 7919, "America/Panama").alias("date"))


# --- the physical layer --------------------------------------------------------------------


@query(f"WITH {STOP_SQL} SELECT count(*) FILTER (kind = 1) AS stations, count(*) FILTER (k % 6 = 1) AS entrances, count(*) FILTER (k % 6 = 2) AS platforms, count(*) FILTER (k % 6 = 3) AS gates, count(*) FILTER (k % 6 = 5) AS bus_stops FROM stops")
def etl01_stop_kinds(spark, d):
    n = lambda flag, name: F.count(F.when(F.col(flag), 1)).alias(name)
    return kinds(spark, d).agg(n("is_station", "stations"), n("is_entrance", "entrances"), n("is_platform", "platforms"), n("is_gate", "gates"), n("is_bus_stop", "bus_stops"))


@query(f"WITH {STOP_SQL}, {PATH_SQL}, e AS (SELECT f AS id FROM paths UNION SELECT t FROM paths) SELECT CASE WHEN s.id IS NULL THEN 'MISSING' WHEN k % 6 = 4 THEN 'DEFERRED' ELSE 'MATCHED' END AS classification, count(*) AS n FROM e LEFT JOIN stops s USING (id) GROUP BY 1")
def etl02_endpoints(spark, d):
    return physical.endpoints(pathways(spark, d), kinds(spark, d)).groupBy("classification").agg(F.count("*").alias("n"))


@query(
    f"WITH {STOP_SQL}, {PATH_SQL}, x AS (SELECT id AS p, f AS s, 'to' AS direction FROM paths UNION SELECT id, t, 'from' FROM paths UNION SELECT id, t, 'to' FROM paths WHERE two UNION SELECT id, f, 'from' FROM paths WHERE two) "
    "SELECT CASE k % 6 WHEN 0 THEN 'Station' WHEN 1 THEN 'StationEntrance' WHEN 2 THEN 'Platform' WHEN 3 THEN 'FareGate' ELSE 'BusStop' END AS label, direction, count(*) AS n FROM x JOIN stops ON stops.id = s WHERE k % 6 <> 4 GROUP BY 1, 2"
)
def etl04_links(spark, d):
    return physical.links(pathways(spark, d), kinds(spark, d)).groupBy("label", "direction").agg(F.count("*").alias("n"))


@query(
    f"WITH {STOP_SQL}, {PATH_SQL}, i AS (SELECT id, t AS node FROM paths UNION SELECT id, f FROM paths WHERE two), o AS (SELECT f AS node, id FROM paths UNION SELECT t, id FROM paths WHERE two) "
    "SELECT node, count(DISTINCT i.id || ' ' || o.id) AS chains FROM i JOIN o USING (node) JOIN stops s ON s.id = node WHERE s.k % 6 = 4 AND i.id <> o.id GROUP BY 1"
)
def etl05_pivot_chains(spark, d):
    p, k = pathways(spark, d), kinds(spark, d)
    return physical.chains(p, physical.endpoints(p, k)).groupBy(F.col("pivot").alias("node")).agg(F.count("*").alias("chains"))


@query(
    f"WITH {STOP_SQL}, {PATH_SQL}, s AS (SELECT id, level, CASE WHEN level IS NOT NULL THEN idx END AS idx, CASE WHEN kind = 1 THEN id ELSE parent END AS station FROM stops), "
    "p AS (SELECT paths.id, mode, a.level AS fl, b.level AS tl, a.idx AS fi, b.idx AS ti, coalesce(a.station, b.station) AS station FROM paths LEFT JOIN s a ON a.id = f LEFT JOIN s b ON b.id = t), "
    "here AS (SELECT DISTINCT station, level, idx FROM s WHERE level IS NOT NULL AND station IS NOT NULL), e AS (SELECT * FROM p WHERE mode = 5 AND fl IS NOT NULL AND tl IS NOT NULL AND fl <> tl), "
    "r AS (SELECT 'on_level' AS kind, id, coalesce(fl, tl) AS level FROM p WHERE mode <> 4 AND (fl IS NULL OR tl IS NULL OR fl = tl) AND coalesce(fl, tl) IS NOT NULL UNION SELECT 'on_level', e.id, here.level FROM e JOIN here ON here.station = e.station AND here.idx BETWEEN least(fi, ti) AND greatest(fi, ti) "
    "UNION SELECT 'on_level', id, unnest([fl, tl]) FROM e WHERE station IS NULL OR station NOT IN (SELECT station FROM here) UNION SELECT 'starting_level', id, fl FROM p WHERE mode = 4 AND fl IS NOT NULL UNION SELECT 'ending_level', id, tl FROM p WHERE mode = 4 AND tl IS NOT NULL "
    "UNION SELECT 'starting_level', id, fl FROM p WHERE mode NOT IN (4, 5) AND fl <> tl UNION SELECT 'ending_level', id, tl FROM p WHERE mode NOT IN (4, 5) AND fl <> tl) SELECT kind, level, count(*) AS n FROM r GROUP BY 1, 2"
)
def etl06_level_links(spark, d):
    levels = spark.createDataFrame([(f"L{k}", str(k)) for k in range(4)], "level_id string, level_index string")
    found = physical.level_links(pathways(spark, d), kinds(spark, d), levels)
    parts = [df.groupBy("level_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), F.col("level_id").alias("level"), "n") for name, df in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- the schedule layer --------------------------------------------------------------------


@query("SELECT CASE WHEN k % 4 IN (0, 3) THEN 'Rail' ELSE 'Bus' END AS mode, count(*) AS n FROM (SELECT unnest(range(11)) AS k) GROUP BY 1")
def etl08_routes(spark, d):
    return route_table(spark, d).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"WITH {TRIP_SQL} SELECT shape AS shape_id, arg_min(route, id) AS route_id, arg_min(headsign, id) AS headsign, arg_min(direction, id) AS direction_id FROM trips WHERE shape IS NOT NULL GROUP BY 1")
def etl09_patterns(spark, d):
    return schedule.patterns(trips(spark, d))


@query(f"WITH {STOP_SQL}, {TRIP_SQL}, {CALL_SQL} SELECT CASE WHEN CAST(substr(route, 2) AS INTEGER) % 4 IN (0, 3) THEN 'rail' ELSE 'bus' END AS mode, count(*) AS n, CAST(sum(secs) AS BIGINT) AS arrivals, CAST(sum(secs) AS BIGINT) AS departures FROM calls JOIN trips ON trips.id = trip WHERE route IS NOT NULL GROUP BY 1")
def etl10_scheduled_at(spark, d):
    rows = schedule.scheduled_at(stop_times(spark, d), trips(spark, d), route_table(spark, d))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.sum("arrival").alias("arrivals"), F.sum("departure").alias("departures"))


FIRST_SQL = f"{STOP_SQL}, {TRIP_SQL}, {CALL_SQL}, one AS (SELECT shape, min(id) AS trip FROM trips WHERE shape IS NOT NULL GROUP BY 1), rows_of AS (SELECT shape, stop, seq FROM calls JOIN one USING (trip))"


@query(f"WITH {FIRST_SQL} SELECT shape AS shape_id, stop AS stop_id, seq AS stop_sequence, seq IN (lo, hi) AS is_terminus FROM rows_of JOIN (SELECT shape, min(seq) AS lo, max(seq) AS hi FROM rows_of GROUP BY 1) USING (shape)")
def etl11_pattern_stops(spark, d):
    return schedule.pattern_stops(stop_times(spark, d), trips(spark, d)).select("shape_id", "stop_id", "stop_sequence", "is_terminus")


@query(f"WITH {FIRST_SQL}, r AS (SELECT shape, arg_min(route, id) AS route FROM trips WHERE shape IS NOT NULL GROUP BY 1) SELECT DISTINCT route AS route_id, CASE k % 6 WHEN 5 THEN stop ELSE parent END AS stop_id, CASE k % 6 WHEN 5 THEN 'BusStop' ELSE 'Station' END AS label FROM rows_of JOIN r USING (shape) JOIN stops ON stops.id = stop WHERE k % 6 IN (2, 5)")
def etl12_routes_serve(spark, d):
    t = trips(spark, d)
    return schedule.serves(schedule.pattern_stops(stop_times(spark, d), t), schedule.patterns(t), stops(spark, d))


@query("SELECT 'I' || event_id AS interruption_id, 'SV' || s AS service_id FROM events JOIN (SELECT unnest([1, 2]) AS s) ON event_id % 6 = s WHERE event_id % 2 = 0")
def etl16_during_maintenance(spark, d):
    """A service of each kind, each on a date of its own."""
    day = lambda n: F.concat(F.lit("2024010"), n.cast("string"))
    e = table(spark, d, "events").select(F.concat(F.lit("I"), F.col("event_id").cast("string")).alias("interruption_id"), day(F.col("event_id") % 6 + 1).alias("date"))
    services = spark.createDataFrame([(f"SV{k}", "Maintenance" if k in (2, 4) else "Weekday") for k in range(6)], "service_id string, label string")
    active = spark.range(6).select(F.concat(F.lit("SV"), F.col("id").cast("string")).alias("service_id"), day(F.col("id") + 1).alias("date"))
    out = interruption.during_maintenance(e, active, services)
    return out.where("service_id = 'SV2'")


# --- outages to pathways --------------------------------------------------------------------


def units(spark, d):
    """(outages, pathways): a rider is a unit at the station of its zone; a
    supplier is a lift there."""
    station = lambda c: F.concat(F.lit("Z"), F.col(c).cast("string"))
    o = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("outage_id"), station("c_nationkey").alias("station_code"), F.lit("ELEVATOR").alias("unit_type"),
        F.concat(F.lit("Z00X"), F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0")).alias("unit_name"), F.lit("at the platform").alias("location_description"),
    )
    node = F.concat(F.lit("NODE_"), station("s_nationkey"), F.lit("_X_ELV"), (F.col("s_suppkey") % 12 + 1).cast("string"), F.lit("_BT"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("pathway_id"), F.lit(5).alias("mode"), node.alias("from_stop_id"), F.lit("x").alias("to_stop_id"), F.lit("").alias("from_desc"), F.lit("").alias("to_desc"))
    return o, p


UNIT_SQL = (
    "c AS (SELECT c_custkey AS o, s_suppkey AS p, s_suppkey % 12 = c_custkey % 12 AS hit FROM customer JOIN supplier ON s_nationkey = c_nationkey), n AS (SELECT o, count(*) AS every, count(*) FILTER (hit) AS hits, min(p) FILTER (hit) AS p, min(p) AS only_one FROM c GROUP BY 1), "
    "m AS (SELECT o, CASE WHEN hits = 1 THEN 'F2' WHEN every = 1 THEN 'F6' END AS tier, CASE WHEN hits = 1 THEN p ELSE only_one END AS match FROM n WHERE hits = 1 OR every = 1)"
)


@query(f"WITH {UNIT_SQL} SELECT CAST(o AS VARCHAR) AS outage_id, tier, CAST(match AS VARCHAR) AS match FROM m")
def jn19_outage_cascade(spark, d):
    """Units matched by number in their zone, else as the only one of a station."""
    return R.resolve_outages(*units(spark, d))


@query(f"WITH {UNIT_SQL}, k AS (SELECT coalesce(tier, 'unmatched') AS tier, count(*) AS n FROM customer LEFT JOIN m ON o = c_custkey GROUP BY 1) SELECT tier, n, round(100.0 * n / (SELECT sum(n) FROM k), 2) AS percent FROM k")
def jn20_match_rates(spark, d):
    o, p = units(spark, d)
    return R.match_rate(o, R.resolve_outages(o, p), "outage_id")


@query(
    f"WITH {UNIT_SQL}, s AS (SELECT count(*) AS every FROM customer) SELECT 'A station' AS strategy, count(*) FILTER (every = 1) AS matched, count(*) FILTER (every > 1) AS ambiguous, (SELECT every FROM s) - count(*) AS unmatched FROM n "
    "UNION ALL SELECT 'B number', count(*) FILTER (hits = 1), count(*) FILTER (hits > 1), (SELECT every FROM s) - count(*) FILTER (hits > 0) FROM n UNION ALL SELECT 'F cascade', (SELECT count(*) FROM m), 0, (SELECT every FROM s) - (SELECT count(*) FROM m)"
)
def jn20_strategies(spark, d):
    """The same join by several strategies side by side: how many records each
    matches, leaves ambiguous, or doesn't reach."""
    o, p = units(spark, d)
    c = R.outage_candidates(o, p)
    # counted for each distinct unit, times the outages that are of it
    of_unit = R.outage_units(o).groupBy("unit").agg(F.count("*").alias("outages"))
    counted = c.groupBy("unit").agg(F.count("*").alias("every"), F.count(F.when(F.col("by_seq"), 1)).alias("hits")).join(of_unit, "unit")
    total = o.agg(F.count("*").alias("total"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("outages"))), F.lit(0))
    one = counted.agg(n(F.col("every") == 1).alias("a1"), n(F.col("every") > 1).alias("a2"), n(F.col("hits") == 1).alias("b1"), n(F.col("hits") > 1).alias("b2"))
    cascade = R.resolve_outages(o, p).agg(F.count("*").alias("f1"))
    row = one.crossJoin(cascade).crossJoin(total)
    made = lambda name, a, b: F.struct(F.lit(name).alias("strategy"), a.alias("matched"), b.alias("ambiguous"), (F.col("total") - a - b).alias("unmatched"))
    return row.select(F.explode(F.array(made("A station", F.col("a1"), F.col("a2")), made("B number", F.col("b1"), F.col("b2")), made("F cascade", F.col("f1"), F.lit(0).cast("long")))).alias("x")).select("x.*")


# --- checks ------------------------------------------------------------------------------


@query("SELECT unnest(['e', 'w', 'i', 'ok']) AS name, unnest([1, 0, 0, 0]) AS errors, unnest([0, 1, 0, 0]) AS warnings, unnest([0, 0, 1, 0]) AS infos, unnest([false, true, true, true]) AS ok")
def val00_levels(spark, d):
    from meshline.operators.validate import Check

    n, out = {"nation": table(spark, d, "nation")}, []
    for name, level, broken in (("e", "error", 20), ("w", "warning", 20), ("i", "info", 20), ("ok", "error", 99)):
        result, _ = run_checks(n, [Check(name, "nation", F.col("n_nationkey") >= broken, level)])
        out.append((name, len(result.errors), len(result.warnings), len(result.infos), result.ok))
    return spark.createDataFrame(out, "name string, errors int, warnings int, infos int, ok boolean")


def counted(tables, wanted):
    _, rows = run_checks(tables, wanted)
    return rows.select("check", "broken", "level")


@query(
    f"WITH {STOP_SQL}, {TRIP_SQL}, {CALL_SQL} SELECT 'trips: one row for each id' AS \"check\", 0::BIGINT AS broken, 'error' AS level UNION ALL SELECT 'shapes: of one route', count(*), 'error' FROM (SELECT shape FROM trips GROUP BY 1 HAVING count(DISTINCT coalesce(route, '')) > 1) "
    "UNION ALL SELECT 'trips: the service exists', count(*), 'error' FROM trips WHERE service IN ('SV4', 'SV5') UNION ALL SELECT 'stop_times: the stop exists', 0, 'warning' UNION ALL SELECT 'trips: a shape is named', count(*), 'warning' FROM trips WHERE shape IS NULL UNION ALL SELECT 'calendar: maintenance beyond the feed', 1, 'info'"
)
def val02_schedule(spark, d):
    t = trips(spark, d)
    calendar = spark.createDataFrame([("A_R", "20251231", "20241231"), ("B_R", "20240101", "20241231"), ("C", "20251231", "20241231")], "service_id string, end_date string, feed_end_date string")
    tables = {"trips": t, "shape_routes": t.select("shape_id", "route_id").distinct(), "services": spark.createDataFrame([(f"SV{k}",) for k in range(4)], "service_id string"), "stop_times": stop_times(spark, d), "stops": stops(spark, d), "calendar": calendar}
    return counted(tables, checks.schedule_before())


@query(
    "SELECT 'areas: in a zone' AS \"check\", count(*) AS broken, 'error' AS level FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'rules: a rail rule with a price has a first area', count(*), 'error' FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'N' "
    "UNION ALL SELECT 'zones: one for each stop', 0, 'error' UNION ALL SELECT 'gates: the station''s zone', count(*), 'error' FROM customer WHERE c_nationkey <> c_custkey % 25 UNION ALL SELECT 'gates: a parent is named', count(*), 'warning' FROM customer WHERE c_acctbal < 0"
)
def val03_fares(spark, d):
    text = lambda c: F.col(c).cast("string")
    l, c = table(spark, d, "lineitem"), table(spark, d, "customer")
    tables = {
        "areas": table(spark, d, "part").select(text("p_partkey").alias("area_id")), "zones": table(spark, d, "supplier").select(text("s_suppkey").alias("stop_id"), text("s_nationkey").alias("zone_id")),
        "rail_rules": l.select(F.when(F.col("l_linenumber") != 1, text("l_partkey")).alias("from_area_id"), F.when(F.col("l_returnflag") == "N", "metrorail_free").otherwise("metrorail_one_way").alias("fare_product_id")),
        "gates": c.select(text("c_nationkey").alias("zone_id"), (F.col("c_custkey") % 25).cast("string").alias("station_zone"), F.when(F.col("c_acctbal") >= 0, text("c_nationkey")).alias("parent_station")),
    }
    return counted(tables, checks.fare_before())


@query(
    "SELECT 'trip updates: one for each hash' AS \"check\", count(*) AS broken, 'error' AS level FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'alerts: one for each entity', 0, 'error' UNION ALL SELECT 'interruptions: one for each id', 0, 'error' "
    "UNION ALL SELECT 'interruptions: a known prefix', count(*), 'warning' FROM events WHERE event_type = 'view' UNION ALL SELECT 'sources: of a known interruption', count(*), 'error' FROM events WHERE event_type = 'error' UNION ALL SELECT 'trip updates: a trip is named', count(*), 'warning' FROM events WHERE user_id % 10 = 0 "
    "UNION ALL SELECT 'alerts: an effect that makes one', count(*), 'warning' FROM events WHERE event_type = 'click'"
)
def val04_interruptions(spark, d):
    e = table(spark, d, "events")
    key = F.col("event_id").cast("string")
    name = F.concat(F.when(F.col("event_type") == "view", "other_").otherwise("int_tu_"), key)
    tables = {
        "trip_updates": e.select(F.col("user_id").alias("dedup_hash"), F.when(F.col("user_id") % 10 != 0, key).alias("trip_id")), "service_alerts": e.select(key.alias("feed_entity_id"), F.when(F.col("event_type") == "click", "NO_EFFECT").otherwise("DETOUR").alias("effect")),
        "interruptions": e.select(name.alias("interruption_id")), "sources": e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("gone_"), key)).otherwise(name).alias("interruption_id")),
    }
    return counted(tables, checks.interruption_before())


@query("SELECT 'outages: one for each key' AS \"check\", count(*) AS broken, 'error' AS level FROM (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'outages: severity from 2 to 4', count(*), 'warning' FROM events WHERE event_type = 'error' AND event_id % 6 NOT IN (2, 3, 4)")
def val05_accessibility(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return counted({"outages": e.select(F.col("user_id").alias("composite_key"), (F.col("event_id") % 6).alias("severity"))}, checks.accessibility_before())


@query("SELECT unnest(['Nothing', 'none']) AS missing")
def val06_targets(spark, d):
    t = table(spark, d, "nation")
    return spark.createDataFrame([(x,) for x in targets_exist({"Zone": t, "none": t.where("n_nationkey < 0")}, ["Zone", "none", "Nothing"])], "missing string")


@query("SELECT unnest([1, 2, 3, 4, 5, 6]) AS id, unnest([true, true, false, false, false, false]) AS ok")
def val07_guard(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("val07_allowed")
    table(spark, d, "region").createOrReplaceTempView("val07_secret")
    asked = ("select n_regionkey, count(*) from val07_allowed group by 1", "with a as (select * from val07_allowed) select n_name from a", "drop table val07_allowed", "select * from val07_secret", "select 1; select 2", "select nope from val07_allowed")
    return spark.createDataFrame([(k, guard_sql(spark, q, {"val07_allowed"}).ok) for k, q in enumerate(asked, 1)], "id int, ok boolean")


# --- retrieval set-up and remaining algorithms ----------------------------------------------


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (3, 5) OR s_suppkey = 5 UNION SELECT 1000000 + n_nationkey FROM nation WHERE n_name = 'NATION_4'")
def rt11_anchors(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Route").alias("label"), F.col("s_nationkey").cast("string").alias("short_name"), F.col("s_suppkey").cast("string").alias("key"))
    z = table(spark, d, "nation").select((F.col("n_nationkey") + 1000000).cast("long").alias("id"), F.lit("Zone").alias("label"), F.col("n_name").alias("short_name"), F.lit(None).cast("string").alias("key"))
    return X.seeds(r.unionAll(z), [("Route", "short_name", "3"), ("Route", "short_name|key", "5"), ("Zone", "short_name", "NATION_4")])


@query("SELECT 'service' AS what, 0 AS hop, 1 AS lines")
def rt15_failed_expansion(spark, d):
    text = X.serialise(X.Subgraph(failed="no anchor"), "name")
    return spark.createDataFrame([("service" if text == "(no context: no anchor)" else text, 0, len(text.splitlines()))], "what string, hop int, lines int")


@query("SELECT count(*) - 3 AS left_out FROM orders")
def rt14_trim_notice(spark, d):
    """What is left out to keep within a budget is said in the last line."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Trip").alias("label"), F.lit(2).alias("hop"), F.lit("a trip").alias("name"))
    last = X.serialise(X.Subgraph(t, None), "name", X.RESERVED + 6).splitlines()[-1]  # two tokens a trip
    return spark.createDataFrame([(int(last.split()[0].lstrip("(")),)], "left_out long")


@query("SELECT n_nationkey AS community, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def ga07_louvain_of_cliques(spark, d):
    """The routes of a zone are all linked: each zone is one community."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    found = A.louvain(A.project(A.through(s)))
    return found.join(s, found.id == s.src).groupBy("community").agg(F.min("dst").alias("zone"), F.max("dst").alias("other"), F.count("*").alias("n")).where("zone = other").select(F.col("zone").alias("community"), "n")


@query(
    "SELECT id, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS position FROM (SELECT 0::BIGINT AS id, [0::BIGINT] AS path UNION ALL SELECT 1 + r_regionkey, [0, 1 + r_regionkey] FROM region UNION ALL SELECT 100 + n_nationkey, [0, 1 + n_regionkey, 100 + n_nationkey] FROM nation "
    "UNION ALL SELECT 1000 + s_suppkey, [0, 1 + n_regionkey, 100 + n_nationkey, 1000 + s_suppkey] FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
)
def ga13_depth_first_of_tree(spark, d):
    """Regions, their zones, their routes: depth first is the order of the paths."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    long = lambda c, by: (F.col(c) + by).cast("long")
    e = r.select(F.lit(0).cast("long").alias("src"), long("r_regionkey", 1).alias("dst")).unionAll(n.select(long("n_regionkey", 1), long("n_nationkey", 100))).unionAll(s.select(long("s_nationkey", 100), long("s_suppkey", 1000)))
    return A.depth_first(A.project(e.unionAll(e.select("dst", "src"))), 0)


@query("SELECT unnest(['accessibility', 'delay_propagation', 'transfer_impact']) AS domain, unnest([3, 3, 4]) AS hops, unnest([500, 100, 500]) AS rows_per_hop")
def rt10_expansion_of_domains(spark, d):
    rows = [(name, how.hops, how.rows_per_hop) for name, how in sorted(X.DOMAINS.items()) if name in ("accessibility", "delay_propagation", "transfer_impact")]
    return spark.createDataFrame(rows, "domain string, hops int, rows_per_hop int")


@query("SELECT 'IN_ZONE:' || s_suppkey || '->' || s_nationkey AS element_id, 'IN_ZONE' AS type, s_name AS start_name, n_name AS end_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def ar07_ends_of_edges(spark, d):
    e = graph(spark, d).with_ends("IN_ZONE", "Route", "Zone")
    return e.select("element_id", F.lit("IN_ZONE").alias("type"), F.col("start__name").alias("start_name"), F.col("end__name").alias("end_name"))
