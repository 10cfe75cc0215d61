"""Analytical queries of the six domains over the bound graph, one for each
result shape of the catalogue: accessibility, delays, transfers, cross-layer,
fares, service; then evaluation-only shapes and the ETL rules.

Outages are error events: unit = user, severity by value. Delays are events of
value 100 or more. Fares are line items: timeframe = return flag, amount =
extended price, zone = the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import columns as C
from meshline.operators import graph as G
from meshline.operators.graph import Match
from meshline.plans import accessibility, interruption, physical, schedule
from meshline.plans import fare as fare_plan
from meshline.plans.binding import graph, interruptions, query, serves, table


def outages(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "value", "ts", F.date_format("ts", "yyyyMMdd").alias("date"))


# --- accessibility ------------------------------------------------------------------


@query("SELECT user_id AS unit, event_id AS outage, round(value, 2) AS value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY ts DESC, event_id")
def ac01_outages_of_unit(spark, d):
    o = outages(spark, d).where("user_id = 7").orderBy(F.desc("ts"), "id")
    return o.select(F.col("user_id").alias("unit"), F.col("id").alias("outage"), F.round("value", 2).alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"))


@query("SELECT c_custkey AS unit, count(event_id) AS outages FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' WHERE c_name LIKE '%0000004%' GROUP BY 1")
def ac02_outages_by_name(spark, d):
    m = Match(graph(spark, d)).start("c", "Rider", lambda t: F.contains(t.name, F.lit("0000004"))).df.select(F.col("c__id").alias("unit"))
    return m.join(outages(spark, d), m.unit == F.col("user_id"), "left").groupBy("unit").agg(F.count("id").alias("outages"))


@query("SELECT l_orderkey AS pathway, min(l_linenumber) AS from_level, max(l_linenumber) AS to_level FROM lineitem GROUP BY 1 HAVING min(l_linenumber) < max(l_linenumber)")
def ac03_levels_of_pathway(spark, d):
    e = graph(spark, d).edge("SCHEDULED_AT").groupBy(F.col("src").alias("pathway")).agg(F.min("stop_sequence").alias("from_level"), F.max("stop_sequence").alias("to_level"))
    return e.where("from_level < to_level")


@query("SELECT n_nationkey AS station, count(DISTINCT c_custkey) AS units, count(DISTINCT event_id) AS active, coalesce(string_agg(DISTINCT CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)), '') AS ids FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' AND value >= 150 GROUP BY 1")
def ac04_station_summary(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("station"), "c_custkey")
    o = outages(spark, d).where("value >= 150")
    units = c.groupBy("station").agg(F.countDistinct("c_custkey").alias("units"))
    active = c.join(o, c.c_custkey == o.user_id).groupBy("station").agg(F.countDistinct("id").alias("active"), F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), ",").alias("ids"))
    return units.join(active, "station", "left").select("station", "units", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("ids", F.lit("")).alias("ids"))


@query("SELECT date, count(*) AS n FROM intr WHERE event_type = 'error' GROUP BY 1", "intr")
def ac06_by_date(spark, d):
    return interruptions(spark, d).where("event_type = 'error'").groupBy("date").agg(F.count("*").alias("n"))


# --- delays -------------------------------------------------------------------------


@query("SELECT id, user_id, value FROM intr WHERE date = '20240105' ORDER BY value DESC, id LIMIT 10", "intr")
def dp01_delays_top(spark, d):
    return interruptions(spark, d).where("date = '20240105'").orderBy(F.desc("value"), "id").limit(10).select("id", "user_id", "value")


@query("SELECT severity, c_mktsegment AS segment, count(DISTINCT id) AS trips FROM intr JOIN customer ON c_custkey = user_id WHERE date = (SELECT max(date) FROM intr) GROUP BY 1, 2", "intr")
def dp02_latest_by_severity(spark, d):
    i = G.latest(interruptions(spark, d), "date")
    c = table(spark, d, "customer")
    return i.join(c, i.user_id == c.c_custkey).groupBy("severity", F.col("c_mktsegment").alias("segment")).agg(F.countDistinct("id").alias("trips"))


@query("SELECT user_id AS unit, id FROM intr WHERE user_id < 3 UNION SELECT c_custkey, id FROM customer JOIN intr ON user_id = c_custkey WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 3)", "intr")
def dp03_own_or_neighbours(spark, d):
    i, c = interruptions(spark, d), table(spark, d, "customer")
    own = i.where("user_id < 3").select(F.col("user_id").alias("unit"), "id")
    near = c.join(c.where("c_custkey < 3").select("c_nationkey"), "c_nationkey", "left_semi")
    return own.unionAll(near.join(i, near.c_custkey == i.user_id).select(F.col("c_custkey").alias("unit"), "id")).distinct()


@query("SELECT id AS interruption, o_orderkey AS trip FROM intr JOIN orders ON o_custkey = user_id WHERE value >= 300", "intr")
def dp04_affected_trips(spark, d):
    m = Match(graph(spark, d)).start("i", "Interruption", lambda t: t.value >= 300).out("AFFECTS", "c").out("PLACED", "t")
    return m.select(F.col("i__id").alias("interruption"), F.col("t__id").alias("trip"))


@query("SELECT user_id AS route, count(*) AS delays FROM intr GROUP BY 1 ORDER BY delays DESC, route LIMIT 10", "intr")
def dp05_ranked(spark, d):
    return interruptions(spark, d).groupBy(F.col("user_id").alias("route")).agg(F.count("*").alias("delays")).orderBy(F.desc("delays"), "route").limit(10)


@query("SELECT id, c_name AS rider, n_name AS zone, r_name AS region FROM intr JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE severity = 'SEVERE'", "intr")
def dp06_provenance(spark, d):
    m = Match(graph(spark, d)).start("i", "Interruption", lambda t: t.severity == "SEVERE").out("AFFECTS", "c", "Rider").out("LIVES_IN", "z", "Zone").out("PART_OF", "r", "Region")
    return m.select(F.col("i__id").alias("id"), F.col("c__name").alias("rider"), F.col("z__name").alias("zone"), F.col("r__name").alias("region"))


@query("SELECT n_name AS zone, count(DISTINCT id) AS disruptions FROM nation LEFT JOIN (SELECT c_nationkey, id FROM customer JOIN intr ON user_id = c_custkey) ON c_nationkey = n_nationkey GROUP BY 1", "intr")
def dp07_zero_kept(spark, d):
    m = Match(graph(spark, d)).start("z", "Zone").optional(lambda q: q.inn("LIVES_IN", "c").inn("AFFECTS", "i"))
    return m.df.groupBy(F.col("z__name").alias("zone")).agg(F.countDistinct("i__id").alias("disruptions"))


# --- transfers ----------------------------------------------------------------------


@query("SELECT event_type AS route, count(DISTINCT user_id) AS trips FROM intr WHERE date = (SELECT max(date) FROM intr WHERE event_type = 'purchase') AND event_type = 'purchase' GROUP BY 1", "intr")
def ti01_latest_for_one(spark, d):
    i = interruptions(spark, d)
    return G.latest(i, "date", F.col("event_type") == "purchase").groupBy(F.col("event_type").alias("route")).agg(F.countDistinct("user_id").alias("trips"))


@query("SELECT x.dst AS platform, count(DISTINCT x.src) AS routes, count(DISTINCT y.src) AS partners FROM serves x JOIN serves y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1", "serves")
def ti05_transfer_partners(spark, d):
    # a platform of n routes has n routes and n partners: no self-join is needed
    n = serves(spark, d).groupBy(F.col("dst").alias("platform")).agg(F.countDistinct("src").alias("routes")).where("routes > 1")
    return n.withColumn("partners", F.col("routes"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'Bus' ELSE 'Rail' END AS mode, count(*) AS skips, count(DISTINCT user_id) AS routes, count(DISTINCT date) AS dates FROM intr GROUP BY 1", "intr")
def ti06_system_summary(spark, d):
    mode = F.when(F.col("event_type").isin("click", "view"), "Bus").otherwise("Rail")
    return interruptions(spark, d).groupBy(mode.alias("mode")).agg(F.count("*").alias("skips"), F.countDistinct("user_id").alias("routes"), F.countDistinct("date").alias("dates"))


# --- cross-layer --------------------------------------------------------------------


@query("SELECT l_partkey AS station, count(DISTINCT l_orderkey) AS trips FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '2-HIGH' GROUP BY 1 ORDER BY trips DESC, station LIMIT 15")
def cl01_trips_per_station(spark, d):
    m = Match(graph(spark, d)).start("t", "Trip", lambda t: t.service == "2-HIGH").out("SCHEDULED_AT", "s")
    return m.df.groupBy(F.col("s__id").alias("station")).agg(F.countDistinct("t__id").alias("trips")).orderBy(F.desc("trips"), "station").limit(15)


@query("WITH t AS (SELECT l_suppkey AS route, CAST(min(l_orderkey * 53 % 90000) AS BIGINT) AS a, CAST(max(l_orderkey * 53 % 90000) AS BIGINT) AS b FROM lineitem GROUP BY 1) SELECT route, CAST(a // 3600 AS VARCHAR) || ':' || lpad(CAST(a % 3600 // 60 AS VARCHAR), 2, '0') AS first_train, CAST(b // 3600 AS VARCHAR) || ':' || lpad(CAST(b % 3600 // 60 AS VARCHAR), 2, '0') AS last_train FROM t")
def cl02_first_and_last(spark, d):
    at = F.col("dst") * 53 % 90000
    e = graph(spark, d).edge("RUNS").groupBy(F.col("src").alias("route")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return e.select("route", C.clock(F.col("a")).alias("first_train"), C.clock(F.col("b")).alias("last_train"))


@query("SELECT p_partkey AS station, p_name AS name, count(*) AS routes FROM serves JOIN part ON dst = p_partkey GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY routes DESC, station LIMIT 15", "serves")
def cl04_hub_stations(spark, d):
    # the degree is counted before the join, so only hubs meet the node table
    hubs = serves(spark, d).groupBy("dst").agg(F.count("*").alias("routes")).where("routes > 1")
    s = graph(spark, d).node("Station")
    return hubs.join(s, hubs.dst == s.id).select(F.col("id").alias("station"), "name", "routes").orderBy(F.desc("routes"), "station").limit(15)


@query("SELECT a.l_orderkey AS trip, a.l_partkey AS origin, b.l_partkey AS downstream, b.l_linenumber - a.l_linenumber AS away FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber")
def cl06_downstream(spark, d):
    e = graph(spark, d).edge("SCHEDULED_AT")
    a = e.select("src", F.col("dst").alias("origin"), F.col("stop_sequence").alias("at"))
    return e.join(a, "src").where("stop_sequence > at").select(F.col("src").alias("trip"), "origin", F.col("dst").alias("downstream"), (F.col("stop_sequence") - F.col("at")).alias("away"))


@query("SELECT l_suppkey AS route, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN l_orderkey END) AS saturday, count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN l_orderkey END) AS weekday, round(100.0 * count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN l_orderkey END) / nullif(count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN l_orderkey END), 0), 2) AS percent FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def cl07_saturday_share(spark, d):
    m = Match(graph(spark, d)).start("r", "Route").out("RUNS", "t", "Trip").df
    n = m.groupBy(F.col("r__id").alias("route")).agg(F.count(F.when(F.col("t__service") == "1-URGENT", 1)).alias("saturday"), F.count(F.when(F.col("t__service") == "5-LOW", 1)).alias("weekday"))
    return n.withColumn("percent", C.percent(F.col("saturday"), F.col("weekday")))


@query("SELECT l_partkey AS platform, count(*) AS visits FROM lineitem GROUP BY 1 HAVING count(*) > 40")
def cl08_utilisation(spark, d):
    return graph(spark, d).edge("SCHEDULED_AT").groupBy(F.col("dst").alias("platform")).agg(F.count("*").alias("visits")).where("visits > 40")


@query("SELECT n_name AS from_zone, p_brand AS to_zone, max(l_extendedprice) AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY amount DESC, 1, 2 LIMIT 20")
def cl09_most_expensive(spark, d):
    l, s, n, p = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    m = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, l.l_partkey == p.p_partkey)
    return m.groupBy(F.col("n_name").alias("from_zone"), F.col("p_brand").alias("to_zone")).agg(F.max("l_extendedprice").alias("amount")).orderBy(F.desc("amount"), "from_zone", "to_zone").limit(20)


@query("SELECT DISTINCT a.s_nationkey AS zone, b.s_nationkey AS neighbour FROM serves x JOIN serves y ON x.dst = y.dst AND x.src < y.src JOIN supplier a ON a.s_suppkey = x.src JOIN supplier b ON b.s_suppkey = y.src WHERE a.s_nationkey <> b.s_nationkey", "serves")
def cl10_zone_neighbours(spark, d):
    pairs = G.common_neighbours(serves(spark, d))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    a = pairs.join(s.withColumnsRenamed({"s_suppkey": "a", "s_nationkey": "zone"}), "a").join(s.withColumnsRenamed({"s_suppkey": "b", "s_nationkey": "neighbour"}), "b")
    return a.where("zone <> neighbour").select("zone", "neighbour").distinct()


@query("SELECT r_name AS region, n_name AS zone, o_orderpriority AS service, l_returnflag AS timeframe, count(*) AS trips, round(sum(l_extendedprice), 2) AS fare FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> s_nationkey AND l_extendedprice > p_retailprice AND p_size > 40 GROUP BY 1, 2, 3, 4")
def cl11_nine_way(spark, d):
    l, o, s, n, r, p, c = (table(spark, d, t) for t in ("lineitem", "orders", "supplier", "nation", "region", "part", "customer"))
    m = l.join(p.where("p_size > 40"), l.l_partkey == p.p_partkey).where("l_extendedprice > p_retailprice").join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    out = m.where("c_nationkey <> s_nationkey").groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("zone"), F.col("o_orderpriority").alias("service"), F.col("l_returnflag").alias("timeframe"))
    return out.agg(F.count("*").alias("trips"), F.round(F.sum("l_extendedprice"), 2).alias("fare"))


@query("WITH o AS (SELECT user_id AS u, count(*) AS outages FROM events WHERE event_type = 'error' GROUP BY 1), t AS (SELECT o_custkey AS u, count(*) AS trips FROM orders GROUP BY 1) SELECT u AS unit, outages, trips, round(1.0 * outages * trips / (outages + trips), 3) AS impact FROM o JOIN t USING (u)")
def cl13_impact_score(spark, d):
    a = outages(spark, d).groupBy(F.col("user_id").alias("unit")).agg(F.count("*").alias("outages"))
    b = graph(spark, d).edge("PLACED").groupBy(F.col("src").alias("unit")).agg(F.count("*").alias("trips"))
    return a.join(b, "unit").withColumn("impact", F.round(F.lit(1.0) * F.col("outages") * F.col("trips") / (F.col("outages") + F.col("trips")), 3))


@query("SELECT o_orderkey AS trip, CAST(round(CAST(o_totalprice AS DECIMAL(18, 4)) - coalesce(disc, 0), 2) AS DOUBLE) AS cost, CASE WHEN disc IS NULL THEN 'full' ELSE 'discounted' END AS kind FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS disc FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1) ON l_orderkey = o_orderkey")
def cl14_optional_discount(spark, d):
    o = table(spark, d, "orders")
    l = table(spark, d, "lineitem").where("l_discount >= 0.09").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")).alias("disc"))  # noqa: E741  sums of decimals have no order
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select(F.col("o_orderkey").alias("trip"), F.round(F.col("o_totalprice").cast("decimal(18,4)") - F.coalesce("disc", F.lit(0).cast("decimal(28,4)")), 2).cast("double").alias("cost"), F.when(F.col("disc").isNull(), "full").otherwise("discounted").alias("kind"))


# --- fares and service ----------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM nation) AS zones, (SELECT count(*) FROM part) AS products, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS timeframes, (SELECT count(*) FROM lineitem) AS rules")
def fa01_counts(spark, d):
    n = lambda t: table(spark, d, t)
    out = n("nation").agg(F.count("*").alias("zones")).crossJoin(n("part").agg(F.count("*").alias("products")))
    return out.crossJoin(n("lineitem").agg(F.countDistinct("l_returnflag").alias("timeframes"), F.count("*").alias("rules")))


@query("SELECT l_returnflag AS timeframe, min(l_extendedprice) AS cheapest, max(l_extendedprice) AS dearest, round(avg(l_extendedprice), 2) AS mean, count(*) AS rules FROM lineitem GROUP BY 1")
def fa03_by_timeframe(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("timeframe")).agg(F.min("l_extendedprice").alias("cheapest"), F.max("l_extendedprice").alias("dearest"), F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.count("*").alias("rules"))


@query("SELECT a.l_partkey AS product, round(avg(a.l_extendedprice) - avg(b.l_extendedprice), 2) AS premium FROM (SELECT l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_partkey) GROUP BY 1")
def fa04_peak_premium(spark, d):
    # both edges of a rule in one aggregation instead of a self-join
    top = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product")).agg(top("A").alias("a"), top("R").alias("b"))
    return e.where("a is not null and b is not null").select("product", F.round(F.col("a") - F.col("b"), 2).alias("premium"))


@query("SELECT n_name AS zone, string_agg(s_name, ',' ORDER BY s_name) AS stations, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY try_cast(substr(n_name, 8) AS INTEGER)")
def fa09_stations_per_zone(spark, d):
    m = Match(graph(spark, d)).start("r", "Route").out("IN_ZONE", "z", "Zone").df
    out = m.groupBy(F.col("z__name").alias("zone")).agg(C.joined(F.col("r__name"), ","), F.count("*").alias("n")).toDF("zone", "stations", "n")
    return out.orderBy(F.substring("zone", 8, 10).try_cast("int"))


@query("SELECT mode, count(*) AS routes, string_agg(name, ',' ORDER BY name) FILTER (WHERE r <= 5) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY name) AS r FROM rail) GROUP BY 1", "rail")
def ss02_routes_by_mode(spark, d):
    five = F.slice(F.sort_array(F.collect_list("name")), 1, 5)
    return graph(spark, d).node("Route").groupBy("mode").agg(F.count("*").alias("routes"), F.array_join(five, ",").alias("sample"))


@query("SELECT o_orderpriority AS service, count(DISTINCT strftime(o_orderdate, '%Y%m%d')) AS days, strftime(min(o_orderdate), '%Y%m%d') AS first_day, strftime(max(o_orderdate), '%Y%m%d') AS last_day FROM orders GROUP BY 1")
def ss04_active_days(spark, d):
    return graph(spark, d).node("Trip").groupBy("service").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("SELECT date, trips, extreme FROM (SELECT *, 'busiest' AS extreme, row_number() OVER (ORDER BY trips DESC, date) AS r FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS date, count(*) AS trips FROM orders GROUP BY 1) UNION ALL SELECT *, 'quietest', row_number() OVER (ORDER BY trips, date) FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS date, count(*) AS trips FROM orders GROUP BY 1)) WHERE r <= 10")
def ss05_busiest_and_quietest(spark, d):
    n = graph(spark, d).node("Trip").groupBy("date").agg(F.count("*").alias("trips"))
    a = n.orderBy(F.desc("trips"), "date").limit(10).withColumn("extreme", F.lit("busiest"))
    return a.unionByName(n.orderBy("trips", "date").limit(10).withColumn("extreme", F.lit("quietest")))


@query("SELECT strftime(o_orderdate, '%m%d') AS day, name AS holiday_name, count(*) AS trips FROM orders JOIN (SELECT unnest(['0101','0704','1225']) AS d, unnest(['New Year''s Day','Independence Day','Christmas Day']) AS name) ON strftime(o_orderdate, '%m%d') = d GROUP BY 1, 2")
def ss07_holiday_trips(spark, d):
    names = [(k[4:], n) for k, n in C.federal_holidays(1998, 1998) if n in ("New Year's Day", "Independence Day", "Christmas Day") and k[4:] in ("0101", "0704", "1225")]
    h = spark.createDataFrame(sorted(set(names)), "day string, holiday_name string")
    t = graph(spark, d).node("Trip").select(F.substring("date", 5, 4).alias("day"))
    return t.join(F.broadcast(h), "day").groupBy("day", "holiday_name").agg(F.count("*").alias("trips"))


@query("SELECT mode, count(DISTINCT l_orderkey) AS trips, count(DISTINCT l_partkey) AS stations FROM rail JOIN lineitem ON l_suppkey = id GROUP BY 1", "rail")
def ss08_trips_per_mode(spark, d):
    r = graph(spark, d).node("Route").select("id", "mode")
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.join(r, l.l_suppkey == r.id).groupBy("mode").agg(F.countDistinct("l_orderkey").alias("trips"), F.countDistinct("l_partkey").alias("stations"))


@query("SELECT r_name AS feed, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS zones, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS routes, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS riders FROM region")
def ss12_feed_counts(spark, d):
    g = graph(spark, d)
    zone = g.edge("PART_OF").select(F.col("src").alias("zone"), F.col("dst").alias("r"))
    out = g.node("Region").select(F.col("id").alias("r"), F.col("name").alias("feed"))
    for name, kind in (("zones", None), ("routes", "IN_ZONE"), ("riders", "LIVES_IN")):
        rows = zone if kind is None else g.edge(kind).join(zone, F.col("dst") == F.col("zone"))
        out = out.join(rows.groupBy("r").agg(F.count("*").alias(name)), "r", "left")
    return out.drop("r").fillna(0)


# --- evaluation-only shapes ---------------------------------------------------------------


@query("SELECT event_type AS route, date, count(*) AS n FROM intr WHERE event_type IN ('click', 'error') AND date IN ('20240103', '20240104') GROUP BY 1, 2", "intr")
def ev01_two_routes_two_dates(spark, d):
    return interruptions(spark, d).where(F.col("event_type").isin("click", "error") & F.col("date").isin("20240103", "20240104")).groupBy(F.col("event_type").alias("route"), "date").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS routes FROM (SELECT user_id FROM intr WHERE date = (SELECT max(date) FROM intr) GROUP BY 1 HAVING count(*) >= 1)", "intr")
def ev02_count_of_groups(spark, d):
    return G.latest(interruptions(spark, d), "date").groupBy("user_id").count().where("count >= 1").agg(F.count("*").alias("routes"))


@query("WITH a AS (SELECT user_id, count(*) AS skips FROM intr WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS delays FROM intr WHERE event_type = 'error' GROUP BY 1) SELECT user_id, skips, delays FROM a JOIN b USING (user_id)", "intr")
def ev03_both_kinds(spark, d):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    return interruptions(spark, d).groupBy("user_id").agg(n("view").alias("skips"), n("error").alias("delays")).where("skips > 0 and delays > 0")


@query("SELECT labels, count(*) AS n FROM (SELECT 'Station,' || p_type AS labels FROM part) GROUP BY 1")
def ev04_label_histogram(spark, d):
    return graph(spark, d).node("Station").groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS zone, (SELECT count(DISTINCT event_id) FROM events JOIN customer ON c_custkey = user_id WHERE c_nationkey = n_nationkey AND event_type = 'error') AS outages, (SELECT count(DISTINCT id) FROM intr JOIN customer ON c_custkey = user_id WHERE c_nationkey = n_nationkey) AS disruptions FROM nation", "intr")
def ev05_combined_counts(spark, d):
    g = graph(spark, d)
    c = g.node("Zone").select(F.col("id").alias("zone_id"), F.col("name").alias("zone"))
    home = g.edge("LIVES_IN").select(F.col("src").alias("user_id"), F.col("dst").alias("zone_id"))
    a = outages(spark, d).join(home, "user_id").groupBy("zone_id").agg(F.countDistinct("id").alias("outages"))
    b = interruptions(spark, d).join(home, "user_id").groupBy("zone_id").agg(F.countDistinct("id").alias("disruptions"))
    return c.join(a, "zone_id", "left").join(b, "zone_id", "left").drop("zone_id").fillna(0)


# --- ETL rules over tables shaped from the driver's -------------------------------------


@query(
    "WITH t AS (SELECT event_id AS e, user_id, CASE WHEN event_id % 17 = 0 THEN 'CANCELED' ELSE 'SCHEDULED' END AS rel, CAST(value * 10 AS INTEGER) AS delay FROM events), r AS (SELECT 'int_tu_' || e AS id, CASE WHEN rel = 'CANCELED' THEN 'Cancellation' ELSE 'Delay' END AS label, CASE WHEN rel = 'CANCELED' OR delay >= 900 THEN 'SEVERE' ELSE 'WARNING' END AS severity FROM t WHERE rel = 'CANCELED' OR delay >= 300 "
    "UNION ALL SELECT 'int_skip_' || event_id || '_1', 'Skip', 'WARNING' FROM events WHERE event_id % 5 = 0) SELECT label, severity, count(*) AS n, count(DISTINCT id) AS ids FROM r GROUP BY 1, 2"
)
def etl14_disruption_rules(spark, d):
    e = table(spark, d, "events")
    key = F.col("event_id").cast("string")
    trips = e.select(key.alias("feed_entity_id"), F.col("user_id").cast("string").alias("trip_id"), F.lit("R").alias("route_id"), F.when(F.col("event_id") % 17 == 0, "CANCELED").otherwise("SCHEDULED").alias("schedule_relationship"), F.round(F.col("value") * 10).cast("int").alias("delay"), F.lit(0).cast("long").alias("timestamp"), F.date_format("ts", "yyyyMMdd").alias("start_date"))
    stops = e.select(key.alias("parent_entity_id"), F.lit(1).alias("stop_sequence"), F.lit("S").alias("stop_id"), F.when(F.col("event_id") % 5 == 0, "SKIPPED").otherwise("SCHEDULED").alias("schedule_relationship"))
    out = interruption.trip_rules(trips, stops).interruptions
    return out.groupBy("label", "severity").agg(F.count("*").alias("n"), F.countDistinct("interruption_id").alias("ids"))


@query(
    "WITH a AS (SELECT event_id AS e, CASE event_type WHEN 'click' THEN 'DETOUR' WHEN 'view' THEN 'NO_EFFECT' WHEN 'error' THEN 'NO_SERVICE' WHEN 'signup' THEN 'STOP_MOVED' ELSE 'ACCESSIBILITY_ISSUE' END AS effect FROM events) "
    "SELECT CASE effect WHEN 'DETOUR' THEN 'Detour' WHEN 'NO_SERVICE' THEN 'Cancellation' WHEN 'STOP_MOVED' THEN 'ServiceChange' ELSE 'Accessibility' END AS label, count(*) AS n, count(*) AS stops FROM a WHERE effect <> 'NO_EFFECT' GROUP BY 1"
)
def etl15_alert_rules(spark, d):
    e = table(spark, d, "events")
    key = F.col("event_id").cast("string")
    effect = C.decode(F.col("event_type"), {"click": "DETOUR", "view": "NO_EFFECT", "error": "NO_SERVICE", "signup": "STOP_MOVED"}, "ACCESSIBILITY_ISSUE")
    alerts = e.select(key.alias("feed_entity_id"), F.lit("OTHER_CAUSE").alias("cause"), effect.alias("effect"), F.lit("INFO").alias("severity_level"), F.lit("h").alias("header_text"), F.lit(1704067200).cast("long").alias("active_period_start"), F.lit(None).cast("long").alias("active_period_end"))
    selectors = e.select(key.alias("parent_entity_id"), F.lit(None).cast("string").alias("trip_id"), F.lit(None).cast("string").alias("route_id"), F.col("user_id").cast("string").alias("stop_id"))
    out = interruption.alert_rules(alerts, selectors)
    n = out.interruptions.groupBy("label").agg(F.count("*").alias("n"))
    stops = out.affects_stop.join(out.interruptions.select("interruption_id", "label"), "interruption_id").groupBy("label").agg(F.count("*").alias("stops"))
    return n.join(stops, "label")


@query(
    "WITH o AS (SELECT DISTINCT 'U' || user_id || '|' || epoch_ms(date_trunc('day', ts)) || '|' || epoch_ms(date_trunc('hour', ts)) AS k, CASE user_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS severity, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 2 END AS days FROM events WHERE event_type = 'error') SELECT severity, days, count(*) AS n FROM o GROUP BY 1, 2"
)
def etl17_outage_normalisation(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    incidents = e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("UnitName"), F.lit("ESCALATOR").alias("UnitType"), F.lit("A01").alias("StationCode"), F.lit("between a and b").alias("LocationDescription"),
        C.decode(F.col("user_id") % 4, {0: "Major Repair", 1: "Modernization", 2: "Other"}, "Unheard").alias("SymptomDescription"),
        iso(F.date_trunc("day", "ts")).alias("DateOutOfService"), iso(F.date_trunc("hour", "ts")).alias("DateUpdated"),
        F.when(F.col("user_id") % 3 == 0, "UNKNOWN").otherwise(iso(F.date_trunc("day", "ts") + F.expr("interval 2 days 5 hours"))).alias("EstimatedReturnToService"),
    )
    out = accessibility.outages(incidents, F.lit("2024-02-01T00:00:00"))
    return out.groupBy("severity", F.col("projected_duration_days").cast("int").alias("days")).agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT l_orderkey AS rule, l_linenumber, 'g' || l_returnflag AS grp, 'STN_' || (l_suppkey % 7) AS a, 'STN_' || (l_partkey % 7) AS b, l_quantity FROM lineitem) "
    "SELECT count(DISTINCT (grp, a, b)) AS rules, count(DISTINCT (grp, a, b, CAST(l_quantity AS INTEGER))) AS applies FROM l"
)
def etl13_fare_rules(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    area = lambda c: F.concat(F.lit("STN_"), (F.col(c) % 7).cast("string"))
    raw = l.select(F.concat(F.lit("g"), "l_returnflag").alias("leg_group_id"), F.lit("metrorail").alias("network_id"), area("l_suppkey").alias("from_area_id"), area("l_partkey").alias("to_area_id"), F.concat(F.lit("metrorail_one_way_full_fare_"), F.col("l_quantity").cast("int").cast("string")).alias("fare_product_id"), F.lit("peak").alias("from_timeframe_group_id"), F.monotonically_increasing_id().alias("_ordinal"))
    stops = spark.range(7).select(F.concat(F.lit("STN_"), F.col("id").cast("string")).alias("stop_id"), F.col("id").cast("string").alias("zone_id"), F.col("id").alias("_ordinal"))
    products = raw.select("fare_product_id", F.lit("card").alias("fare_media_id"), F.lit("2.0").alias("amount"), "_ordinal")
    out = fare_plan.leg_rules(raw, stops, products)
    return out["leg_rules"].agg(F.count("*").alias("rules")).crossJoin(out["applies_product"].agg(F.count("*").alias("applies")))


@query(
    "WITH c AS (SELECT n_nationkey AS id, n_nationkey % 7 AS wd, DATE '2024-01-01' + n_nationkey AS a FROM nation), days AS (SELECT id, unnest(generate_series(a, DATE '2024-01-31', INTERVAL 1 DAY)) AS d, wd FROM c) "
    "SELECT 'S' || id AS service_id, CASE WHEN wd < 5 THEN 'Weekday' WHEN wd = 5 THEN 'Saturday' ELSE 'Sunday' END AS label, count(*) AS days FROM days WHERE isodow(d) - 1 = wd GROUP BY 1, 2"
)
def etl07_calendar(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    flags = {name: F.when(k % 7 == i, "1").otherwise("0").alias(name) for i, name in enumerate(schedule.DAYS)}
    cal = n.select(F.concat(F.lit("S"), k.cast("string")).alias("service_id"), *flags.values(), F.date_format(F.expr("date_add(DATE'2024-01-01', n_nationkey)"), "yyyyMMdd").alias("start_date"), F.lit("20301231").alias("end_date"))
    feed = spark.createDataFrame([("20230601", "20240131")], "feed_start_date string, feed_end_date string")
    services, active = schedule.calendar(cal, None, feed)
    return active.groupBy("service_id").agg(F.count("*").alias("days")).join(services, "service_id").select("service_id", "label", "days")


@query(
    "WITH p AS (SELECT l_orderkey || '_' || l_linenumber AS id, l_partkey % 3 AS f, l_suppkey % 3 AS t, l_linenumber AS mode FROM lineitem), s AS (SELECT *, CASE f WHEN 0 THEN 'UNPAID' WHEN 1 THEN 'PAID' ELSE 'UNKNOWN' END AS fs, CASE t WHEN 0 THEN 'UNPAID' WHEN 1 THEN 'PAID' ELSE 'UNKNOWN' END AS ts FROM p) "
    "SELECT CASE WHEN mode = 7 AND fs = 'PAID' AND ts = 'UNPAID' THEN 'exit_gate' WHEN mode = 6 AND fs <> ts THEN 'cross_faregate' WHEN fs = 'UNPAID' AND ts = 'UNPAID' THEN 'pregate_internal' WHEN fs = 'PAID' AND ts = 'PAID' THEN 'postgate_internal' WHEN (fs = 'PAID' OR ts = 'PAID') AND fs <> 'UNPAID' AND ts <> 'UNPAID' THEN 'postgate_internal' WHEN (fs = 'UNPAID' OR ts = 'UNPAID') AND fs <> 'PAID' AND ts <> 'PAID' THEN 'pregate_internal' ELSE 'mixed_non_gate' END AS side_category, count(*) AS n FROM s GROUP BY 1"
)
def etl03_pathway_sides(spark, d):
    stops = spark.createDataFrame([("ENT_0", "2"), ("PF_1", "0"), ("NODE_2", "3")], "stop_id string, location_type string").withColumns({"parent_station": F.lit(None).cast("string")})
    end = lambda c: F.when(F.col(c) % 3 == 0, "ENT_0").when(F.col(c) % 3 == 1, "PF_1").otherwise("NODE_2")
    p = table(spark, d, "lineitem").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("pathway_id"), F.col("l_linenumber").cast("string").alias("pathway_mode"), end("l_partkey").alias("from_stop_id"), end("l_suppkey").alias("to_stop_id"))
    return physical.sides(p, physical.stop_kinds(stops)).groupBy("side_category").agg(F.count("*").alias("n"))
