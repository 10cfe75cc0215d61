"""Scans, projections, filters, joins, aggregates, ordering and functions over
the bound graph; each query names the operator that it shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import columns as C
from meshline.operators import graph as G
from meshline.operators.graph import Match
from meshline.plans.binding import graph, interruptions, query, serves, table

# --- scans, projections, filters ----------------------------------------------


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey < 12")
def src13_sub_label_scan(spark, d):
    return graph(spark, d).node("Route:Rail").select("id", "name")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey = 42")
def src14_point_lookup(spark, d):
    return Match(graph(spark, d)).start("s", "Station", lambda t: t.id == 42).select(F.col("s__id").alias("id"), F.col("s__name").alias("name"), F.col("s__size").alias("size"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS trips FROM lineitem")
def src15_edge_only_scan(spark, d):
    return graph(spark, d).edge("SCHEDULED_AT").agg(F.count("*").alias("n"), F.countDistinct("src").alias("trips"))


@query("SELECT unnest(['AFFECTS','IN_ZONE','LIVES_IN','PART_OF','PLACED','RUNS','SCHEDULED_AT','SERVES']) AS kind, unnest(['Interruption','Route','Rider','Zone','Rider','Route','Trip','Route']) AS source, unnest(['Rider','Zone','Zone','Region','Trip','Trip','Station','Station']) AS target")
def src17_schema_introspection(spark, d):
    rel = graph(spark, d).introspect()["relationships"]
    return spark.createDataFrame([(k, s, t) for k, (s, t, _) in sorted(rel.items())], "kind string, source string, target string")


@query("SELECT p_partkey AS station_id, p_name AS station_name, p_retailprice * 2 AS double_price FROM part WHERE p_size = 50")
def prj01_return_alias(spark, d):
    return graph(spark, d).node("Station").where("size = 50").select(F.col("id").alias("station_id"), F.col("name").alias("station_name"), (F.col("price") * 2).alias("double_price"))


@query("SELECT dst AS station, count(*) AS routes FROM serves GROUP BY 1 HAVING count(*) > 1", "serves")
def prj02_with_having(spark, d):
    return serves(spark, d).groupBy(F.col("dst").alias("station")).agg(F.count("*").alias("routes")).where("routes > 1")


@query("SELECT c_custkey AS rider, c_name AS rider_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def prj03_rename_and_drop(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumnsRenamed({"c_custkey": "rider", "c_name": "rider_name"}).drop("c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 200000 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1")
def prj04_case_searched(spark, d):
    band = F.when(F.col("o_totalprice") >= 400000, "high").when(F.col("o_totalprice") >= 200000, "middle").otherwise("low")
    return table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS trip, coalesce(max(l_linenumber), 0) AS stops FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def prj05_coalesce_optional(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select(F.col("o_orderkey").alias("trip"), F.coalesce("m", F.lit(0)).alias("stops"))


@query("SELECT mode, count(*) AS n FROM rail GROUP BY 1", "rail")
def prj06_label_predicate(spark, d):
    mode = F.when(C.has_label(F.col("labels"), "Rail"), "Rail").otherwise("Bus")
    return graph(spark, d).node("Route").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag || '_' || CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE '?' END AS state, count(*) AS n FROM lineitem GROUP BY 1")
def prj08_map_with_default(spark, d):
    status = C.decode(F.col("l_linestatus"), {"O": "open", "F": "done"}, "?")
    return table(spark, d, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", status).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey::VARCHAR || '__' || l_linenumber::VARCHAR || '__' || coalesce(nullif(l_returnflag, 'N'), 'NULL') AS rule_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def prj09_composite_id(spark, d):
    rid = F.concat_ws("__", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("NULL")))
    return table(spark, d, "lineitem").groupBy(rid.alias("rule_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'small%' AND p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 10 AND 20 AND p_brand IS NOT NULL")
def flt01_predicates(spark, d):
    s = graph(spark, d).node("Station")
    keep = F.contains(F.col("name"), F.lit("ring")) & ~F.col("name").startswith("small") & F.col("type").isin("ECONOMY", "PROMO") & F.col("size").between(10, 20) & F.col("brand").isNotNull()
    return s.where(keep).select("id", "name")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND a.s_acctbal > b.s_acctbal")
def flt06_inequality(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.s_nationkey") == F.col("b.s_nationkey")).where("a.s_suppkey <> b.s_suppkey and a.s_acctbal > b.s_acctbal").select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT o_orderkey AS trip FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def flt07_pattern_predicate(spark, d):
    return Match(graph(spark, d)).start("t", "Trip").exists("SCHEDULED_AT", negated=True).select(F.col("t__id").alias("trip"))


@query("SELECT p_type AS type, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY 1")
def flt08_any_label(spark, d):
    return graph(spark, d).node("Station").where(C.has_label(F.col("labels"), "ECONOMY", "PROMO", "NONE")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE c_name LIKE '%7' AND regexp_matches(substr(c_name, 10), '^[0-9]+$') AND contains(c_name, '#')")
def flt09_string_masks(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").where(c.endswith("7") & F.substring(c, 10, 100).rlike("^[0-9]+$") & F.contains(c, F.lit("#"))).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS trip FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def flt10_id_set(spark, d):
    few = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    o = table(spark, d, "orders")
    return o.join(few, o.o_custkey == few.c_custkey, "left_semi").select(F.col("o_orderkey").alias("trip"))


@query("SELECT severity, count(*) AS n, round(sum(value), 2) AS total FROM intr GROUP BY 1", "intr")
def flt11_thresholds(spark, d):
    return interruptions(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- joins ---------------------------------------------------------------------


@query("SELECT s_name AS route, p_name AS station FROM serves JOIN supplier ON src = s_suppkey JOIN part ON dst = p_partkey", "serves")
def jn01_one_hop(spark, d):
    return Match(graph(spark, d)).start("r", "Route").out("SERVES", "s", "Station").select(F.col("r__name").alias("route"), F.col("s__name").alias("station"))


@query("SELECT r_name AS region, count(*) AS trips FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def jn02_multi_hop(spark, d):
    m = Match(graph(spark, d)).start("t", "Trip").inn("PLACED", "c").out("LIVES_IN", "z").out("PART_OF", "r", "Region")
    return m.df.groupBy(F.col("r__name").alias("region")).agg(F.count("*").alias("trips"))


@query("SELECT n_name AS zone, count(DISTINCT dst) AS stations, count(DISTINCT o.o_orderkey) AS trips FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN serves ON src = s_suppkey JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l ON l_suppkey = s_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority = '1-URGENT' GROUP BY 1", "serves")
def jn03_star(spark, d):
    # two fans of one route are counted apart, so the product of the fans is never made
    g = graph(spark, d)
    stations = Match(g).start("r", "Route").out("SERVES", "s").df.select(F.col("r__id").alias("r"), F.col("s__id").alias("s"))
    trips = Match(g).start("r", "Route").out("RUNS", "t", "Trip", where=lambda t: t.service == "1-URGENT").df.select(F.col("r__id").alias("r"), F.col("t__id").alias("t"))
    zone = Match(g).start("r", "Route").out("IN_ZONE", "z", "Zone").df.select(F.col("r__id").alias("r"), F.col("z__name").alias("zone"))
    zone = zone.join(stations.select("r").distinct(), "r", "left_semi").join(trips.select("r").distinct(), "r", "left_semi")
    a = zone.join(stations, "r").groupBy("zone").agg(F.countDistinct("s").alias("stations"))
    return a.join(zone.join(trips, "r").groupBy("zone").agg(F.countDistinct("t").alias("trips")), "zone")


@query("SELECT c_custkey AS rider, count(i.id) AS interruptions FROM customer LEFT JOIN intr i ON i.user_id = c_custkey GROUP BY 1", "intr")
def jn04_optional(spark, d):
    m = Match(graph(spark, d)).start("c", "Rider").optional(lambda q: q.inn("AFFECTS", "i"))
    return m.df.groupBy(F.col("c__id").alias("rider")).agg(F.count("i__id").alias("interruptions"))


@query("SELECT s_suppkey AS route, count(DISTINCT dst) AS stations, count(DISTINCT l_orderkey) AS trips FROM supplier LEFT JOIN serves ON src = s_suppkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1", "serves")
def jn05_cascaded_optional(spark, d):
    # each optional branch is aggregated alone, then joined: no product of branches
    g = graph(spark, d)
    routes = g.node("Route").select(F.col("id").alias("route"))
    a = g.edge("SERVES").groupBy(F.col("src").alias("route")).agg(F.countDistinct("dst").alias("stations"))
    b = g.edge("RUNS").groupBy(F.col("src").alias("route")).agg(F.countDistinct("dst").alias("trips"))
    return routes.join(a, "route", "left").join(b, "route", "left").fillna(0)


@query("SELECT a.o_custkey AS block, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1")
def jn06_block_pairs(spark, d):
    # pairs of a block of n trips are n (n - 1) / 2; no self-join is needed to count them
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("block")).agg(F.count("*").alias("n"))
    return n.where("n > 1").select("block", F.expr("n * (n - 1) div 2").alias("pairs"))


@query(
    "WITH p AS (SELECT p_partkey AS id, 38.5 + (p_partkey * 7919 % 1000) / 2500.0 AS lat, -77.5 + (p_partkey * 104729 % 1000) / 2000.0 AS lon FROM part) "
    "SELECT a.id AS a, b.id AS b FROM p a, p b WHERE a.id < b.id AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 400"
)
def jn07_within_400_m(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), (F.lit(38.5) + (k * 7919 % 1000) / 2500.0).alias("lat"), (F.lit(-77.5) + (k * 104729 % 1000) / 2000.0).alias("lon"))
    return G.near(p, p, 400.0).where("a < b").select("a", "b")


@query("SELECT x.src AS a, y.src AS b, count(*) AS shared FROM serves x JOIN serves y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2", "serves")
def jn08_common_neighbour(spark, d):
    return G.common_neighbours(serves(spark, d))


@query("SELECT n_nationkey AS zone, count(*) AS incident FROM (SELECT s_nationkey AS n_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY 1")
def jn09_undirected(spark, d):
    # IN_ZONE from routes and PART_OF to regions, seen from the zone's side either way
    g = graph(spark, d)
    zone = Match(g).start("z", "Zone")
    a = zone.step("IN_ZONE", "x", None, "in").df.select("z__id")
    b = zone.out("PART_OF", "x").df.select("z__id")
    return a.unionAll(b).groupBy(F.col("z__id").alias("zone")).agg(F.count("*").alias("incident"))


@query("SELECT user_id, id, value FROM intr WHERE date = (SELECT max(date) FROM intr)", "intr")
def jn11_latest_date(spark, d):
    return G.latest(interruptions(spark, d), "date").select("user_id", "id", "value")


@query("WITH busy AS (SELECT l_suppkey AS r, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 590) SELECT r AS route, trips, count(dst) AS stations FROM busy JOIN serves ON src = r GROUP BY 1, 2", "serves")
def jn12_having_then_join(spark, d):
    g = graph(spark, d)
    busy = g.edge("RUNS").groupBy(F.col("src").alias("route")).agg(F.countDistinct("dst").alias("trips")).where("trips > 590")
    return busy.join(g.edge("SERVES").groupBy(F.col("src").alias("route")).agg(F.count("dst").alias("stations")), "route")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS semi, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS anti")
def jn13_semi_anti(spark, d):
    m = Match(graph(spark, d)).start("t", "Trip")
    a, b = m.exists("SCHEDULED_AT").df.agg(F.count("*").alias("semi")), m.exists("SCHEDULED_AT", negated=True).df.agg(F.count("*").alias("anti"))
    return a.crossJoin(b)


@query("SELECT p_brand AS brand, min(p_partkey) AS first_station, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1")
def jn16_lookup_on_deduped(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("first_station"), F.col("p_name").alias("name"))
    return G.keep_first(p, ["brand"], [F.col("first_station")])


@query("SELECT DISTINCT a.s_suppkey AS src, b.s_suppkey AS dst, a.s_nationkey AS pivot FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def jn17_contract_pivots(spark, d):
    s = table(spark, d, "supplier")
    links = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit(True).alias("two_way"))
    pivots = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    n = lambda c: F.substring(c, 2, 20).cast("long")
    return G.contract(links, pivots).select(n(F.col("src")).alias("src"), n(F.col("dst")).alias("dst"), n(F.col("pivot")).cast("int").alias("pivot"))


@query("WITH u AS (SELECT l_orderkey AS unit, min(l_linenumber) AS lo, max(l_linenumber) AS hi, min(l_suppkey) % 5 AS station FROM lineitem GROUP BY 1), lv AS (SELECT DISTINCT p_size % 5 AS station, p_size % 7 + 1 AS level FROM part) SELECT unit AS unit, level AS level_index FROM u JOIN lv USING (station) WHERE level BETWEEN lo AND hi")
def jn18_range_join(spark, d):
    units = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.min("l_linenumber").alias("lowest"), F.max("l_linenumber").alias("highest"), (F.min("l_suppkey") % 5).alias("station"))
    levels = table(spark, d, "part").select((F.col("p_size") % 5).alias("station"), (F.col("p_size") % 7 + 1).alias("level_index")).distinct().withColumn("level_id", F.col("level_index").cast("string"))
    return G.spans(units, levels).select("unit", "level_index")


@query("SELECT s_suppkey AS route, r_name AS feed FROM supplier, (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1)")
def jn22_one_row_cross(spark, d):
    from meshline.operators.upsert import from_feed

    feed = table(spark, d, "region").orderBy("r_regionkey").limit(1).select(F.col("r_name").alias("feed"))
    return from_feed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("route")), feed)


@query("SELECT o_orderkey AS trip, c_name AS rider, n_name AS zone FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")
def jn14_inner_and_left(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey = 2")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("o_orderkey").alias("trip"), F.col("c_name").alias("rider"), F.col("n_name").alias("zone"))


# --- aggregates, ranks, order, sets ----------------------------------------------


@query("SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_orderkey) AS trips, count(DISTINCT l_suppkey) AS routes, min(l_linenumber) AS first_stop, max(l_linenumber) AS last_stop, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY 1")
def ag01_counts_and_extremes(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("trips"), F.countDistinct("l_suppkey").alias("routes"), F.min("l_linenumber").alias("first_stop"), F.max("l_linenumber").alias("last_stop"), F.round(F.avg("l_quantity"), 2).alias("mean"))


@query("SELECT p_brand AS brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, array_to_string(list_slice(list_sort(list(p_partkey)), 1, 5), ',') AS first_five FROM part GROUP BY 1")
def ag06_collect_and_slice(spark, d):
    five = F.slice(F.sort_array(F.collect_list("p_partkey")), 1, 5)
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"), F.array_join(F.transform(five, lambda x: x.cast("string")), ",").alias("first_five"))


@query("SELECT mode, 'Route,' || mode AS labels, count(*) AS n FROM rail GROUP BY 1, 2", "rail")
def ag08_group_by_labels(spark, d):
    return graph(spark, d).node("Route").groupBy("mode", "labels").agg(F.count("*").alias("n")).select("mode", F.array_join("labels", ",").alias("labels"), "n")


@query("SELECT count(*) AS n, CAST(coalesce(sum(s_nationkey), 0) AS BIGINT) AS total FROM supplier WHERE s_suppkey < 0")
def ag09_empty_global(spark, d):
    return table(spark, d, "supplier").where("s_suppkey < 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("s_nationkey"), F.lit(0)).cast("long").alias("total"))


@query("SELECT p_type AS type, round(100.0 * sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) / count(*), 2) AS percent_large, round(1.0 * sum(p_size) / count(*), 3) AS impact FROM part GROUP BY 1")
def ag10_over_aggregates(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("type")).agg(C.percent(F.count(F.when(F.col("p_size") > 25, 1)), F.count("*")).alias("percent_large"), F.round(F.lit(1.0) * F.sum("p_size") / F.count("*"), 3).alias("impact"))


@query("SELECT count(*) AS repeated_keys, CAST(sum(n) AS BIGINT) AS \"rows\" FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def ag11_duplicate_keys(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("repeated_keys"), F.sum("n").alias("rows"))


@query("SELECT o_custkey AS shape, count(DISTINCT o_orderpriority) AS routes, arg_min(o_orderkey, o_orderkey) AS first_trip, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS first_known FROM orders GROUP BY 1")
def ag12_nunique_and_first_known(spark, d):
    known = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("shape")).agg(F.countDistinct("o_orderpriority").alias("routes"), F.min("o_orderkey").alias("first_trip"), F.min_by("o_orderstatus", known).alias("first_known"))


@query("SELECT l_orderkey AS trip, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_stop, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_stop FROM lineitem GROUP BY 1")
def ag16_first_and_last(spark, d):
    at = F.struct("l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.min(at)["l_partkey"].alias("first_stop"), F.max(at)["l_partkey"].alias("last_stop"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS states FROM events WHERE value >= 50 GROUP BY 1")
def ag15_joined_in_order(spark, d):
    return table(spark, d, "events").where("value >= 50").groupBy("user_id").agg(C.joined(F.col("event_type"), "|", F.col("ts"), F.col("event_id")).alias("states"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def ag17_value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def ag18_drop_duplicates(spark, d):
    return G.keep_first(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("SELECT s_suppkey AS route, coalesce(n, 0) AS degree FROM supplier LEFT JOIN (SELECT src, count(*) AS n FROM serves GROUP BY 1) ON src = s_suppkey", "serves")
def ag19_degree_subquery(spark, d):
    n = serves(spark, d).groupBy("src").agg(F.count("*").alias("degree"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("route"))
    return s.join(n, s.route == n.src, "left").select("route", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("SELECT event_type AS domain, round(100.0 * sum(CASE WHEN value >= 30 THEN 1 ELSE 0 END) / count(*), 1) AS pass_rate, round(avg(CASE WHEN value < 100 THEN value END), 2) AS mean_of_passed FROM events GROUP BY 1")
def ag20_conditional(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("domain")).agg(C.percent(F.count(F.when(F.col("value") >= 30, 1)), F.count("*"), 1).alias("pass_rate"), F.round(F.avg(F.when(F.col("value") < 100, F.col("value"))), 2).alias("mean_of_passed"))


@query("SELECT id, n, position, total FROM (SELECT src AS id, n, row_number() OVER (ORDER BY n DESC, src) AS position, count(*) OVER () AS total FROM (SELECT src, count(*) AS n FROM serves GROUP BY 1)) WHERE id = 5", "serves")
def wn01_rank_of_one(spark, d):
    n = serves(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return G.rank_among(n, "n", "id").where("id = 5").select("id", "n", "position", "total")


@query("SELECT a.l_orderkey AS trip, b.l_partkey AS station, b.l_linenumber - a.l_linenumber AS stops_away FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey = 100 AND b.l_linenumber > a.l_linenumber")
def wn02_stops_away(spark, d):
    e = graph(spark, d).edge("SCHEDULED_AT")
    a = e.where("dst = 100").select("src", F.col("stop_sequence").alias("at"))
    return e.join(a, "src").where("stop_sequence > at").select(F.col("src").alias("trip"), F.col("dst").alias("station"), (F.col("stop_sequence") - F.col("at")).alias("stops_away"))


@query("SELECT s_suppkey AS route, s_nationkey AS zone FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1)")
def wn03_alone_in_pool(spark, d):
    from meshline.operators.resolve import unique_in_pool

    return unique_in_pool(table(spark, d, "supplier").select(F.col("s_suppkey").alias("route"), F.col("s_nationkey").alias("zone")), "zone")


@query("SELECT l_suppkey AS route, l_orderkey AS trip, l_quantity AS quantity FROM (SELECT l_suppkey, l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def wn04_top_three(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return G.top_per_group(l, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 3).select(F.col("l_suppkey").alias("route"), F.col("l_orderkey").alias("trip"), F.col("l_quantity").alias("quantity"))


@query("SELECT p_brand AS brand, p_partkey AS station, p_size AS size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1")
def wn05_ties_kept(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("station"), F.col("p_size").alias("size"))
    return G.top_per_group(p, ["brand"], [F.desc("size")], 1, ties=True)


@query("SELECT id, n FROM (SELECT c_custkey AS id, n FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) ORDER BY n DESC NULLS FIRST, id LIMIT 20")
def so01_nulls_first_top_k(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(o, c.id == o.o_custkey, "left").select("id", "n").orderBy(F.col("n").desc_nulls_first(), "id").limit(20)


@query("SELECT n_name AS name, try_cast(substr(n_name, 8) AS INTEGER) AS number FROM nation ORDER BY number DESC, n_name LIMIT 10")
def so02_order_by_number(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.substring("n_name", 8, 10).try_cast("int").alias("number")).orderBy(F.desc("number"), "name").limit(10)


@query("SELECT id, kind FROM (SELECT s_suppkey AS id, 'Route' AS kind FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT c_custkey, 'Rider' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'Rider' FROM customer WHERE c_acctbal < -500)")
def st01_union_all(spark, d):
    g = graph(spark, d)
    a = g.node("Route").where("balance < 0").select("id", F.lit("Route").alias("kind"))
    b = g.node("Rider").select("id", F.lit("Rider").alias("kind"), "balance")
    return a.unionByName(b.where("balance < 0").drop("balance")).unionByName(b.where("balance < -500").drop("balance"))


@query("SELECT DISTINCT o_custkey AS rider, o_orderpriority AS service FROM orders")
def st02_distinct(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("rider"), F.col("o_orderpriority").alias("service")).distinct()


@query("SELECT l_partkey AS station FROM lineitem WHERE l_quantity >= 49 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def st03_union_distinct(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("station"))
    return a.unionAll(table(spark, d, "part").where("p_size = 1").select("p_partkey")).distinct()


@query("SELECT 'orphan' AS kind, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'shared', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)")
def st04_difference_intersection(spark, d):
    a = table(spark, d, "orders").select("o_orderkey").subtract(table(spark, d, "lineitem").select("l_orderkey"))
    b = table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "supplier").select("s_suppkey"))
    return a.agg(F.lit("orphan").alias("kind"), F.count("*").alias("n")).unionAll(b.agg(F.lit("shared").alias("kind"), F.count("*").alias("n")))


@query("SELECT p_partkey AS id FROM part WHERE (p_size > 25) <> (p_retailprice > 950)")
def st05_xor(spark, d):
    return table(spark, d, "part").where((F.col("p_size") > 25) != (F.col("p_retailprice") > 950)).select(F.col("p_partkey").alias("id"))


@query("SELECT s_suppkey AS route, dst AS station FROM supplier JOIN serves ON src = s_suppkey ORDER BY 1, 2 LIMIT 40", "serves")
def so04_sample_by_id(spark, d):
    m = Match(graph(spark, d)).start("r", "Route").out("SERVES", "s")
    return m.select(F.col("r__id").alias("route"), F.col("s__id").alias("station")).orderBy("route", "station").limit(40)


@query("SELECT event_id, CAST(split_part('Stop ' || event_type || ' skipped', ' ', 2) AS VARCHAR) AS stop, replace('int_sa_' || CAST(event_id AS VARCHAR), 'int_sa_', '') AS source FROM events")
def str05_split_and_replace(spark, d):
    text = F.concat(F.lit("Stop "), F.col("event_type"), F.lit(" skipped"))
    return table(spark, d, "events").select("event_id", F.split(F.split(text, "Stop ")[1], " ")[0].alias("stop"), F.regexp_replace(F.concat(F.lit("int_sa_"), F.col("event_id").cast("string")), "^int_sa_", "").alias("source"))


# --- functions -------------------------------------------------------------------


@query(
    "SELECT p_partkey AS id, upper(p_name) AS up, lower(p_brand) AS low, p_name || ' / ' || p_type AS both_names, CAST(p_size AS VARCHAR) AS size_text, split_part(p_brand, '#', 2) AS number, "
    "ltrim(lpad(CAST(p_size AS VARCHAR), 4, '0'), '0') AS stripped, replace(p_name, 'ring', 'RING') AS replaced, regexp_extract(p_brand, '#([0-9]+)$', 1) AS suffix, substr(sha256(p_name || '|' || p_brand), 1, 16) AS hash, nullif(trim('  '), '') AS empty FROM part"
)
def str01_string_functions(spark, d):
    p = table(spark, d, "part")
    n, b, s = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.upper(n).alias("up"),
        F.lower(b).alias("low"),
        F.concat(n, F.lit(" / "), F.col("p_type")).alias("both_names"),
        s.alias("size_text"),
        F.split(b, "#")[1].alias("number"),
        F.ltrim(F.lpad(s, 4, "0"), F.lit("0")).alias("stripped"),
        F.replace(n, F.lit("ring"), F.lit("RING")).alias("replaced"),
        F.regexp_extract(b, r"#(\d+)$", 1).alias("suffix"),
        C.content_hash(n, b).alias("hash"),
        C.clean(F.lit("  ")).alias("empty"),
    )


@query(
    "WITH t AS (SELECT p_partkey AS id, 'Escalator between ' || split_part(p_name, ' ', 2) || ' and  ' || split_part(p_name, ' ', 1) || ' to X' AS txt FROM part) "
    "SELECT id, least(split_part(n, ' ', 1), split_part(n, ' ', 2)) || '_' || greatest(split_part(n, ' ', 1), split_part(n, ' ', 2)) AS key FROM (SELECT id, p_name AS n FROM t JOIN part ON p_partkey = id)"
)
def str08_segment_key(spark, d):
    n = F.split("p_name", " ")
    text = F.concat(F.lit("Escalator Between "), n[1], F.lit(" and  "), n[0], F.lit(" to X"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.segment_key(text).alias("key"))


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE 'small%' THEN 'S' WHEN p_name LIKE 'red%' THEN 'R' WHEN p_name LIKE 'r%' THEN 'r' END AS code, CASE WHEN p_size >= 10 THEN p_size / 100.0 END AS amount FROM part")
def str11_prefix_and_amount(spark, d):
    pid = F.when(F.col("p_size") >= 10, F.concat(F.lit("fare_"), F.col("p_size").cast("string"))).otherwise("fare_free")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.by_prefix(F.col("p_name"), [("small", "S"), ("red", "R"), ("r", "r")]).alias("code"), C.amount_in_id(pid).alias("amount"))


@query("SELECT s_suppkey AS id, 'name: ' || s_name || ', zone: ' || CAST(s_nationkey AS VARCHAR) AS text FROM supplier")
def str16_property_text(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.property_text(name=F.col("s_name"), zone=F.col("s_nationkey")).alias("text"))


@query(
    "WITH t AS (SELECT l_orderkey AS trip, l_linenumber AS stop, (l_orderkey * 37 + l_linenumber * 611) % 100000 AS s FROM lineitem) "
    "SELECT trip, stop, s AS seconds, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') AS clock FROM t"
)
def dt01_service_time(spark, d):
    s = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 611) % 100000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))
    # a step for each expression that the next uses more than once, so that it is computed once
    texts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("stop"), text.alias("text"))
    parsed = texts.select("trip", "stop", C.service_seconds(F.col("text")).cast("long").alias("seconds"))
    return parsed.select("trip", "stop", "seconds", C.clock(F.col("seconds")).alias("clock"))


@query(
    "SELECT o_orderkey AS trip, strftime(o_orderdate, '%Y%m%d') AS date, dayname(o_orderdate) AS day, isodow(o_orderdate) - 1 AS weekday, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, "
    "CAST(floor((epoch_ms(TIMESTAMP '2000-01-01') - epoch_ms(o_orderdate)) / 86400000.0) AS BIGINT) AS days FROM orders"
)
def dt03_dates(spark, d):
    key = C.date_key(F.col("o_orderdate"))
    ms = C.epoch_millis(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    day = C.date_of(key)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trip"), key.alias("date"), C.day_name(day).alias("day"), F.weekday(day).cast("long").alias("weekday"), ms.alias("ms"), C.iso_of_millis(ms).alias("iso"), C.whole_days(F.lit(946684800000), ms).alias("days")
    )


@query(
    "WITH r AS (SELECT n_nationkey AS id, DATE '2024-01-01' + n_nationkey AS a, DATE '2024-01-20' + (n_nationkey * 3 % 20) AS b, n_nationkey % 7 AS wd FROM nation) "
    "SELECT id, strftime(d, '%Y%m%d') AS date FROM (SELECT id, wd, unnest(generate_series(greatest(a, DATE '2024-01-05'), least(b, DATE '2024-02-01'), INTERVAL 1 DAY)) AS d FROM r WHERE greatest(a, DATE '2024-01-05') <= least(b, DATE '2024-02-01')) WHERE isodow(d) - 1 = wd"
)
def dt05_clipped_range(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.expr("date_add(DATE'2024-01-01', n_nationkey)").alias("a"), F.expr("date_add(DATE'2024-01-20', n_nationkey * 3 % 20)").alias("b"), (F.col("n_nationkey") % 7).alias("wd"))
    clipped = n.select("id", "wd", F.greatest("a", F.lit("2024-01-05").cast("date")).alias("a"), F.least("b", F.lit("2024-02-01").cast("date")).alias("b")).where("a <= b")
    return clipped.select("id", "wd", F.explode(F.sequence("a", "b")).alias("d")).where("weekday(d) = wd").select("id", C.date_key(F.col("d")).alias("date"))


@query("SELECT unnest(['20240101','20240115','20240219','20240527','20240619','20240704','20240902','20241014','20241111','20241128','20241225']) AS date, unnest(['New Year''s Day','MLK Day','Presidents'' Day','Memorial Day','Juneteenth','Independence Day','Labor Day','Columbus Day','Veterans Day','Thanksgiving','Christmas Day']) AS name")
def dt08_holidays(spark, d):
    return spark.createDataFrame(C.federal_holidays(2024, 2024), "date string, name string")


@query(
    "SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice / 7, 2) AS r2, l_orderkey // 7 AS q, l_orderkey % 7 AS m, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(100.0 * l_quantity / (l_linenumber - 1), 2) END AS pct, try_cast(CASE WHEN l_linenumber = 2 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS INTEGER) AS i, round(l_quantity * 0.25 / 1000000 * 1000, 6) AS cost FROM lineitem"
)
def ma01_arithmetic(spark, d):
    k, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        k.alias("id"), n.alias("line"), F.round(F.col("l_extendedprice") / 7, 2).alias("r2"), F.expr("l_orderkey div 7").alias("q"), (k % 7).alias("m"), C.percent(q, n - 1).alias("pct"),
        F.when(n == 2, "x").otherwise(n.cast("string")).try_cast("int").alias("i"), F.round(q * 0.25 / 1000000 * 1000, 6).alias("cost"),
    )


@query(
    "SELECT l_orderkey AS trip, array_to_string(list_transform(s, lambda x: x * 10), ',') AS tens, array_to_string(list_filter(s, lambda x: x % 2 = 1), ',') AS odd, len(s) AS n, array_to_string(s[1:2], ',') AS two, s[len(s)] AS last_one "
    "FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS s FROM lineitem GROUP BY 1)"
)
def ar01_lists(spark, d):
    s = F.col("s")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("s"))
    return lists.select("trip", text(F.transform(s, lambda x: x * 10)).alias("tens"), text(F.filter(s, lambda x: x % 2 == 1)).alias("odd"), F.size(s).cast("long").alias("n"), text(F.slice(s, 1, 2)).alias("two"), F.element_at(s, -1).alias("last_one"))


@query("SELECT l_orderkey AS trip, i AS position, s[i + 1] AS stop FROM (SELECT l_orderkey, s, unnest(range(len(s))) AS i FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS s FROM lineitem GROUP BY 1))")
def ar05_unwind_range(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("s"))
    return lists.select("trip", F.posexplode("s").alias("position", "stop")).select("trip", F.col("position").cast("long").alias("position"), "stop")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_object('id', event_id, 'kind', event_type) AS VARCHAR) AS properties FROM events")
def ar10_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("properties"))


@query("SELECT p_brand AS brand, array_to_string(list_transform(list_sort(list({'s': p_size, 'id': p_partkey})), lambda x: CAST(x.s AS VARCHAR) || ':' || CAST(x.id AS VARCHAR)), ';') AS maps FROM part GROUP BY 1")
def ar08_list_of_maps(spark, d):
    maps = F.sort_array(F.collect_list(F.struct(F.col("p_size").alias("s"), F.col("p_partkey").alias("id"))))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.transform(maps, lambda x: F.concat_ws(":", x["s"].cast("string"), x["id"].cast("string"))), ";").alias("maps"))
