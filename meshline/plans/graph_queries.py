"""Graph algorithms, paths, writes, retrieval and validation over the bound graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import columns as C
from meshline.operators import algorithms as A
from meshline.operators import expand as X
from meshline.operators import paths as P
from meshline.operators import resolve as R
from meshline.operators import upsert as U
from meshline.operators.validate import Check, run_checks
from meshline.plans.binding import bipartite, graph, query, serves, table
from meshline.session import scratch_path

OFFSET = 1_000_000_000


def projection(spark, d):
    """Suppliers that share a part, both ways (GA-02)."""
    return A.project(A.through(serves(spark, d)))


PAIRS = "pairs AS (SELECT DISTINCT x.src AS a, y.src AS b FROM serves x JOIN serves y ON x.dst = y.dst AND x.src <> y.src)"


# --- projections and algorithms ----------------------------------------------------


@query("SELECT a AS src, b AS dst FROM und", "serves", "und")
def ga01_undirected_projection(spark, d):
    return A.project(bipartite(spark, d))


@query("SELECT DISTINCT x.src AS src, y.src AS dst FROM serves x JOIN serves y ON x.dst = y.dst AND x.src < y.src", "serves")
def ga02_projection_through(spark, d):
    return A.through(serves(spark, d))


@query(
    f"WITH {PAIRS}, walk AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN pairs ON a = node WHERE hops < 6) SELECT node, CAST(min(hops) AS DOUBLE) AS cost FROM walk GROUP BY 1",
    "serves",
)
def ga03_shortest_paths(spark, d):
    start = table(spark, d, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("id"))
    return P.cheapest(start, projection(spark, d)).where("cost <= 6").select("node", "cost")


@query(
    "WITH w AS (SELECT l_suppkey AS a, OFS + l_partkey AS b, min(l_quantity) AS w FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2), e AS (SELECT a, b, 1.0 + a % 3 AS w FROM w UNION ALL SELECT b, a, 1.0 + a % 3 FROM w), "
    "walk AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS cost, 0 AS n UNION SELECT b, cost + w, n + 1 FROM walk JOIN e ON a = node WHERE n < 4) SELECT node, min(cost) AS cost FROM walk GROUP BY 1 HAVING min(cost) <= 4".replace("OFS", str(OFFSET)),
    "serves",
)
def ga03_weighted_paths(spark, d):
    e = bipartite(spark, d).withColumn("w", F.lit(1.0) + F.least("src", "dst") % 3)
    start = table(spark, d, "supplier").where("s_suppkey = 2").select(F.col("s_suppkey").alias("id"))
    return P.cheapest(start, e, "w").where("cost <= 4").select("node", "cost")


def pagerank_sql(rounds: int) -> str:
    parts = ["ids AS (SELECT DISTINCT a AS id FROM und)", "deg AS (SELECT a, count(*) AS n FROM und GROUP BY 1)", "r0 AS (SELECT id, 0.15::DOUBLE AS s FROM ids)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS (SELECT id, 0.15 + 0.85 * coalesce((SELECT sum(s / n) FROM und JOIN deg USING (a) JOIN r{k - 1} p ON p.id = und.a WHERE und.b = ids.id), 0) AS s FROM ids)")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(s, 4) AS score FROM r{rounds}"


@query(pagerank_sql(8), "serves", "und")
def ga04_pagerank(spark, d):
    return A.pagerank(A.project(bipartite(spark, d)), rounds=8).select("id", F.round("score", 4).alias("score"))


def betweenness_sql(depth: int) -> str:
    """Distances and path counts level by level, then all triples s, v, t."""
    parts = [PAIRS, "n AS (SELECT DISTINCT a AS id FROM pairs)", "l0 AS (SELECT id AS s, id AS v, 1.0::DOUBLE AS c FROM n)"]
    seen = "SELECT s, v FROM l0"
    for k in range(1, depth + 1):
        parts.append(f"l{k} AS (SELECT s, b AS v, sum(c) AS c FROM l{k - 1} JOIN pairs ON a = v WHERE (s, b) NOT IN ({seen}) GROUP BY 1, 2)")
        seen += f" UNION ALL SELECT s, v FROM l{k}"
    parts.append("sp AS (" + " UNION ALL ".join(f"SELECT s, v, {k} AS d, c FROM l{k}" for k in range(depth + 1)) + ")")
    parts.append("hit AS (SELECT x.v AS id, sum(x.c * y.c / z.c) AS score FROM sp x JOIN sp y ON y.s = x.v JOIN sp z ON z.s = x.s AND z.v = y.v WHERE x.d + y.d = z.d AND x.d > 0 AND y.d > 0 AND x.s < y.v GROUP BY 1)")
    return "WITH " + ", ".join(parts) + " SELECT n.id, round(coalesce(score, 0), 2) AS score FROM n LEFT JOIN hit ON hit.id = n.id"


@query(betweenness_sql(7), "serves")
def ga05_betweenness(spark, d):
    return A.betweenness(projection(spark, d)).select("id", F.round("score", 2).alias("score"))


@query("SELECT a AS id, count(*) AS degree FROM und GROUP BY 1", "serves", "und")
def ga06_degree(spark, d):
    return A.degree(A.project(bipartite(spark, d)))


@query()
def ga07_louvain(spark, d):
    return A.louvain(projection(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


@query(
    "WITH e AS (SELECT DISTINCT l_suppkey AS a, OFS + l_partkey AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "walk AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, walk.c FROM walk JOIN u ON u.a = walk.id WHERE walk.c < u.b) SELECT id, min(c) AS component FROM (SELECT id, c FROM walk UNION SELECT a, a FROM u) GROUP BY 1".replace("OFS", str(OFFSET)),
    "serves",
)
def ga08_components(spark, d):
    e = serves(spark, d).select("src", (F.col("dst") + OFFSET).alias("dst"))
    return A.components(A.project(e))


@query("WITH d AS (SELECT src, count(*) AS n FROM serves GROUP BY 1) SELECT a, b, round(k * 1.0 / (da.n + db.n - k), 4) AS similarity FROM (SELECT x.src AS a, y.src AS b, count(*) AS k FROM serves x JOIN serves y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) JOIN d da ON da.src = a JOIN d db ON db.src = b", "serves")
def ga09_node_similarity(spark, d):
    return A.jaccard(serves(spark, d)).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {PAIRS} SELECT DISTINCT node FROM (SELECT b AS node FROM pairs WHERE a = 1 UNION SELECT q.b FROM pairs p JOIN pairs q ON p.b = q.a WHERE p.a = 1) WHERE node <> 1", "serves")
def ga10_reachable_in_two(spark, d):
    start = table(spark, d, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("id"))
    return P.levels(start, projection(spark, d), 2).where("hops > 0").select("node")


@query(f"WITH {PAIRS} SELECT id, count(*) AS triangles FROM (SELECT unnest([x.a, x.b, y.b]) AS id FROM pairs x JOIN pairs y ON x.b = y.a JOIN pairs z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b) GROUP BY 1", "serves")
def ga11_triangles(spark, d):
    return A.triangles(projection(spark, d))


@query("WITH walk AS (SELECT 3::BIGINT AS node UNION SELECT b FROM walk JOIN und ON a = node) SELECT node AS id, CASE WHEN node >= 1000000000 THEN 'Station' ELSE 'Route' END AS node_type FROM walk WHERE node >= 1000000000", "serves", "und")
def ga12_reach_all_filtered(spark, d):
    start = table(spark, d, "supplier").where("s_suppkey = 3").select(F.col("s_suppkey").alias("id"))
    kind = F.when(F.col("node") >= OFFSET, "Station").otherwise("Route")
    return P.levels(start, bipartite(spark, d)).select(F.col("node").alias("id"), kind.alias("node_type")).where("node_type = 'Station'")


@query(f"WITH {PAIRS}, deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1), t AS (SELECT id, count(*) AS t FROM (SELECT unnest([x.a, x.b, y.b]) AS id FROM pairs x JOIN pairs y ON x.b = y.a JOIN pairs z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b) GROUP BY 1) SELECT a AS id, CASE WHEN n < 2 THEN 0.0 ELSE round(2.0 * coalesce(t, 0) / (n * (n - 1)), 4) END AS coefficient FROM deg LEFT JOIN t ON id = a", "serves")
def ga13_clustering(spark, d):
    return A.clustering(projection(spark, d)).select("id", F.round("coefficient", 4).alias("coefficient"))


@query(f"WITH {PAIRS}, walk AS (SELECT DISTINCT a AS s, a AS node, 0 AS hops FROM pairs UNION SELECT s, b, hops + 1 FROM walk JOIN pairs ON a = node WHERE hops < 8), best AS (SELECT s, node, min(hops) AS hops FROM walk GROUP BY 1, 2) SELECT s AS id, round(count(*) * 1.0 / sum(hops), 4) AS score FROM best WHERE hops > 0 GROUP BY 1", "serves")
def ga13_closeness(spark, d):
    p = projection(spark, d)
    return A.closeness(p, A.nodes_of(p)).select("id", F.round("score", 4).alias("score"))


def label_propagation_sql(rounds: int) -> str:
    parts = [PAIRS, "r0 AS (SELECT DISTINCT a AS id, a AS c FROM pairs)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS (SELECT id, c FROM (SELECT a AS id, c, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, c) AS r FROM pairs JOIN r{k - 1} ON r{k - 1}.id = b GROUP BY a, c) WHERE r = 1)")
    return "WITH " + ", ".join(parts) + f" SELECT c AS community, count(*) AS n FROM r{rounds} GROUP BY 1"


@query(label_propagation_sql(10), "serves")
def ga13_label_propagation(spark, d):
    return A.label_propagation(projection(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT a, b FROM c WHERE a <> b AND n > 1.5 * (SELECT avg(n) FROM c)), r AS (SELECT a AS x, b AS y FROM e UNION SELECT x, b FROM r JOIN e ON a = y), n AS (SELECT a AS id FROM e UNION SELECT b FROM e) SELECT id, greatest(id, coalesce((SELECT max(p.y) FROM r p JOIN r q ON q.x = p.y AND q.y = p.x WHERE p.x = id), id)) AS component FROM n", "serves")
def ga13_strong_components(spark, d):
    """Zones linked by more trips than one and a half times the mean."""
    o, c, l, s = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    n = l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    e = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).where("src <> dst and n > 1.5 * mean").select("src", "dst")
    return A.strong_components(e)


def eigenvector_sql(rounds: int) -> str:
    parts = [PAIRS, "r0 AS (SELECT DISTINCT a AS id, 1.0::DOUBLE AS s FROM pairs)"]
    for k in range(1, rounds + 1):
        parts.append(f"w{k} AS (SELECT b AS id, sum(s) AS s FROM pairs JOIN r{k - 1} p ON p.id = a GROUP BY 1)")
        parts.append(f"r{k} AS (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM w{k}) AS s FROM w{k})")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(s, 4) AS score FROM r{rounds}"


@query(eigenvector_sql(10), "serves")
def ga13_eigenvector(spark, d):
    return A.eigenvector(projection(spark, d), 10).select("id", F.round("score", 4).alias("score"))


def article_rank_sql(rounds: int) -> str:
    parts = ["ids AS (SELECT DISTINCT a AS id FROM und)", "deg AS (SELECT a, count(*) AS n FROM und GROUP BY 1)", "m AS (SELECT avg(n) AS mean FROM deg)", "r0 AS (SELECT id, 0.15::DOUBLE AS s FROM ids)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS (SELECT id, 0.15 + 0.85 * coalesce((SELECT sum(s / (n + mean)) FROM und JOIN deg USING (a) JOIN r{k - 1} p ON p.id = und.a, m WHERE und.b = ids.id), 0) AS s FROM ids)")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(s, 4) AS score FROM r{rounds}"


@query(article_rank_sql(5), "serves", "und")
def ga13_article_rank(spark, d):
    return A.article_rank(A.project(bipartite(spark, d)), 5).select("id", F.round("score", 4).alias("score"))


@query("WITH d AS (SELECT src, count(*) AS n FROM serves GROUP BY 1), s AS (SELECT a, b, k * 1.0 / (da.n + db.n - k) AS v FROM (SELECT x.src AS a, y.src AS b, count(*) AS k FROM serves x JOIN serves y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2) JOIN d da ON da.src = a JOIN d db ON db.src = b) SELECT a, b, round(v, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS r FROM s) WHERE r <= 3", "serves")
def ga13_knn(spark, d):
    return A.knn(serves(spark, d), 3).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query()
def ga13_depth_first(spark, d):
    return A.depth_first(projection(spark, d), 1)


@query("WITH e AS (SELECT a, b, 1.0 + least(a, b) % 3 AS w FROM und), walk AS (SELECT 2::BIGINT AS node, 0.0::DOUBLE AS cost, 0 AS n UNION SELECT b, cost + w, n + 1 FROM walk JOIN e ON a = node WHERE n < 14) SELECT node, min(cost) AS cost FROM walk WHERE node = 7 GROUP BY 1", "serves", "und")
def ga13_a_star(spark, d):
    e = bipartite(spark, d).withColumn("w", F.lit(1.0) + F.least("src", "dst") % 3)
    start = table(spark, d, "supplier").where("s_suppkey = 2").select(F.col("s_suppkey").alias("id"))
    return P.a_star(start, 7, e, "w", F.when(F.col("node") == 7, 0.0).otherwise(1.0)).select("node", "cost")


@query(
    "WITH e AS (SELECT row_number() OVER (ORDER BY l_suppkey, l_partkey) AS eid, l_suppkey AS a, OFS + l_partkey AS b FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)), u AS (SELECT eid, a, b FROM e UNION ALL SELECT eid, b, a FROM e) "
    "SELECT DISTINCT start, node FROM (SELECT x.a AS start, x.b AS node FROM u x WHERE x.a < OFS UNION ALL SELECT x.a, y.b FROM u x JOIN u y ON x.b = y.a AND x.eid <> y.eid WHERE x.a < OFS UNION ALL SELECT x.a, z.b FROM u x JOIN u y ON x.b = y.a AND x.eid <> y.eid JOIN u z ON y.b = z.a AND z.eid <> y.eid AND z.eid <> x.eid WHERE x.a < OFS)".replace("OFS", str(OFFSET)),
    "serves",
)
def jn10_trails_1_to_3(spark, d):
    e = serves(spark, d).select(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("eid"), "src", (F.col("dst") + OFFSET).alias("dst"))
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return P.trail_ends(starts, e, 1, 3)


@query("SELECT node, hops FROM (SELECT n_nationkey + 100 AS node, 1 AS hops FROM nation WHERE n_regionkey = 1 UNION ALL SELECT s_suppkey + 1000, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 1, 0)")
def ar09_path_levels(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("src"), (F.col("s_suppkey") + 1000).alias("dst"))
    start = table(spark, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("id"))
    return P.levels(start, n.unionAll(s)).select("node", "hops")


# --- writes ---------------------------------------------------------------------------


@query("WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS v FROM supplier), b AS (SELECT c_custkey AS id, c_acctbal AS v, row_number() OVER (PARTITION BY c_custkey % 150 ORDER BY c_custkey DESC) AS r FROM customer) SELECT coalesce(s.id, k) AS id, name, coalesce(nv, v) AS v FROM s FULL JOIN (SELECT id % 150 AS k, v AS nv FROM b WHERE r = 1) ON s.id = k")
def snk02_upsert(spark, d):
    state = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    batch = table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("id"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("seen"))
    return U.upsert_nodes(state, batch, ["id"], "seen").select("id", "name", "v")


@query("WITH p1 AS (SELECT user_id AS k, min(ts) AS t FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-03' GROUP BY 1), p2 AS (SELECT user_id AS k, max(ts) AS t FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' GROUP BY 1) SELECT coalesce(p1.k, p2.k) AS k, strftime(coalesce(p1.t, p2.t), '%Y%m%d') AS first_seen, strftime(coalesce(p2.t, p1.t), '%Y%m%d') AS last_seen FROM p1 FULL JOIN p2 USING (k)")
def snk03_create_or_match(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    first = e.where("ts < timestamp'2024-01-03'").groupBy(F.col("user_id").alias("k")).agg(day(F.min("ts")).alias("first_seen")).withColumn("last_seen", F.col("first_seen"))
    second = e.where("ts >= timestamp'2024-01-03' and ts < timestamp'2024-01-05'").groupBy(F.col("user_id").alias("k")).agg(day(F.max("ts")).alias("first_seen")).withColumn("last_seen", F.col("first_seen"))
    return U.merge_create_match(first, second, "k", ["last_seen"])


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_linenumber AS stop FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def snk04_merge_edges(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("stop"))
    g = graph(spark, d)
    return U.merge_edges(rows, g.node("Trip").where("status = 'F'"), g.node("Station").where("size <= 5"), ("src", "dst", "stop")).select("src", "dst", "stop")


@query("SELECT src, dst, stop FROM (SELECT l_suppkey AS src, l_partkey % 20 AS dst, l_linenumber AS stop, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def snk05_merge_then_set(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.col("l_linenumber").alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return U.merge_edges_set(rows, ["src", "dst"], "seen").select("src", "dst", "stop")


@query("SELECT p_partkey AS id, 'Station' || CASE WHEN p_size > 40 THEN ',Large' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN ',Costly' ELSE '' END AS labels FROM part")
def snk06_label_migration(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return U.add_labels(p, [("Large", F.col("p_size") > 40), ("Costly", F.col("p_retailprice") > 1000)], "Station").select("id", F.array_join("labels", ",").alias("labels"))


@query("SELECT DISTINCT s_suppkey AS src, n_regionkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def snk07_derived_edges(spark, d):
    g = graph(spark, d)
    return U.derive_two_hop(g.edge("IN_ZONE"), g.edge("PART_OF"))


@query("SELECT kind AS target_label, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Route' ELSE 'Station' END AS kind FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderkey % 200 IN (SELECT s_suppkey FROM supplier)) OR (o_orderkey % 3 <> 0 AND o_orderkey % 2500 IN (SELECT p_partkey FROM part))) GROUP BY 1")
def snk08_prefix_dispatch(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 3 == 0, F.concat(F.lit("R_"), (k % 200).cast("string"))).otherwise(F.concat(F.lit("S_"), (k % 2500).cast("string"))).alias("ref"))
    key = lambda df, c, p: df.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"))
    out = U.dispatch(rows, "ref", {"Route": key(table(spark, d, "supplier"), "s_suppkey", "R_"), "Station": key(table(spark, d, "part"), "p_partkey", "S_")}, {"R_": "Route"}, "Station")
    return out.groupBy("target_label").agg(F.count("*").alias("n"))


@query("SELECT e.user_id AS id, CASE WHEN e.user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 0 ELSE 1 END AS \"table\", count(*) AS n FROM events e WHERE e.user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) OR e.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2")
def snk09_coalesced_label(spark, d):
    a = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    b = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return U.coalesced_edges(table(spark, d, "events"), "user_id", [a, b]).groupBy(F.col("user_id").alias("id"), "table").agg(F.count("*").alias("n"))


@query("SELECT 'kept' AS what, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT 'edges', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_custkey IS NOT NULL")
def snk10_purge_orphans(spark, d):
    o = table(spark, d, "orders")
    nodes, required = o.select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("src"))
    kept, (edges,) = U.purge_orphans(nodes, required, [o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))])
    return kept.agg(F.lit("kept").alias("what"), F.count("*").alias("n")).unionAll(edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@query("WITH s AS (SELECT user_id, max(ts) AS seen, epoch_ms(min(ts)) AS since FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1) SELECT user_id, CASE WHEN seen < TIMESTAMP '2024-01-09' THEN 'resolved' ELSE 'active' END AS status, CASE WHEN seen < TIMESTAMP '2024-01-09' THEN CAST(floor((epoch_ms(TIMESTAMP '2024-01-09') - since) / 86400000.0) AS BIGINT) END AS days FROM s")
def snk11_stale_resolution(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' and ts < timestamp'2024-01-10'")
    ts = F.col("ts").cast("timestamp")
    state = e.groupBy("user_id").agg(F.max(ts).alias("last_seen_poll"), F.unix_millis(F.min(ts)).alias("date_out_of_service")).withColumns({"status": F.lit("active"), "actual_duration_days": F.lit(None).cast("long"), "resolved_at": F.lit(None).cast("timestamp")})
    out = U.resolve_stale(state, F.to_timestamp(F.lit("2024-01-09 00:00:00")))
    return out.select("user_id", "status", F.col("actual_duration_days").alias("days"))


@query("SELECT 'not null: l_orderkey' AS \"constraint\", 0::BIGINT AS broken UNION ALL SELECT 'unique: l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def snk12_constraints(spark, d):
    return U.violations(table(spark, d, "lineitem"), unique=[["l_orderkey", "l_linenumber"]], required=["l_orderkey"])


# --- retrieval -----------------------------------------------------------------------


@query("WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, count(DISTINCT id) AS nodes FROM w GROUP BY 1")
def src16_token_index(spark, d):
    return R.token_index(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "p_name").groupBy("token").agg(F.countDistinct("id").alias("nodes"))


@query(
    "WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part), k AS (SELECT id, token, count(*) AS k FROM w GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1), f AS (SELECT token, count(DISTINCT id) AS df FROM w GROUP BY 1), total AS (SELECT count(DISTINCT id) AS s FROM w), "
    "q AS (SELECT * FROM (VALUES ('red ri', 'red'), ('red ri', 'ri'), ('widget', 'widget')) v(mention, word)), dg AS (SELECT dst AS id, count(*) AS degree FROM serves GROUP BY 1), "
    "h AS (SELECT mention, word, k.id, max((k.k * 1.0 / n.n) * ln(1 + total.s * 1.0 / f.df) * CASE WHEN k.token = word THEN 1.0 ELSE 0.5 END) AS s FROM q JOIN k ON starts_with(k.token, word) JOIN n ON n.id = k.id JOIN f ON f.token = k.token, total GROUP BY 1, 2, 3), t AS (SELECT mention, id, sum(s) AS score FROM h GROUP BY 1, 2) "
    "SELECT mention, id, score, degree FROM (SELECT mention, t.id, round(score, 4) AS score, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY mention ORDER BY round(score, 9) DESC, coalesce(degree, 0) DESC, t.id) AS r FROM t LEFT JOIN dg ON dg.id = t.id) WHERE r <= 5",
    "serves",
)
def rt01_full_text(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    degrees = serves(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    mentions = spark.createDataFrame([("red ri",), ("widget",)], "mention string")
    return R.search(R.token_index(nodes, "p_name"), mentions, degrees, 5).select("mention", "id", F.round("score", 4).alias("score"), "degree")


@query("SELECT id, CAST(CASE WHEN lower(code) = 'brand#7' THEN 2 ELSE 1 END AS INTEGER) AS score, code AS display FROM (SELECT p_partkey AS id, p_brand AS code, p_name || ' ' || p_brand AS name FROM part) WHERE lower(code) = 'brand#7' OR contains(lower(name), 'brand#7') ORDER BY score DESC, id LIMIT 5")
def rt02_code_or_name(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return R.search_codes(p, "Brand#7", "code", "name").select("id", "score", "display")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS date FROM orders WHERE strftime(o_orderdate, '%Y%m%d') IN ('19980101', '19980105')")
def rt03_date_resolve(spark, d):
    import datetime as dt

    today = dt.date(1998, 1, 12)
    wanted = [C.resolve_date(t, today) for t in ("19980101", "last monday")]
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("date")).where(F.col("date").isin(*wanted)).distinct()


@query("SELECT p_brand AS mention, p_partkey AS id, p_size AS score FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1")
def rt06_top_with_ties(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("mention"), F.col("p_partkey").alias("id"), F.col("p_size").alias("score"))
    return R.select_top(c, "mention", "score", 1)


@query(
    "WITH c AS (SELECT 'route' AS mention, s_suppkey AS id, s_acctbal AS score FROM supplier UNION ALL SELECT 'station', 1000000000 + p_partkey, p_size FROM part WHERE p_size = 7), e AS (SELECT src, 1000000000 + dst AS dst FROM serves WHERE dst IN (SELECT p_partkey FROM part WHERE p_size = 7)), "
    "w AS (SELECT id, sum(1.0) AS coherence FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), s AS (SELECT mention, c.id, score, coalesce(coherence, 0) AS coherence FROM c LEFT JOIN w USING (id)) SELECT mention, id, CAST(coherence AS DOUBLE) AS coherence FROM (SELECT *, rank() OVER (PARTITION BY mention ORDER BY coherence DESC, score DESC) AS r FROM s) WHERE r = 1",
    "serves",
)
def rt07_coherence(spark, d):
    routes = table(spark, d, "supplier").select(F.lit("route").alias("mention"), F.lit("route").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    few = table(spark, d, "part").where("p_size = 7")
    stations = few.select(F.lit("station").alias("mention"), F.lit("station").alias("type"), (F.col("p_partkey") + OFFSET).alias("id"), F.col("p_size").cast("double").alias("score"))
    e = serves(spark, d).select("src", (F.col("dst") + OFFSET).alias("dst"), F.lit("SERVES").alias("type"))
    return R.coherence(routes.unionAll(stations), e).select("mention", "id", "coherence")


@query("SELECT DISTINCT l_orderkey AS id, 'node' AS tier FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) LIKE '12%' AND l_linenumber = 7 ORDER BY 1 LIMIT 10")
def rt04_pathway_by_prefix(spark, d):
    p = table(spark, d, "lineitem").select(F.concat(F.lit("NODE_"), F.col("l_orderkey").cast("string")).alias("id"), F.when(F.col("l_linenumber") == 7, "Elevator").otherwise("Pathway").alias("label"), F.lit("").alias("station_code"))
    found = R.search_pathways(p, "NODE_12", "Elevator", 10, order=F.substring("id", 6, 20).cast("long"))
    return found.select(F.substring("id", 6, 20).cast("long").alias("id"), "tier")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'tion_1') ORDER BY 1 LIMIT 5")
def rt05_level_search(spark, d):
    return R.search_contains(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "TION_1", 5)


@query("SELECT DISTINCT p_name AS name, CAST(levenshtein(p_name, 'smal rign') AS INTEGER) AS distance FROM part ORDER BY distance, name LIMIT 5")
def rt08_nearest_names(spark, d):
    return R.nearest_names(table(spark, d, "part").select(F.col("p_name").alias("name")), "smal rign")


@query("WITH h1 AS (SELECT DISTINCT b AS id FROM und WHERE a = 4), h2 AS (SELECT DISTINCT b AS id FROM und WHERE a IN (FROM h1) AND b <> 4) SELECT id, min(hop) AS hop FROM (SELECT 4::BIGINT AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1", "serves", "und")
def rt09_expand(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Route").alias("label"))
    s = table(spark, d, "part").select((F.col("p_partkey") + OFFSET).alias("id"), F.lit("Station").alias("label"))
    e = serves(spark, d).select("src", (F.col("dst") + OFFSET).alias("dst"), F.lit("SERVES").alias("type"))
    anchors = X.seeds(r.withColumn("short_name", F.col("id").cast("string")), [("Route", "short_name|id", "4")])
    return X.expand(r.unionAll(s), e, anchors, X.Expansion(hops=2, rows_per_hop=100000, kinds=("SERVES",), labels=("Route", "Station"))).nodes.select("id", "hop")


@query("SELECT s_suppkey AS src, n_regionkey AS dst, 'PART_OF' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def rt12_provenance(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    e = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"))
    return X.provenance(X.Subgraph(nodes, None), e, ("PART_OF",))


@query("SELECT id, label, hop FROM (SELECT *, sum(ceil(length(name) / 4.0)) OVER (ORDER BY CASE WHEN hop = 0 THEN 9 WHEN label = 'Trip' THEN 1 ELSE 4 END DESC, hop, id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT s_suppkey AS id, 'Route' AS label, CASE WHEN s_suppkey < 3 THEN 0 ELSE 1 END AS hop, s_name AS name FROM supplier UNION ALL SELECT 1000000 + o_orderkey, 'Trip', 2, 'trip ' || CAST(o_orderkey AS VARCHAR) FROM orders)) WHERE used <= 970 OR label <> 'Trip'")
def rt13_budget(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Route").alias("label"), F.when(F.col("s_suppkey") < 3, 0).otherwise(1).alias("hop"), F.col("s_name").alias("name"))
    t = table(spark, d, "orders").select((F.col("o_orderkey") + 1000000).alias("id"), F.lit("Trip").alias("label"), F.lit(2).alias("hop"), F.concat(F.lit("trip "), F.col("o_orderkey").cast("string")).alias("name"))
    return X.within_budget(r.unionAll(t), "name", 1000, 30).select("id", "label", "hop")


# --- validators, streaming shapes, polls ------------------------------------------------


@query(
    "SELECT 'orders: key' AS \"check\", count(*) AS broken, 'error' AS level FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL SELECT 'orders: total', count(*), 'error' FROM orders WHERE o_totalprice <= 0 UNION ALL SELECT 'orders: rows', 0, 'error' "
    "UNION ALL SELECT 'lineitem: order', count(*), 'error' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders: has lines', count(*), 'warning' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
)
def val01_checks(spark, d):
    tables = {"orders": table(spark, d, "orders"), "lineitem": table(spark, d, "lineitem")}
    _, found = run_checks(
        tables,
        [
            Check("orders: key", "orders", unique=("o_orderkey",)),
            Check("orders: total", "orders", F.col("o_totalprice") <= 0),
            Check("orders: rows", "orders", non_empty=True),
            Check("lineitem: order", "lineitem", refers=("l_orderkey", "orders", "o_orderkey")),
            Check("orders: has lines", "orders", refers=("o_orderkey", "lineitem", "l_orderkey"), level="warning"),
        ],
    )
    return found.select("check", "broken", "level")


@query("SELECT hash, count(*) AS n FROM (SELECT substr(sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || strftime(ts, '%Y%m%d')), 1, 16) AS hash FROM events) GROUP BY 1")
def stm01_content_hash(spark, d):
    return table(spark, d, "events").groupBy(C.content_hash(F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyyMMdd")).alias("hash")).agg(F.count("*").alias("n"))


def event_stream(spark, d):
    """The events as a file stream, whether the table is a file or a folder."""
    raw = table(spark, d, "events")
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(one).isDirectory():
        stream = spark.readStream.schema(raw.schema).parquet(f"{d}/events.parquet")
    else:
        stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stm02_tumbling_window(spark, d):
    from meshline.streaming.poll import run_complete, windowed

    path = scratch_path(spark, "stream-out")
    run_complete(windowed(event_stream(spark, d), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")]), path, scratch_path(spark, "stream-checkpoint"))
    out = spark.read.parquet(path)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stm03_sessions(spark, d):
    from meshline.streaming.poll import run_complete, sessions

    path = scratch_path(spark, "stream-out")
    run_complete(sessions(event_stream(spark, d), "ts", "12 hours", ["user_id"], [F.count("*").alias("n")]), path, scratch_path(spark, "stream-checkpoint"))
    out = spark.read.parquet(path)
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT count(DISTINCT user_id || ' ' || event_type) AS n FROM events")
def stm04_streamed_dedup(spark, d):
    """A file stream of events, each (user, type) once, kept in a state table."""
    from meshline.streaming.poll import new_content, run_until_empty

    path = scratch_path(spark, "stream-out")
    keyed = event_stream(spark, d).select("ts", F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("k"))
    once = new_content(keyed, "k", "ts", "400 days")  # state is kept for that long
    run_until_empty(once.writeStream.format("parquet").option("path", path), scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(path).agg(F.count("*").alias("n"))
