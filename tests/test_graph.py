import random
from collections import defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from meshline.operators import algorithms as A
from meshline.operators import graph as G
from meshline.operators import paths as P
from meshline.operators.graph import Match, PropertyGraph


@pytest.fixture(scope="module")
def net():
    rng = random.Random(5)
    return sorted({tuple(sorted(rng.sample(range(16), 2))) for _ in range(26)} | {(20, 21), (21, 22), (20, 22)})


@pytest.fixture(scope="module")
def both(spark, net):
    return A.project(spark.createDataFrame(net, "src long, dst long")).persist()


def neighbours(net):
    out = defaultdict(set)
    for a, b in net:
        out[a].add(b)
        out[b].add(a)
    return out


def distances(net, start):
    near, seen, queue = neighbours(net), {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def test_levels_and_paths(spark, net, both):
    start = spark.createDataFrame([(net[0][0],)], "id long")
    want = distances(net, net[0][0])
    assert {r["node"]: r["hops"] for r in P.levels(start, both).collect()} == want
    got = P.cheapest(start, both).collect()
    assert {r["node"]: r["cost"] for r in got} == want
    near = neighbours(net)
    for r in got:
        assert len(r["path"]) == r["cost"] + 1 and all(b in near[a] for a, b in zip(r["path"], r["path"][1:]))


def test_trails(spark, net, both):
    e = spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(net)], "eid string, src long, dst long")
    near = defaultdict(list)
    for i, (a, b) in enumerate(net):
        near[a].append((i, b))
        near[b].append((i, a))
    want = set()

    def walk(v, used):
        if used:
            want.add(v)
        if len(used) < 3:
            for i, w in near[v]:
                if i not in used:
                    walk(w, used | {i})

    walk(0, frozenset())
    got = P.trail_ends(spark.createDataFrame([(0,)], "id long"), e, 1, 3).collect()
    assert {r["node"] for r in got} == want


def test_components_triangles_clustering(net, both):
    near = neighbours(net)
    comp = {v: min(distances(net, v)) for v in near}
    assert {r["id"]: r["component"] for r in A.components(both).collect()} == comp
    t = defaultdict(int)
    for a, b, c in combinations(sorted(near), 3):
        if b in near[a] and c in near[a] and c in near[b]:
            for v in (a, b, c):
                t[v] += 1
    assert {r["id"]: r["triangles"] for r in A.triangles(both).collect()} == dict(t)
    for r in A.clustering(both).collect():
        n = len(near[r["id"]])
        assert r["coefficient"] == pytest.approx(2 * t[r["id"]] / (n * (n - 1)) if n > 1 else 0)


def test_long_chain_settles(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in A.components(A.project(chain)).collect()} == {0}


def test_pagerank_betweenness_closeness(net, both):
    near = neighbours(net)
    rank = dict.fromkeys(near, 0.15)
    for _ in range(20):
        rank = {v: 0.15 + 0.85 * sum(rank[w] / len(near[w]) for w in near[v]) for v in near}
    for r in A.pagerank(both).collect():
        assert r["score"] == pytest.approx(rank[r["id"]])
    # betweenness by counting all shortest paths
    d = {v: distances(net, v) for v in near}

    def count(s, t):
        if s == t:
            return 1
        return sum(count(s, w) for w in near[t] if d[s].get(w, 99) == d[s][t] - 1)

    want = dict.fromkeys(near, 0.0)
    for s, t in combinations(sorted(near), 2):
        if t in d[s]:
            for v in near:
                if v not in (s, t) and d[s].get(v, 99) + d[v].get(t, 99) == d[s][t]:
                    want[v] += count(s, v) * count(v, t) / count(s, t)
    for r in A.betweenness(both).collect():
        assert r["score"] == pytest.approx(want[r["id"]])
    for r in A.closeness(both).collect():
        far = [x for x in d[r["id"]].values() if x]
        assert r["score"] == pytest.approx(len(far) / sum(far))


def test_strong_components(spark):
    rng = random.Random(3)
    edges = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(24)) if a != b})
    reach = {v: {v} for e in edges for v in e}
    for _ in reach:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {v: max(w for w in reach[v] if v in reach[w]) for v in reach}
    got = {r["id"]: r["component"] for r in A.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_louvain_finds_clear_groups(spark):
    groups = [range(0, 6), range(10, 16), range(20, 26)]
    edges = [(a, b) for g in groups for a, b in combinations(g, 2)] + [(5, 10), (15, 20)]
    found = A.louvain(A.project(spark.createDataFrame(edges, "src long, dst long"))).collect()
    assert {r["id"]: r["community"] for r in found} == {v: g[0] for g in groups for v in g}


def test_similarity_and_depth_first(spark, both, net):
    near = neighbours(net)
    got = {(r["a"], r["b"]): r["similarity"] for r in A.jaccard(both).collect()}
    assert got == pytest.approx({(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in combinations(sorted(near), 2) if near[a] & near[b]})
    order = [r["id"] for r in A.depth_first(both, 20).orderBy("position").collect()]
    assert order == [20, 21, 22]


def test_match_optional_and_exists(spark):
    g = PropertyGraph(
        {"S": spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "E": spark.createDataFrame([("x", ["E", "Lift"]), ("y", ["E"])], "id string, labels array<string>"), "O": spark.createDataFrame([("o1", "active")], "id string, status string")},
        {"HAS": (spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "src string, dst string"), "S", "E"), "OUT": (spark.createDataFrame([("o1", "x")], "src string, dst string"), "O", "E")},
    )
    m = Match(g).start("s", "S").optional(lambda q: q.out("HAS", "e", "E:Lift").inn("OUT", "o", "O"))
    assert sorted((r["s__id"], r["o__id"]) for r in m.df.collect()) == [("a", "o1"), ("b", None), ("c", None)]
    assert [r["s__id"] for r in Match(g).start("s", "S").exists("HAS", negated=True).df.collect()] == ["c"]
    with pytest.raises(KeyError):
        g.edge("NONE")


def test_keep_first_latest_rank(spark, rows):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, None)], "k int, at int, v string")
    assert rows(G.keep_first(df, ["k"], [F.col("at")])) == [(1, 3, "a"), (2, 9, None)]
    assert rows(G.keep_last(df, ["k"], [F.col("at")])) == [(1, 5, "b"), (2, 9, None)]
    assert rows(G.latest(df, "at")) == [(2, 9, None)]
    ranked = G.rank_among(df, "at", "k").select("at", "position", "total")
    assert rows(ranked) == [(3, 3, 3), (5, 2, 3), (9, 1, 3)]


def test_near_equals_cross_join(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-89.9, 89.9), rng.choice([rng.uniform(-180, 180), 179.99, -179.99])) for i in range(150)]
    points += [(200 + i, rng.uniform(60.0, 60.05), rng.uniform(10, 10.1)) for i in range(60)] + [(300 + i, 89.99, rng.uniform(-180, 180)) for i in range(20)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    from meshline.functions.columns import metres

    every = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("m"))
    want = {(r["a"], r["b"]) for r in every.where("m <= 1500").collect()}
    got = [(r["a"], r["b"]) for r in G.near(df, df, 1500.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_compares_places_once_and_broadcasts_none(spark, tmp_path):
    rng = random.Random(2)
    places = [(rng.uniform(50, 50.02), rng.uniform(9, 9.02)) for _ in range(25)]
    points = [(i, *places[i % 25]) for i in range(500)] + [(900, None, 9.0), (901, 50.0, None)]
    spark.createDataFrame(points, "id long, lat double, lon double").write.parquet(f"{tmp_path}/points")
    df = spark.read.parquet(f"{tmp_path}/points")
    from meshline.functions.columns import metres

    every = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("m"))
    want = {(r["a"], r["b"]) for r in every.where("m <= 400").collect()}
    near = G.near(df, df, 400.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = [(r["a"], r["b"]) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 10_000 < len(want) < 250_000


@pytest.mark.parametrize("block_rows", [50_000_000, 60])
def test_betweenness_by_joins(both, block_rows):
    want = {r["id"]: r["score"] for r in A.betweenness(both).collect()}
    got = {r["id"]: r["score"] for r in A.betweenness_by_joins(both, block_rows=block_rows).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_betweenness_beyond_the_adjacency(both, monkeypatch):
    want = {r["id"]: r["score"] for r in A.betweenness(both).collect()}
    monkeypatch.setattr(A, "BROADCAST_EDGES", 5)
    assert {r["id"]: pytest.approx(r["score"]) for r in A.betweenness(both).collect()} == want


def test_hubs_are_dealt_out(spark, both, monkeypatch):
    pairs = lambda: sorted(map(tuple, A.jaccard(both, 0.2).collect()))
    want, linked = pairs(), sorted(map(tuple, A.through(both).collect()))
    monkeypatch.setattr(G, "HUB", 2)
    assert pairs() == want and sorted(map(tuple, A.through(both).collect())) == linked
    assert A.jaccard(both, 0.2).count() == A.jaccard(both).where("similarity > 0.2").count() > 0
