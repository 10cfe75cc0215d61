"""Graph algorithms over edge DataFrames (src, dst).

A projection is a set of directed pairs; an undirected one holds each pair both
ways. Iterations aggregate before they shuffle and are written to the shared
folder every round. Algorithms whose state is a whole graph for each source
(betweenness) run one source a task group over a broadcast adjacency whose size
is checked, and beyond it level by level as joins, for blocks of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.operators.graph import paired
from meshline.operators.paths import levels, undirected
from meshline.session import cut, discard

#: Edges of an adjacency that is sent to every executor: 16 bytes each.
BROADCAST_EDGES = 2_000_000


def project(edges: DataFrame, orientation: str = "UNDIRECTED") -> DataFrame:
    """Distinct (src, dst) without loops (GA-01); NATURAL, REVERSE or UNDIRECTED."""
    e = edges.select("src", "dst").where("src <> dst")
    if orientation == "REVERSE":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif orientation == "UNDIRECTED":
        e = undirected(e)
    return e.distinct()


def through(edges: DataFrame) -> DataFrame:
    """Pairs src < dst of sources that share a destination (GA-02)."""
    met = paired(edges.select(F.col("src").alias("n"), F.col("dst").alias("via")).distinct())
    return met.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def degree(projection: DataFrame) -> DataFrame:
    """(id, degree) of nodes with edges (GA-06)."""
    return projection.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def pagerank(projection: DataFrame, rounds: int = 20, damping: float = 0.85, vertices: DataFrame | None = None) -> DataFrame:
    """(id, score), not normalised: (1 - d) + d * sum(score / outdegree) (GA-04)."""
    ids = cut(vertices.select("id").distinct() if vertices is not None else nodes_of(projection), "nodes")
    out = cut(projection.join(degree(projection).select(F.col("id").alias("src"), "degree"), "src"), "weighted")
    rank, held = ids.withColumn("score", F.lit(1.0 - damping)), None
    for k in range(rounds):
        given = out.join(rank, out.src == rank.id).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("given"))
        rank = ids.join(given, ids.id == given.dst, "left").select("id", (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("score"))
        if k % 5 == 4:
            rank = cut(rank, "rank")
            discard(held)
            held = rank
    return rank


def article_rank(projection: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """PageRank in which a source gives score / (outdegree + mean outdegree) (GA-13)."""
    ids = cut(nodes_of(projection), "nodes")
    d = degree(projection)
    mean = float(projection.count()) / max(1, ids.count())
    out = cut(projection.join(d.select(F.col("id").alias("src"), "degree"), "src"), "weighted")
    rank, held = ids.withColumn("score", F.lit(1.0 - damping)), None
    for k in range(rounds):
        given = out.join(rank, out.src == rank.id).groupBy("dst").agg(F.sum(F.col("score") / (F.col("degree") + mean)).alias("given"))
        rank = ids.join(given, ids.id == given.dst, "left").select("id", (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("score"))
        if k % 5 == 4:
            rank = cut(rank, "rank")
            discard(held)
            held = rank
    return rank


def eigenvector(projection: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, score) by power iteration, the vector scaled to length 1 each round (GA-13)."""
    ids = cut(nodes_of(projection), "nodes")
    e = cut(projection, "edges")
    rank = ids.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        got = e.join(rank, e.src == rank.id).groupBy("dst").agg(F.sum("score").alias("got"))
        raw = cut(ids.join(got, ids.id == got.dst, "left").select("id", F.coalesce("got", F.lit(0.0)).alias("raw")), "eigen")
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0] or 1.0
        rank = raw.select("id", (F.col("raw") / norm).alias("score"))
    return rank


def components(projection: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node reaches, either way (GA-08).

    Large-star and small-star rounds: labels travel a doubling distance, so a
    long chain takes few rounds."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        met = both.join(least, both.a == least.k)
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    now = cut(projection.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        before, now = now, cut(star(star(now, True), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        discard(before)
        signature = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if signature == seen or not signature[0]:
            break
        seen = signature
    else:
        raise RuntimeError("components did not settle")
    ids = vertices.select("id").distinct() if vertices is not None else nodes_of(projection)
    return ids.join(now, ids.id == now.a, "left").select("id", F.coalesce("b", "id").alias("component"))


def jaccard(projection: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, similarity) of a < b that share neighbours (GA-09). Pairs whose
    degrees alone keep them from `least` go before they are counted."""
    e = projection.select(F.col("src").alias("n"), F.col("dst").alias("via")).join(degree(projection).select(F.col("id").alias("n"), F.col("degree").alias("d")), "n")
    met = paired(e, "d")
    if least > 0:
        met = met.where(F.least("a_d", "b_d") > F.lit(least) * F.greatest("a_d", "b_d"))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("a_d").alias("da"), F.first("b_d").alias("db"))
    return counted.select("a", "b", (F.col("shared") / (F.col("da") + F.col("db") - F.col("shared"))).alias("similarity")).where(F.col("similarity") > least)


def knn(projection: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar nodes of each node by jaccard() (GA-13)."""
    from meshline.operators.graph import top_per_group

    pairs = jaccard(projection)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return top_per_group(both, ["a"], [F.desc("similarity"), F.asc("b")], k)


def triangles(projection: DataFrame) -> DataFrame:
    """(id, triangles) of nodes in one or more (GA-11). Each edge leads from the
    end of smaller degree to the other, so hubs open few pairs."""
    d = degree(projection)
    e = projection.where("src < dst").join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    ranked = cut(e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi")), "ranked")
    open_ = ranked.select("lo", F.col("hi").alias("x")).join(ranked.select("lo", F.col("hi").alias("y")), "lo").where("x < y")
    closing = ranked.select(F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    found = open_.join(closing, ["x", "y"])
    return found.select(F.explode(F.array("lo", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(projection: DataFrame) -> DataFrame:
    """(id, coefficient): 2 triangles / (degree (degree - 1)); 0 below degree 2 (GA-13)."""
    d, t = degree(projection), triangles(projection)
    both = d.join(t, "id", "left")
    return both.select("id", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("coefficient"))


def adjacency(projection: DataFrame):
    """A broadcast {node: sorted neighbours}; an error names the way beyond the bound."""
    n = projection.count()
    if n > BROADCAST_EDGES:
        raise ValueError(f"{n} edges exceed the adjacency bound of {BROADCAST_EDGES}; use paths.levels() or a sample of sources")
    found: dict = {}
    for r in projection.toLocalIterator():
        found.setdefault(r["src"], []).append(r["dst"])
    return projection.sparkSession.sparkContext.broadcast({k: sorted(v) for k, v in found.items()})


def betweenness(projection: DataFrame, sources: DataFrame | None = None, symmetric: bool = True) -> DataFrame:
    """(id, score): Brandes' accumulation, sources dealt over the executors, the
    parts of each node summed (GA-05). symmetric: the projection is undirected,
    so each pair is counted once. `sources` restricts the sources. Beyond the
    bound of a broadcast adjacency, betweenness_by_joins()."""
    if projection.count() > BROADCAST_EDGES:
        return betweenness_by_joins(projection, sources, symmetric)
    ids = nodes_of(projection)
    held = adjacency(projection)
    kind = ids.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, total = held.value, {}
        for batch in batches:
            for s in batch["id"]:
                order, paths, depth, back = [], {s: 1}, {s: 0}, {}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in graph.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] = paths.get(w, 0) + paths[v]
                            back.setdefault(w, []).append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in back.get(w, ()):
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    parts = (sources or ids).select("id").repartition(max(8, projection.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, f"id {kind}, part double")
    sums = parts.groupBy("id").agg((F.sum("part") / (2 if symmetric else 1)).alias("score"))
    return ids.join(sums, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness_by_joins(projection: DataFrame, sources: DataFrame | None = None, symmetric: bool = True, block_rows: int = 50_000_000) -> DataFrame:
    """betweenness() as joins, for graphs of any size: for a block of sources,
    levels of (source, node, paths) outward, then shares of paths inward level by
    level. A block has as many sources as keep its rows near `block_rows`; its
    parts are written before the next begins."""
    e = cut(projection.select("src", "dst").distinct(), "edges")
    ids = cut(nodes_of(e), "nodes")
    wanted = ids if sources is None else ids.join(sources.select("id"), "id", "left_semi")
    count = ids.count()
    blocks = max(1, -(-wanted.count() * count // block_rows))
    sums = None
    for block in range(blocks):
        at = cut(wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
        rounds, seen = [at], at.select("s", "v")
        while True:
            reached = at.join(e, at.v == e.src).groupBy("s", "dst").agg(F.sum("paths").alias("paths")).withColumnRenamed("dst", "v")
            at = cut(reached.join(seen, ["s", "v"], "left_anti"), "level")
            if at.isEmpty():
                break
            rounds.append(at)
            seen = cut(seen.unionAll(at.select("s", "v")), "seen")
        share = rounds[-1].withColumn("share", F.lit(0.0))
        for k in range(len(rounds) - 1, 0, -1):
            share = cut(share, "share")
            part = share.where("v <> s").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("part"))
            sums = cut(part if sums is None else sums.unionAll(part).groupBy("id").agg(F.sum("part").alias("part")), "sums")
            before = rounds[k - 1].select(F.col("s").alias("s0"), F.col("v").alias("u"), F.col("paths").alias("paths0"))
            over = share.join(e, share.v == e.dst).join(before, (F.col("s") == F.col("s0")) & (F.col("src") == F.col("u")))
            given = over.groupBy("s0", "u").agg(F.sum(F.col("paths0") / F.col("paths") * (1 + F.col("share"))).alias("share"))
            share = before.join(given, ["s0", "u"], "left").select(F.col("s0").alias("s"), F.col("u").alias("v"), F.col("paths0").alias("paths"), F.coalesce("share", F.lit(0.0)).alias("share"))
    if sums is None:
        return ids.select("id", F.lit(0.0).alias("score"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) / (2 if symmetric else 1)).alias("score"))


def closeness(projection: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): nodes reached / sum of distances (GA-13)."""
    e = cut(projection, "edges")
    found = levels(sources if sources is not None else nodes_of(e), e).where("hops > 0")
    return found.groupBy(F.col("start").alias("id")).agg((F.count("*") / F.sum("hops")).alias("score"))


def label_propagation(projection: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): each node takes its neighbours' most frequent label, the
    smallest of those as frequent; all at once (GA-13)."""
    e = cut(projection, "edges")
    now = nodes_of(e).withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = e.join(now, e.dst == now.id).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max_by("community", F.struct("n", (-F.col("community")).alias("low"))).alias("community"))
        before, now = now, cut(best.select(F.col("src").alias("id"), "community"), "labels")
        discard(before)
    return now


def strong_components(projection: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) of mutually reachable nodes (GA-13): forward colours by the
    largest id that reaches a node, then the part of each colour that its root
    reaches backwards; the rest goes on."""
    e = cut(projection.select("src", "dst").distinct(), "edges")
    left, out = cut(nodes_of(e), "nodes"), None
    for _ in range(most_rounds):
        colour = spread(left.withColumn("colour", F.col("id")), e, most_rounds)
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        roots = colour.where("id = colour").select("id")
        back = levels(roots, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        done = cut(back.select(F.col("node").alias("id"), F.col("start").alias("component")), "strong")
        out = done if out is None else out.unionAll(done)
        left = cut(left.join(done, "id", "left_anti"), "nodes")
        if left.isEmpty():
            return out
        e = cut(e.join(left.select(F.col("id").alias("src")), "src").join(left.select(F.col("id").alias("dst")), "dst").select("src", "dst"), "edges")
    raise RuntimeError("strong components did not settle")


def spread(colours: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """Each node's largest colour among the nodes that reach it."""
    now = held = cut(colours, "colours")
    for _ in range(most_rounds):
        given = edges.join(now, edges.src == now.id).groupBy("dst").agg(F.max("colour").alias("given"))
        after = cut(now.join(given, now.id == given.dst, "left").select("id", F.greatest("colour", F.coalesce("given", "colour")).alias("colour"), (F.coalesce("given", "colour") > F.col("colour")).alias("moved")), "colours")
        moved = not after.where("moved").isEmpty()
        discard(held)
        now, held = after.drop("moved"), after
        if not moved:
            return now
    raise RuntimeError("colours did not settle")


def depth_first(projection: DataFrame, start: object) -> DataFrame:
    """(id, position) in depth-first order from `start`, smaller neighbours
    first (GA-13); sequential by nature, over an adjacency of checked size."""
    graph = adjacency(projection)
    spark, kind = projection.sparkSession, projection.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                seen, order, stack = set(), [], [s]
                while stack:
                    v = stack.pop()
                    if v not in seen:
                        seen.add(v)
                        order.append(v)
                        stack.extend(reversed(graph.value.get(v, ())))
                yield pd.DataFrame({"id": order, "position": range(len(order))})

    return spark.createDataFrame([(start,)], f"id {kind}").mapInPandas(run, f"id {kind}, position long")


def louvain(projection: DataFrame, most_levels: int = 10, most_rounds: int = 10) -> DataFrame:
    """(id, community) by greedy modularity (GA-07).

    Nodes choose, all at once, the neighbouring community of the largest gain;
    in odd rounds only moves to smaller community ids, in even rounds only to
    larger ones, so two nodes don't swap for ever. A level ends when modularity
    stops rising; communities then become the nodes of the next level."""
    e = cut(projection.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "weighted")
    assigned = cut(nodes_of(projection).withColumn("community", F.col("id")), "communities")
    total = float(e.agg(F.sum("w")).first()[0] or 0.0)
    if not total:
        return assigned
    best_q = quality(e, assigned.select("id", "community"), total)
    for _ in range(most_levels):
        own = cut(nodes_of(e).withColumn("community", F.col("id")), "level")
        q, own = refine(e, own, total, most_rounds)
        if q <= best_q + 1e-6:
            break
        best_q = q
        assigned = cut(assigned.join(own.select(F.col("id").alias("community"), F.col("community").alias("to")), "community", "left").select("id", F.coalesce("to", "community").alias("community")), "communities")
        grouped = e.join(own.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        e = cut(grouped.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "weighted")
    least = assigned.groupBy("community").agg(F.min("id").alias("least"))
    return assigned.join(least, "community").select("id", F.col("least").alias("community"))


def quality(e: DataFrame, own: DataFrame, total: float) -> float:
    """Modularity of communities over weighted pairs, each way once."""
    both = e.join(own.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    inside = both.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))).first()[0] or 0.0
    squares = both.groupBy("a").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - squares / total**2


def refine(e: DataFrame, own: DataFrame, total: float, most_rounds: int) -> tuple[float, DataFrame]:
    q = quality(e, own, total)
    weight = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "strength")
    for turn in range(most_rounds):
        known = own.join(weight, "id")
        size = known.groupBy("community").agg(F.sum("k").alias("size"))
        near = e.where("src <> dst").join(own.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("to"))
        # staying is a choice too, with what leads inside
        choice = near.unionByName(own.select("id", "community", F.lit(0.0).alias("to"))).groupBy("id", "community").agg(F.sum("to").alias("to"))
        rated = choice.join(size, "community").join(known.select("id", "k", F.col("community").alias("now")), "id")
        gain = F.col("to") - F.col("k") * (F.col("size") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / F.lit(total)
        allowed = (F.col("community") == F.col("now")) | (F.col("community") < F.col("now") if turn % 2 == 0 else F.col("community") > F.col("now"))
        best = rated.where(allowed).groupBy("id").agg(F.max_by("community", F.struct(F.round(gain, 9).alias("g"), (F.col("community") == F.col("now")).alias("stay"), (-F.col("community")).alias("low"))).alias("community"))
        moved = cut(best, "level")
        after = quality(e, moved, total)
        if after > q + 1e-9:
            q, own = after, moved
        elif turn % 2:
            break
    return q, own
