"""Paths: bounded trails, breadth-first levels, shortest paths.

Loops advance a frontier by one join a round. Each round is written to the shared
folder, which ends the lineage, so a plan stays small and a lost executor costs
one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, the edge's identity kept (JN-09)."""
    back = edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst")
    return edges.unionByName(back)


def trails(starts: DataFrame, edges: DataFrame, least: int, most: int, both: bool = True) -> DataFrame:
    """(start, node, hops) of every walk of `least` to `most` edges that uses no
    edge twice (JN-10). `edges` has eid, src, dst; `starts` has id. The number
    of hops is fixed, so the joins are unrolled into one plan."""
    e = edges.select("eid", "src", "dst")
    e = undirected(e) if both else e
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("used"))
    out = None
    for hop in range(1, most + 1):
        now = now.join(e, now.node == e.src).where(~F.array_contains("used", F.col("eid").cast("string"))).select("start", F.col("dst").alias("node"), F.concat("used", F.array(F.col("eid").cast("string"))).alias("used"))
        if hop >= least:
            part = now.select("start", "node", F.lit(hop).alias("hops"))
            out = part if out is None else out.unionAll(part)
    return out


def trail_ends(starts: DataFrame, edges: DataFrame, least: int, most: int, both: bool = True) -> DataFrame:
    """Distinct (start, node) of trails()."""
    return trails(starts, edges, least, most, both).select("start", "node").distinct()


def levels(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, hops): breadth-first distances over directed `edges` from
    each start (GA-10, GA-12), the start itself with 0; `most` bounds the hops."""
    e = cut(edges.select("src", "dst").distinct(), "edges")
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0)), "levels")
    rounds, at = [seen], seen
    hop = 0
    while most is None or hop < most:
        hop += 1
        reached = at.join(e, at.node == e.src).select("start", F.col("dst").alias("node")).distinct()
        for past in rounds:
            reached = reached.join(past.select("start", "node"), ["start", "node"], "left_anti")
        at = cut(reached.withColumn("hops", F.lit(hop)), "levels")
        if at.isEmpty():
            break
        rounds.append(at)
        if len(rounds) > 8:  # few anti-joins a round, however many rounds
            merged = rounds[0]
            for more in rounds[1:]:
                merged = merged.unionAll(more)
            rounds = [cut(merged, "levels")]
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out


def cheapest(starts: DataFrame, edges: DataFrame, weight: str | None = None, most_rounds: int = 500) -> DataFrame:
    """(start, node, cost, path): cheapest directed paths from each start
    (GA-03), by relaxing the nodes that became cheaper in the round before.
    Without `weight` each edge costs 1. Weights must not be negative. Of paths of
    equal cost the one with fewer nodes, then the smaller one, is kept."""
    e = cut(edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    best = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.array("id").alias("path")), "cheapest")
    changed = best
    for _ in range(most_rounds):
        tried = changed.join(e, changed.node == e.src).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        every = best.withColumn("old", F.lit(0)).unionAll(tried.withColumn("old", F.lit(1)))
        order = F.struct("cost", F.size("path").alias("n"), "path", "old")
        best = cut(every.groupBy("start", "node").agg(F.min(order).alias("s")).select("start", "node", "s.cost", "s.path", "s.old"), "cheapest")
        changed = best.where("old = 1").drop("old")
        best = best.drop("old")
        if changed.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def a_star(starts: DataFrame, goal: object, edges: DataFrame, weight: str, estimate: Column, most_rounds: int = 500) -> DataFrame:
    """The cheapest path to one goal. `estimate` (over a column `node`) must not
    exceed the true rest; nodes whose cost and estimate exceed the cheapest way
    found to the goal are not expanded."""
    e = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    best = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.array("id").alias("path")), "astar")
    changed = best
    for _ in range(most_rounds):
        bound = best.where(F.col("node") == F.lit(goal)).groupBy("start").agg(F.min("cost").alias("bound"))
        open_ = changed.join(F.broadcast(bound), "start", "left").where(F.col("bound").isNull() | (F.col("cost") + estimate < F.col("bound"))).drop("bound")
        tried = open_.join(e, open_.node == e.src).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        every = best.withColumn("old", F.lit(0)).unionAll(tried.withColumn("old", F.lit(1)))
        best = cut(every.groupBy("start", "node").agg(F.min(F.struct("cost", F.size("path").alias("n"), "path", "old")).alias("s")).select("start", "node", "s.cost", "s.path", "s.old"), "astar")
        changed, best = best.where("old = 1").drop("old"), best.drop("old")
        if changed.isEmpty():
            break
    return best.where(F.col("node") == F.lit(goal))


def path_names(paths: DataFrame, names: DataFrame, column: str = "path") -> DataFrame:
    """Adds path_names: the name of each node of the path, null where it has
    none, nulls kept (Q-09); `names` has id, name."""
    at = paths.select("*", F.posexplode(column).alias("__p", "__n"))
    named = at.join(names.select(F.col("id").alias("__id"), F.col("name").alias("__name")), F.col("__n") == F.col("__id"), "left")
    keys = paths.columns
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__name"))), lambda s: s["__name"])
    return named.groupBy(*keys).agg(listed.alias("path_names"))
