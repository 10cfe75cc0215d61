"""Neighbourhoods of anchors and their serialisation under a token budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meshline.operators.paths import undirected
from meshline.session import cut


@dataclass(frozen=True)
class Expansion:
    """Limits of a neighbourhood by domain (RT-10)."""

    hops: int = 3
    rows_per_hop: int = 500
    nodes: int = 5000
    kinds: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()


#: Hops and rows for each domain.
DOMAINS = {
    "transfer_impact": Expansion(hops=4, rows_per_hop=500),
    "accessibility": Expansion(hops=3, rows_per_hop=500),
    "delay_propagation": Expansion(hops=3, rows_per_hop=100),
}


@dataclass
class Subgraph:
    """nodes: id, label, hop; edges: src, dst, type. `failed` says why it is
    empty, if something went wrong (RT-15)."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    failed: str = ""
    notices: list[str] = field(default_factory=list)


def seeds(nodes: DataFrame, anchors: list[tuple[str, str, str]]) -> DataFrame:
    """Nodes that anchors (label, property, value) name (RT-11); a route is found
    by id or by short name alike, as `property` may be 'a|b'."""
    out = None
    for label, prop, value in anchors:
        hit = None
        for p in prop.split("|"):
            h = F.col(p) == value
            hit = h if hit is None else hit | h
        part = nodes.where((F.col("label") == label) & F.coalesce(hit, F.lit(False))).select("id")
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def expand(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, how: Expansion = Expansion()) -> Subgraph:
    """k-hop neighbourhood (RT-09): each round joins the frontier with the edges
    of allowed kinds, either way, keeps allowed labels, at most `rows_per_hop`
    rows by id order (the feature's own limit), and stops at `nodes` nodes. A
    node keeps the hop at which it was first seen; edges are distinct."""
    e = edges.where(F.col("type").isin(*how.kinds)) if how.kinds else edges
    both = cut(undirected(e.select("src", "dst", "type").withColumn("forward", F.lit(True))), "edges")
    allowed = nodes.where(F.col("label").isin(*how.labels)) if how.labels else nodes
    seen = cut(nodes.join(anchors.select("id").distinct(), "id", "left_semi").select("id", "label").withColumn("hop", F.lit(0)), "seen")
    found, frontier = None, seen
    for hop in range(1, how.hops + 1):
        steps = both.join(frontier.select(F.col("id").alias("src")), "src").join(allowed.select(F.col("id").alias("dst"), "label"), "dst")
        steps = cut(steps.orderBy("src", "dst", "type").limit(how.rows_per_hop).select("src", "dst", "type", "label"), "hop")
        found = steps if found is None else found.unionAll(steps)
        fresh = steps.select(F.col("dst").alias("id"), "label").distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        room = how.nodes - seen.count()
        frontier = cut(fresh.orderBy("id").limit(max(0, room)), "frontier")
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier), "seen")
    rest = [c for c in nodes.columns if c not in ("id", "label")]
    out = Subgraph(nodes.join(seen.select("id", "hop"), "id").select("id", "label", "hop", *rest), None)
    if found is not None:
        back = e.select("src", "dst", "type")
        pairs = found.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "type").distinct()
        kept = back.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(pairs, ["x", "y", "type"], "left_semi").select("src", "dst", "type").distinct()
        # both ends must be inside: the budget can cut a node off
        out.edges = kept.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")
    return out


def provenance(subgraph: Subgraph, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Distinct edges of provenance kinds from the neighbourhood, one hop (RT-12)."""
    return edges.where(F.col("type").isin(*kinds)).join(subgraph.nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "type").distinct()


#: Groups of labels that are trimmed, the first first; what is in none never goes.
TRIM = (("provenance", ("FeedInfo", "TripUpdate", "ServiceAlert")), ("level", ("Level",)), ("service", ("ServicePattern", "Trip", "Date")), ("interruption", ("Interruption", "StopTimeUpdate")))
BUDGET, RESERVED = 6000, 30


def token_counter(path: str) -> Callable[[Column], Column]:
    """Counts a text's tokens by a tokenizer file that every executor has, in
    Arrow batches; the tokenizers library is loaded when the first batch comes."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(x.ids) for x in found])

    return count


def within_budget(nodes: DataFrame, text: str, budget: int = BUDGET, reserved: int = RESERVED, trim: tuple = TRIM, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows that fit a token budget (RT-13): groups are given up in the order of
    `trim`, in each the farthest hop first; anchors (hop 0) and labels of no
    group stay. `tokens` counts a text's tokens, as token_counter() does; without it a
    token is four characters, rounded up. Adds
    `tokens`, `used` (running sum in order of importance): sums of the range
    partitions before, and the sum inside, so no task holds all rows."""
    group = F.lit(len(trim))
    for k, (_, labels) in enumerate(trim):
        group = F.when(F.col("label").isin(*labels), k).otherwise(group)
    importance = F.when(F.col("hop") == 0, len(trim) + 1).otherwise(group)
    order = (F.desc("__importance"), F.col("hop"), F.col("id"))
    rated = nodes.withColumn("tokens", tokens(F.col(text)) if tokens else F.ceil(F.length(F.col(text)) / 4)).withColumn("__importance", importance)
    placed = cut(rated.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "budget").withColumn("__part", F.shiftright("__at", 33))
    totals = placed.groupBy("__part").agg(F.sum("tokens").alias("n"))  # a row for each range partition
    before = totals.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    inside = F.sum("tokens").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("used", inside).join(F.broadcast(before), "__part").withColumn("used", F.col("used") + F.col("__before"))
    return summed.where((F.col("used") <= budget - reserved) | (F.col("__importance") >= len(trim))).drop("__importance", "__at", "__part", "__before")


def serialise(subgraph: Subgraph, text: str, budget: int = BUDGET) -> str:
    """The neighbourhood as text: nodes by hop, then edges, then what was left
    out (RT-14)."""
    if subgraph.failed or subgraph.nodes is None:
        return f"(no context: {subgraph.failed or 'nothing found'})"
    kept = within_budget(subgraph.nodes, text, budget)
    rows = kept.orderBy("hop", "label", "id").collect()  # bounded by the budget
    lines = [f"[{r['hop']}] {r['label']} {r[text]}" for r in rows]
    ids = {r["id"] for r in rows}
    if subgraph.edges is not None:
        few = subgraph.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
        lines += [f"{r['src']} -{r['type']}-> {r['dst']}" for r in few.orderBy("src", "dst", "type").collect() if r["src"] in ids]
    left = subgraph.nodes.count() - len(rows)
    if left:
        lines.append(f"({left} nodes left out to keep within {budget} tokens)")
    return "\n".join(lines)
