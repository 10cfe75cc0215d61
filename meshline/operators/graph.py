"""Property graphs as node and edge DataFrames, and patterns over them as joins.

A node table has a key column ``id`` and any properties; ``labels`` holds
sub-labels. An edge table has ``src``, ``dst`` and any properties. A pattern is
built step by step; each step is one equi-join on ids, so Catalyst chooses the
physical joins, prunes the columns and pushes the filters to the scans.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meshline.functions.columns import has_label


class Lazy(dict):
    """Values given as functions are made when first asked for, so a query over a
    large catalogue resolves only the tables that it reads."""

    def __getitem__(self, key: str) -> object:
        value = super().__getitem__(key)
        if callable(value):
            value = self[key] = value()
        return value


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: label -> table; edges: type -> (table, source label, target label).
    Either can be a Lazy mapping."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        """'Pathway', or 'Pathway:Elevator' for a sub-label (SRC-13)."""
        main, *sub = label.split(":")
        if main not in self.nodes:
            raise KeyError(f"no node label {main}; there are {sorted(self.nodes)}")
        df = self.nodes[main]
        return df.where(has_label(F.col("labels"), *sub)) if sub else df

    def edge(self, kind: str) -> DataFrame:
        """Several types as 'A|B'; SRC-15."""
        found = []
        for k in kind.split("|"):
            if k not in self.edges:
                raise KeyError(f"no edge type {k}; there are {sorted(self.edges)}")
            found.append(self.edges[k][0].withColumn("type", F.lit(k)))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def all_edges(self) -> DataFrame:
        """(src, dst, type) of every edge, ids as strings."""
        out = None
        for kind in self.edges:
            part = self.edge(kind).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type")
            out = part if out is None else out.unionAll(part)
        return out

    def introspect(self) -> dict[str, dict]:
        """Labels, relationship triples and properties, from the registry alone (SRC-17)."""
        return {
            "labels": {label: list(self.nodes[label].columns) for label in self.nodes},
            "relationships": {kind: (self.edges[kind][1], self.edges[kind][2], [c for c in self.edges[kind][0].columns if c not in ("src", "dst")]) for kind in self.edges},
        }


    def with_ends(self, kind: str, start: str, end: str) -> DataFrame:
        """Edges of a kind with the properties of their nodes as ``start__...``
        and ``end__...``, and an element id (AR-07)."""
        _, source, target = self.edges[kind]
        named = lambda label, name: self.node(label).select(*(F.col(f"`{c}`").alias(f"{name}__{c}") for c in self.node(label).columns))
        e = self.edge(kind).withColumn("element_id", F.concat(F.lit(f"{kind}:"), F.col("src").cast("string"), F.lit("->"), F.col("dst").cast("string")))
        return e.join(named(start or source, "start"), F.col("src") == F.col("start__id")).join(named(end or target, "end"), F.col("dst") == F.col("end__id"))


class Match:
    """A pattern over a graph. Bound variables become columns ``<name>__<property>``."""

    def __init__(self, graph: PropertyGraph, df: DataFrame | None = None, at: str | None = None, fresh: itertools.count | None = None):
        self.graph, self.df, self.at = graph, df, at
        self.fresh = fresh or itertools.count()

    def bound(self, table: DataFrame, name: str) -> DataFrame:
        return table.select(*(F.col(f"`{c}`").alias(f"{name}__{c}") for c in table.columns))

    def start(self, name: str, label: str, where: Callable[[DataFrame], Column] | None = None) -> Match:
        """Bind all nodes of a label, or those that `where` keeps (SRC-13, SRC-14)."""
        table = self.graph.node(label)
        table = table.where(where(table)) if where else table
        return Match(self.graph, self.bound(table, name), name, self.fresh)

    def step(self, kind: str, name: str, label: str | None = None, direction: str = "out", edge: str | None = None, where: Callable[[DataFrame], Column] | None = None) -> Match:
        """One hop from the last bound node (JN-01). Without a label only the
        edge table is joined, its far end bound as ``<name>__id``."""
        edge = edge or f"e{next(self.fresh)}"
        rels = self.graph.edge(kind)
        if direction == "both":
            rels = rels.unionByName(rels.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst"))
        near, far = ("dst", "src") if direction == "in" else ("src", "dst")
        out = self.df.join(self.bound(rels, edge), F.col(f"{self.at}__id") == F.col(f"{edge}__{near}"))
        if label or where:
            table = self.graph.node(label or self.end_label(kind, direction))
            table = table.where(where(table)) if where else table
            out = out.join(self.bound(table, name), F.col(f"{edge}__{far}") == F.col(f"{name}__id"))
        else:
            out = out.withColumn(f"{name}__id", F.col(f"{edge}__{far}"))
        return Match(self.graph, out, name, self.fresh)

    def end_label(self, kind: str, direction: str) -> str:
        _, src, dst = self.graph.edges[kind.split("|")[0]]
        return src if direction == "in" else dst

    def out(self, kind: str, name: str, label: str | None = None, **more: object) -> Match:
        return self.step(kind, name, label, "out", **more)

    def inn(self, kind: str, name: str, label: str | None = None, **more: object) -> Match:
        return self.step(kind, name, label, "in", **more)

    def both(self, kind: str, name: str, label: str | None = None, **more: object) -> Match:
        return self.step(kind, name, label, "both", **more)

    def back_to(self, name: str) -> Match:
        """Go on from an earlier node (star patterns, JN-03)."""
        return Match(self.graph, self.df, name, self.fresh)

    def optional(self, pattern: Callable[[Match], Match]) -> Match:
        """OPTIONAL MATCH of the whole pattern (JN-04): it is joined by itself
        from the distinct ids at hand, then left-joined once."""
        key = f"{self.at}__id"
        ids = self.df.select(F.col(key)).distinct()
        found = pattern(Match(self.graph, ids, self.at, self.fresh)).df.withColumnRenamed(key, "__opt")
        return Match(self.graph, self.df.join(found, F.col(key) == F.col("__opt"), "left").drop("__opt"), self.at, self.fresh)

    def exists(self, kind: str, label: str | None = None, direction: str = "out", negated: bool = False) -> Match:
        """(NOT) (n)-[:kind]->(:label) as a semi or anti join (FLT-07, JN-13)."""
        rels = self.graph.edge(kind)
        near, far = ("dst", "src") if direction == "in" else ("src", "dst")
        if label:
            rels = rels.join(self.graph.node(label).select(F.col("id").alias("__far")), F.col(far) == F.col("__far"), "left_semi")
        rels = rels.select(F.col(near).alias("__near"))
        return Match(self.graph, self.df.join(rels, F.col(f"{self.at}__id") == F.col("__near"), "left_anti" if negated else "left_semi"), self.at, self.fresh)

    def where(self, condition: Column | str) -> Match:
        return Match(self.graph, self.df.where(condition), self.at, self.fresh)

    def select(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*columns)


def latest(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Rows of the largest value of `column` (JN-11): a one-row aggregate,
    broadcast, in place of a second pass over sorted data."""
    base = df.where(where) if where is not None else df
    top = base.agg(F.max(column).alias("__latest"))
    return base.join(F.broadcast(top), F.col(column) == F.col("__latest")).drop("__latest")


def rank_among(df: DataFrame, score: str, key: str) -> DataFrame:
    """`position` of each row by score, then key, and `total` (WN-01). The rank
    is a sum over a range-partitioned sort: counts of the partitions before it,
    plus the place inside; no window holds all rows."""
    ordered = df.repartitionByRange(F.col(score).desc_nulls_first(), F.col(key)).sortWithinPartitions(F.col(score).desc_nulls_first(), F.col(key))
    from meshline.session import cut

    placed = cut(ordered.withColumn("__at", F.monotonically_increasing_id()), "rank")
    parts = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("n"))
    before = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(before), "__part")
    return joined.withColumn("position", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The k best rows of each group; ties: all rows of the k-th rank (WN-05,
    RT-06). A limit for each group runs before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", (F.rank() if ties else F.row_number()).over(w)).where(F.col("__r") <= k).drop("__r")


def keep_first(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row for each key, the first by `order` (AG-18, AG-14): an aggregate
    of the smallest struct, so rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = (F.max_by if last else F.min_by)(F.struct(*(F.col(c) for c in rest)), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by `order`."""
    return keep_first(df, keys, order, last=True)


#: Neighbours of one node that meet in one task; a node with more is dealt out to several.
HUB = 5_000


def paired(e: DataFrame, *more: str) -> DataFrame:
    """(via, a, b) for a < b of the rows (n, via) that share `via`, and
    a_<column>, b_<column> of `more`. A hub's rows are dealt out by a hash on the
    left and repeated on the right, as many times as it has HUB rows, so no task
    takes a hub alone."""
    parts = e.groupBy("via").agg(F.ceil(F.count("*") / F.lit(HUB)).alias("parts")).where("parts > 1")
    spread = e.join(parts, "via", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda name: [F.col("n").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in more)]
    left = spread.select("via", F.pmod(F.hash("n"), F.col("parts")).cast("long").alias("part"), *side("a"))
    right = spread.select("via", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), *side("b"))
    return left.join(right, ["via", "part"]).where("a < b").drop("part")


def common_neighbours(edges: DataFrame, via: str = "dst", of: str = "src") -> DataFrame:
    """(a, b, shared) for pairs a < b that share a neighbour (JN-08)."""
    e = edges.select(F.col(of).alias("n"), F.col(via).alias("via")).distinct()
    return paired(e).groupBy("a", "b").agg(F.count("*").alias("shared"))


def contract(links: DataFrame, pivots: DataFrame) -> DataFrame:
    """Edges through deferred nodes become edges of their outer ends (JN-17):
    left.dst = pivot = right.src, ends differ; a two-way link counts both ways."""
    both = links.select("src", "dst").unionAll(links.where("two_way").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    p = pivots.select(F.col("id").alias("pivot"))
    left = both.join(p, both.dst == p.pivot).select(F.col("src").alias("a"), "pivot")
    right = both.join(p, both.src == p.pivot).select("pivot", F.col("dst").alias("b"))
    return left.join(right, "pivot").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "pivot").distinct()


def spans(units: DataFrame, levels: DataFrame) -> DataFrame:
    """Range join on station: every level between a unit's lowest and highest (JN-18)."""
    l = levels.select(F.col("station").alias("__s"), "level_id", "level_index")  # noqa: E741
    return units.join(l, (F.col("station") == F.col("__s")) & F.col("level_index").between(F.col("lowest"), F.col("highest"))).drop("__s")


def near(left: DataFrame, right: DataFrame, within_m: float) -> DataFrame:
    """Pairs of rows of (id, lat, lon) at most `within_m` apart (JN-07).

    The earth is cut into cells at least `within_m` high and, at their latitude,
    wide; each place on the left meets the nine cells around it in an equi-join,
    and the haversine distance decides. Rows within reach of a pole or of the
    180th meridian are reached as well: cells wrap around, and near a pole a band
    of latitude is one cell. Rows of one place are compared once and come back in
    by that place. No side is broadcast: a small file can hold many rows, and the
    driver would have to build the table of them."""
    import math

    from meshline.functions.columns import metres

    height = within_m / 111_000.0 * 1.01
    bands = max(1, math.floor(180 / height))
    height = 180 / bands

    def cells(lat: Column) -> Column:
        # cells in a band of latitude: as narrow as its edge nearest to a pole allows
        edge = F.least(F.lit(90.0), F.abs(lat) + F.lit(2 * height))
        return F.greatest(F.lit(1.0), F.floor(F.lit(360.0 / height) * F.cos(F.radians(edge)))).cast("long")

    band = lambda lat: F.least(F.floor((lat + 90) / height), F.lit(bands - 1)).cast("long")
    middle = lambda b: (b.cast("double") + 0.5) * height - 90
    cell = lambda lon, n: F.floor((lon + 180) / 360 * n) % n
    side = lambda df, name: df.where("lat is not null and lon is not null").select(F.col("id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    lefts, rights = side(left, "a"), side(right, "b")
    a = lefts.select("a_lat", "a_lon").distinct().select("a_lat", "a_lon", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))).alias("k"))
    a = a.withColumn("band", band(F.col("a_lat")) + F.col("k")).where(F.col("band").between(0, bands - 1)).withColumn("n", cells(middle(F.col("band"))))
    own = cell(F.col("a_lon"), F.col("n"))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + F.lit(k), F.col("n")) for k in (-1, 0, 1)))))).drop("k", "n")
    b = rights.select("b_lat", "b_lon").distinct().withColumn("band", band(F.col("b_lat")))
    b = b.withColumn("cell", cell(F.col("b_lon"), cells(middle(F.col("band")))))
    met = a.join(b.hint("merge"), ["band", "cell"]).withColumn("metres", metres(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    places = met.where(F.col("metres") <= within_m).select("a_lat", "a_lon", "b_lat", "b_lon", "metres")
    return places.join(lefts.hint("merge"), ["a_lat", "a_lon"]).join(rights.hint("merge"), ["b_lat", "b_lon"]).select("a", "b", "metres")
