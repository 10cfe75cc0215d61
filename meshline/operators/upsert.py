"""Writes with graph-store semantics: upserts, merges, purges, snapshots.

Each takes the state and a batch and returns the new state; write it under a new
path and swap (sources.sinks.replace), so a failed job leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshline.operators.graph import keep_last


def upsert_nodes(state: DataFrame, batch: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """MERGE by key and SET the batch's columns (SNK-02): of rows with one key in
    the batch the last by `ordinal` wins; columns that only the state has stay."""
    last = keep_last(batch, keys, [F.col(ordinal)]).drop(ordinal) if ordinal else batch.dropDuplicates(keys)
    new = [c for c in last.columns if c not in keys]
    old = [c for c in state.columns if c not in keys]
    joined = state.alias("s").join(last.withColumn("__hit", F.lit(True)).alias("b"), keys, "full_outer")
    hit = F.col("__hit").isNotNull()
    columns = [F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in old and c in new else F.col(c) for c in dict.fromkeys(old + new)]
    return joined.select(*keys, *columns)


def merge_create_match(state: DataFrame, batch: DataFrame, key: str, on_match: list[str]) -> DataFrame:
    """New keys are inserted whole; for known ones only `on_match` columns are
    set (SNK-03)."""
    once = batch.dropDuplicates([key])
    touched = once.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in on_match))
    kept = state.join(touched, F.col(key) == F.col("__k"), "left")
    kept = kept.select(*(F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in on_match else F.col(c) for c in state.columns))
    return kept.unionByName(once.join(state.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_edges(rows: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges whose two ends exist, one for each key (SNK-04). A row with a
    missing end is dropped; `keys` can name properties that tell edges apart."""
    ends = rows.join(src_nodes.select(F.col("id").alias("src")), "src", "left_semi").join(dst_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return ends.select(*rows.columns).dropDuplicates(list(keys))


def merge_edges_set(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Edges merged by `keys`, properties of the last row by `ordinal` (SNK-05)."""
    return keep_last(rows, keys, [F.col(ordinal)])


def add_labels(nodes: DataFrame, rules: list[tuple[str, Column]], main: str) -> DataFrame:
    """`labels`: the main label, then each whose condition holds (SNK-06)."""
    return nodes.withColumn("labels", F.array_compact(F.array(F.lit(main), *(F.when(condition, F.lit(name)) for name, condition in rules))))


def derive_two_hop(first: DataFrame, second: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Distinct edges first.src -> second.dst over the shared middle, and the
    direct ones (SNK-07)."""
    a, b = first.select("src", F.col("dst").alias("mid")), second.select(F.col("src").alias("mid"), "dst")
    found = a.join(b, "mid").select("src", "dst")
    return (found if direct is None else found.unionByName(direct.select("src", "dst"))).distinct()


def dispatch(rows: DataFrame, column: str, targets: dict[str, DataFrame], prefixes: dict[str, str], otherwise: str) -> DataFrame:
    """Joins each row to the node table that its id's prefix names (SNK-08);
    adds `target_label`. One join against the labelled union of the tables."""
    label = F.coalesce(*(F.when(F.col(column).startswith(p), F.lit(t)) for p, t in prefixes.items()), F.lit(otherwise))
    every = None
    for name, table in targets.items():
        part = table.select(F.col("id").alias("__id"), F.lit(name).alias("__label"))
        every = part if every is None else every.unionAll(part)
    named = rows.withColumn("target_label", label)
    return named.join(every, (F.col(column) == F.col("__id")) & (F.col("target_label") == F.col("__label"))).drop("__id", "__label")


def coalesced_edges(rows: DataFrame, column: str, tables: list[DataFrame]) -> DataFrame:
    """Rows whose id is in any of the tables, the first table first (SNK-09)."""
    every = None
    for k, table in enumerate(tables):
        part = table.select(F.col("id").alias("__id"), F.lit(k).alias("__table"))
        every = part if every is None else every.unionAll(part)
    first = every.groupBy("__id").agg(F.min("__table").alias("table"))
    return rows.join(first, F.col(column) == F.col("__id")).drop("__id")


def purge_orphans(nodes: DataFrame, required: DataFrame, dependants: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes without an edge in `required` go, and their edges (SNK-10)."""
    kept = nodes.join(required.select(F.col("src").alias("id")), "id", "left_semi")
    return kept, [e.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(*e.columns) for e in dependants]


def resolve_stale(state: DataFrame, poll: Column, reactivate: bool = False) -> DataFrame:
    """Active rows not seen in this poll are resolved at the time of the poll, with
    their whole days out of service (SNK-11). reactivate: a resolved row that was
    seen again becomes active (off by default, Q-22)."""
    stale = (F.col("status") == "active") & (F.col("last_seen_poll") < poll)
    days = F.floor((F.unix_millis(poll) - F.col("date_out_of_service")) / 86_400_000)
    again = (F.col("status") == "resolved") & (F.col("last_seen_poll") >= poll) if reactivate else F.lit(False)
    return state.withColumns(
        {
            "actual_duration_days": F.when(stale, days).when(~again, F.col("actual_duration_days")),
            "resolved_at": F.when(stale, poll).when(~again, F.col("resolved_at")),
            "status": F.when(stale, "resolved").when(again, "active").otherwise(F.col("status")),
        }
    )


def violations(df: DataFrame, unique: list[list[str]] = (), required: list[str] = ()) -> DataFrame:
    """(constraint, broken) counts of unique keys and required columns (SNK-12).
    Required columns are counted in one pass; each key takes one aggregation."""
    counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required)) if required else None
    out = df.sparkSession.createDataFrame([], T.StructType([T.StructField("constraint", T.StringType()), T.StructField("broken", T.LongType())]))
    if counts is not None:
        out = out.unionAll(counts.select(F.explode(F.create_map(*(x for c in required for x in (F.lit(f"not null: {c}"), F.col(c)))))))
    for key in unique:
        out = out.unionAll(df.groupBy(*key).count().where("count > 1").agg(F.count("*")).select(F.lit(f"unique: {','.join(key)}"), F.col("count(1)")))
    return out


def from_feed(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """Each row with the one feed row (SNK-13, JN-22)."""
    return rows.crossJoin(F.broadcast(feed.limit(1)))
