"""The driver's tables seen as a transit-like property graph, and the registry
of named queries with their SQL equivalents.

Route = supplier, Station = part, SERVES = two or more line items of the pair,
Trip = order, SCHEDULED_AT = line item, Zone = nation, Region = region,
Interruption = an event of value 100 or more, Outage = the errors of a user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators.graph import Lazy, PropertyGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views that several SQL equivalents start with.
VIEWS = {
    "serves": "serves AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)",
    "und": "und AS (SELECT src AS a, 1000000000 + dst AS b FROM serves UNION SELECT 1000000000 + dst, src FROM serves)",
    "intr": "intr AS (SELECT event_id AS id, user_id, event_type, value, ts, strftime(ts, '%Y%m%d') AS date, CASE WHEN value >= 250 THEN 'SEVERE' ELSE 'WARNING' END AS severity FROM events WHERE value >= 100)",
    "rail": "rail AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey, CASE WHEN s_nationkey < 12 THEN 'Rail' ELSE 'Bus' END AS mode FROM supplier)",
}


def query(sql: str | None = None, *views: str) -> Callable:
    """Registers a query; `sql` is its DuckDB equivalent, after the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE " + ", ".join(VIEWS[v] for v in views) + " " if views else ""
            text = sql.strip()
            if views and text.upper().startswith("WITH "):
                head, text = head.rstrip() + ", ", text[5:].lstrip().removeprefix("RECURSIVE ").lstrip()
            ORACLES[f.__name__] = head + text
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def serves(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"))
    return calls.where("n >= 2").select("src", "dst")


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    """SERVES as an undirected graph; stations are offset to keep ids apart."""
    e = serves(spark, d).select("src", (F.col("dst") + 1_000_000_000).alias("dst"))
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def interruptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value >= 100").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", "ts", F.date_format("ts", "yyyyMMdd").alias("date"), F.when(F.col("value") >= 250, "SEVERE").otherwise("WARNING").alias("severity"))


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    t = lambda name: table(spark, d, name)
    mode = F.when(F.col("s_nationkey") < 12, "Rail").otherwise("Bus")

    def pick(name: str, *columns):
        return lambda: t(name).select(*columns)

    def ends(name: str, src: str, dst: str, source: str, target: str, *more, distinct: bool = False):
        def make():
            df = t(name).select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more)
            return (df.distinct() if distinct else df), source, target

        return make

    as_ = lambda column, alias: F.col(column).alias(alias)
    return PropertyGraph(
        nodes=Lazy(
            Route=pick("supplier", as_("s_suppkey", "id"), as_("s_name", "name"), as_("s_nationkey", "zone_id"), as_("s_acctbal", "balance"), mode.alias("mode"), F.array(F.lit("Route"), mode).alias("labels")),
            Station=pick("part", as_("p_partkey", "id"), as_("p_name", "name"), as_("p_brand", "brand"), as_("p_type", "type"), as_("p_size", "size"), as_("p_retailprice", "price"), F.array(F.lit("Station"), F.col("p_type")).alias("labels")),
            Trip=pick("orders", as_("o_orderkey", "id"), as_("o_orderstatus", "status"), as_("o_totalprice", "total"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), as_("o_orderpriority", "service")),
            Zone=pick("nation", as_("n_nationkey", "id"), as_("n_name", "name")),
            Region=pick("region", as_("r_regionkey", "id"), as_("r_name", "name")),
            Rider=pick("customer", as_("c_custkey", "id"), as_("c_name", "name"), as_("c_mktsegment", "segment"), as_("c_acctbal", "balance")),
            Interruption=lambda: interruptions(spark, d),
        ),
        edges=Lazy(
            SERVES=lambda: (serves(spark, d), "Route", "Station"),
            SCHEDULED_AT=ends("lineitem", "l_orderkey", "l_partkey", "Trip", "Station", as_("l_linenumber", "stop_sequence"), as_("l_quantity", "quantity"), as_("l_extendedprice", "price")),
            RUNS=ends("lineitem", "l_suppkey", "l_orderkey", "Route", "Trip", distinct=True),
            IN_ZONE=ends("supplier", "s_suppkey", "s_nationkey", "Route", "Zone"),
            LIVES_IN=ends("customer", "c_custkey", "c_nationkey", "Rider", "Zone"),
            PART_OF=ends("nation", "n_nationkey", "n_regionkey", "Zone", "Region"),
            PLACED=ends("orders", "o_custkey", "o_orderkey", "Rider", "Trip"),
            AFFECTS=lambda: (interruptions(spark, d).select(as_("id", "src"), as_("user_id", "dst")), "Interruption", "Rider"),
        ),
    )
