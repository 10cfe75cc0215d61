"""The fare layer: zones, media, products, leg and transfer rules (ETL-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.columns import amount_in_id, by_prefix, clean
from meshline.operators.graph import keep_first
from meshline.sources.feeds import column_or_null

#: Prefix of a product id, logical product, name; the first that fits.
PRODUCTS = (
    ("metrobus_one_way_regular_fare", "bus_regular", "Metrobus Regular"),
    ("metrobus_one_way_express_fare", "bus_express", "Metrobus Express"),
    ("metrobus_transfer_discount", "bus_transfer_discount", "Metrobus Transfer Discount"),
    ("metrorail_free_fare", "rail_free", "Metrorail Free"),
    ("metrorail_one_way_full_fare", "rail_one_way", "Metrorail One-Way"),
)
RAIL_NETWORKS = ("metrorail", "metrorail_shuttle")


def logical(product_id):
    return by_prefix(clean(product_id), [(p, i) for p, i, _ in PRODUCTS])


def zones(stops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fare_zones, station_zones, gate_zones) of stops that have a zone."""
    z = stops.select("stop_id", clean(F.col("zone_id")).alias("zone_id"), column_or_null(stops, "parent_station").alias("parent_station")).where("zone_id is not null")
    return z.select("zone_id").distinct(), z.where(F.col("stop_id").startswith("STN_")).select("stop_id", "zone_id"), z.where(F.contains(F.col("stop_id"), F.lit("_FG_")))


def products(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fare_products: logical id and name; accepted: logical id, medium)."""
    named = raw.select(logical(F.col("fare_product_id")).alias("fare_product_id"), by_prefix(clean(F.col("fare_product_id")), [(p, n) for p, _, n in PRODUCTS]).alias("fare_product_name"), clean(F.col("fare_media_id")).alias("fare_media_id")).where("fare_product_id is not null")
    return named.select("fare_product_id", "fare_product_name").distinct(), named.select("fare_product_id", "fare_media_id").distinct()


def amounts(raw: DataFrame) -> DataFrame:
    """(raw product id, amount): the suffix of the id, else the table's amount (last row), else 0."""
    last = keep_first(raw.select(clean(F.col("fare_product_id")).alias("pid"), F.col("amount").try_cast("double").alias("listed"), "_ordinal"), ["pid"], [-F.col("_ordinal")])
    return last.select("pid", F.coalesce(amount_in_id(F.col("pid")), "listed", F.lit(0.0)).alias("amount"))


def leg_rules(raw: DataFrame, stops: DataFrame, product_rows: DataFrame) -> dict[str, DataFrame]:
    """leg_rules (rule_id, leg_group_id, network_id), applies_product, from_area
    and to_area. A rule's id is its group and its two areas. An area of a rail
    rule that no zone has is an error."""
    c = lambda name: clean(column_or_null(raw, name)).alias(name)
    rows = raw.select(c("leg_group_id"), c("network_id"), c("from_area_id"), c("to_area_id"), c("fare_product_id"), c("from_timeframe_group_id"), "_ordinal").where("leg_group_id is not null")
    rows = rows.withColumn("rule_id", F.concat_ws("__", "leg_group_id", F.coalesce("from_area_id", F.lit("NULL")), F.coalesce("to_area_id", F.lit("NULL"))))
    known = amounts(product_rows)
    priced = rows.join(known, rows.fare_product_id == known.pid, "left")
    applies = priced.select("rule_id", logical(F.col("fare_product_id")).alias("fare_product_id"), F.col("from_timeframe_group_id").alias("timeframe"), F.coalesce("amount", amount_in_id(F.col("fare_product_id")), F.lit(0.0)).alias("amount"), F.lit("USD").alias("currency")).where("fare_product_id is not null").distinct()
    zone_of = keep_first(stops.select("stop_id", clean(F.col("zone_id")).alias("zone_id"), "_ordinal").where("zone_id is not null"), ["stop_id"], [-F.col("_ordinal")]).select("stop_id", "zone_id")
    rail = rows.where(F.col("network_id").isin(*RAIL_NETWORKS) & F.col("from_area_id").isNotNull())
    ends, missing = {}, []
    for end in ("from", "to"):
        at = rail.where(F.col(f"{end}_area_id").isNotNull()).join(zone_of, F.col(f"{end}_area_id") == zone_of.stop_id, "left")
        missing.append(at.where("zone_id is null").select(F.col(f"{end}_area_id").alias("area")))
        ends[end] = keep_first(at.where("zone_id is not null").select("rule_id", "zone_id", "_ordinal"), ["rule_id"], [F.col("_ordinal")]).drop("_ordinal")
    lost = [r["area"] for r in missing[0].unionAll(missing[1]).distinct().orderBy("area").limit(20).collect()]
    if lost:
        raise ValueError(f"areas of fare rules without a zone, such as {', '.join(lost)}")
    first = keep_first(rows.select("rule_id", "leg_group_id", "network_id", "_ordinal"), ["rule_id"], [F.col("_ordinal")]).drop("_ordinal")
    return {"leg_rules": first, "applies_product": applies, "from_area": ends["from"], "to_area": ends["to"]}


def transfer_rules(raw: DataFrame | None, spark) -> DataFrame:
    """Transfer rules with logical products; none without the optional table."""
    names = ("from_leg_group_id", "to_leg_group_id", "transfer_count", "duration_limit", "duration_limit_type", "fare_transfer_type", "fare_product_id")
    if raw is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in ("rule_id", *names)))
    rows = raw.select(*(clean(column_or_null(raw, n)).alias(n) for n in names)).withColumn("fare_product_id", logical(F.col("fare_product_id")))
    null = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("NULL"))
    return rows.withColumn("rule_id", F.concat_ws("__", null("from_leg_group_id"), null("to_leg_group_id"), null("fare_product_id")))
