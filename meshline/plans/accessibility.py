"""The accessibility layer: outages from polled incidents (ETL-17, ETL-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.functions.columns import decode, epoch_millis, whole_days
from meshline.operators.resolve import resolve_outages

RENAME = {
    "UnitName": "unit_name",
    "UnitType": "unit_type",
    "StationCode": "station_code",
    "LocationDescription": "location_description",
    "SymptomDescription": "symptom_description",
    "DateOutOfService": "date_out_of_service",
    "DateUpdated": "date_updated",
    "EstimatedReturnToService": "estimated_return",
}
#: Severity of a symptom; others are 2.
SEVERITY = {"Service Call": 2, "Other": 2, "Inspection Repair": 2, "Minor Repair": 2, "Major Repair": 3, "Modernization": 4}


def outages(incidents: DataFrame, poll: Column) -> DataFrame:
    """One row for each unit, outage and update: times in milliseconds, severity,
    whole days until the expected return, status active."""
    kept = incidents.select(*(F.col(old).alias(new) for old, new in RENAME.items() if old in incidents.columns))
    for c in ("date_out_of_service", "date_updated", "estimated_return"):
        kept = kept.withColumn(c, epoch_millis(F.col(c)) if c in kept.columns else F.lit(None).cast("long"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return kept.withColumns(
        {
            "composite_key": F.concat_ws("|", F.coalesce("unit_name", F.lit("None")), number("date_out_of_service"), number("date_updated")),
            "severity": decode(F.col("symptom_description"), SEVERITY, 2),
            "projected_duration_days": whole_days(F.col("estimated_return"), F.col("date_out_of_service")),
            "status": F.lit("active"),
            "poll_timestamp": poll,
        }
    ).dropDuplicates(["composite_key"])


def affects(outage_rows: DataFrame, pathways: DataFrame, stop_names: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(composite_key, pathway_id, tier) of the outages that a tier resolves."""
    found = resolve_outages(outage_rows.withColumn("outage_id", F.col("composite_key")), pathways, stop_names, known)
    return found.select(F.col("outage_id").alias("composite_key"), F.col("match").alias("pathway_id"), "tier")
