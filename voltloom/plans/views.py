"""Read views over the stage tables: fleet figures, cards, timelines, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("CRITICAL", "DEGRADED", "WARNING", "HEALTHY")


def fleet_rollup(batteries: DataFrame) -> DataFrame:
    """One row for the whole fleet; the worst battery has the highest index."""
    return batteries.agg(
        F.count(F.lit(1)).alias("n_batteries"),
        *[F.count_if(F.col("battery_state") == s).alias(f"n_{s.lower()}") for s in STATES],
        F.avg("health_index").alias("mean_health_index"),
        F.avg("rul_cycles").alias("mean_rul"),
        F.min_by("battery_id", F.struct((-F.col("health_index")).alias("m"), "battery_id"))
        .alias("worst_battery"),
        F.count_if(F.col("battery_state").isin("CRITICAL", "DEGRADED")).alias("n_needing_action"),
        F.count_distinct(F.round("health_index", 2)).alias("n_distinct_health"),
    )
