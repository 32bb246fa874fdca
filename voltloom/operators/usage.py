"""Row-level usage flags and stress, rolling and age features, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordered import near_window, with_ordinal

RATED_AH = 2.0
ROLLING_ROWS = 50

# Points per raised flag.
STRESS_POINTS = {
    "aggressive_discharge_event": 30.0,
    "high_temp_flag": 25.0,
    "fast_charge_flag": 20.0,
    "deep_discharge_flag": 15.0,
    "high_soc_flag": 10.0,
}


def flag(condition: Column) -> Column:
    """0/1; a missing input raises no flag."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def with_flags(df: DataFrame, rated_ah: float | Column = RATED_AH, c_rate: float = 1.0) -> DataFrame:
    rated = rated_ah if isinstance(rated_ah, Column) else F.lit(float(rated_ah))
    rate = F.try_divide(F.col("current_a"), rated)
    return df.withColumns({
        "aggressive_discharge_event": flag(rate < -c_rate),
        "fast_charge_flag": flag(rate > c_rate),
        "high_temp_flag": flag(F.col("temperature_c") > 40.0),
        "deep_discharge_flag": flag(F.col("soc") < 20.0),
        "high_soc_flag": flag(F.col("soc") > 90.0),
    })


def stress_of(df: DataFrame, points: dict[str, float] = STRESS_POINTS) -> Column:
    missing = [c for c in ("current_a", "temperature_c", "soc") if c not in df.columns]
    if missing:
        raise ValueError(f"stress score needs {missing}")
    total = sum((F.col(f).cast("double") * p for f, p in points.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def with_stress(df: DataFrame, rated_ah: float | Column = RATED_AH) -> DataFrame:
    flagged = df if set(STRESS_POINTS) <= set(df.columns) else with_flags(df, rated_ah)
    return flagged.withColumn("stress_score", stress_of(flagged))


def with_rolling(df: DataFrame, order: list[str], chunk: Column, rows: int = ROLLING_ROWS,
                 size: int = 65_536) -> DataFrame:
    """Mean/std of stress and mean/max of temperature over the last ``rows`` rows."""
    numbered = with_ordinal(df, ["cell_id"], order, chunk, "_pos")
    back = -(rows - 1)
    rolled = near_window(numbered, ["cell_id"], "_pos", {
        "stress_rolling_mean": (F.avg("stress_score"), back, 0),
        "stress_rolling_std": (F.stddev_samp("stress_score"), back, 0),
        "temp_rolling_mean": (F.avg("temperature_c"), back, 0),
        "temp_rolling_max": (F.max("temperature_c"), back, 0),
    }, before=rows - 1, size=size)
    return rolled.withColumn(
        "stress_rolling_std", F.coalesce("stress_rolling_std", F.lit(0.0))).drop("_pos")


def with_age(df: DataFrame) -> DataFrame:
    """Cycle over the cell's own last cycle, and stress weighted by it.

    The per-cell maximum is a small aggregate joined back; a window would send
    a whole cell to one task.
    """
    last = df.groupBy("cell_id").agg(F.max("cycle").alias("_last"))
    age = F.coalesce(F.try_divide(F.col("cycle").cast("double"), F.col("_last")), F.lit(0.0))
    return (df.join(last, "cell_id").withColumn("battery_age_factor", age)
            .withColumn("cycle_stress_index", F.col("stress_score") * F.col("battery_age_factor"))
            .drop("_last"))


def _usage_aggregates() -> list[Column]:
    return [
        F.avg("stress_score").alias("avg_stress"),
        F.avg("temperature_c").alias("avg_temp"),
        F.sum("fast_charge_flag").alias("fast_charge_duration"),
        F.sum("deep_discharge_flag").alias("deep_discharge_duration"),
        F.sum("high_temp_flag").alias("high_temp_duration"),
        F.sum("aggressive_discharge_event").alias("aggressive_discharge_count"),
        F.avg("soc").alias("avg_soc"),
    ]


def summarize_batteries(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("cell_id").alias("battery_id")).agg(*_usage_aggregates())


def summarize_by_cycle(df: DataFrame) -> DataFrame:
    return df.groupBy("cell_id", "cycle").agg(
        *_usage_aggregates(), F.max("temperature_c").alias("max_temp"),
        F.count(F.lit(1)).alias("n_rows"))


def usage_share(df: DataFrame) -> DataFrame:
    """Percent of rows per flag, one decimal, and what is left as nominal."""
    shares = {
        "aggressive_pct": "aggressive_discharge_event", "fast_charge_pct": "fast_charge_flag",
        "hot_pct": "high_temp_flag", "deep_pct": "deep_discharge_flag", "high_soc_pct": "high_soc_flag",
    }
    out = df.groupBy("cell_id").agg(*[
        F.bround(F.avg(c) * 100, 1).alias(n) for n, c in shares.items()])
    total = sum((F.col(n) for n in shares), F.lit(0.0))
    return out.withColumn("nominal_pct", F.bround(F.greatest(F.lit(0.0), 100 - total), 1))
