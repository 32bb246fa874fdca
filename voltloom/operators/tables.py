"""Cycle summaries, sampling, unions and row windows over cycle-level tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.numbers import draw, text_number
from voltloom.operators.curves import first_rows
from voltloom.operators.life import in_cycle_order
from voltloom.operators.ordered import BLOCK_ROWS, near_window, with_ordinal


def summarize_cycler_cycles(log: DataFrame, counter: str = "discharge_capacity_ah") -> DataFrame:
    """Per (cell, cycle): capacity moved by an accumulating counter, and what the log carries."""
    have = set(log.columns)
    aggs = [(F.max(counter) - F.min(counter)).alias("capacity_ah"), F.max(counter).alias("cumulative_ah"),
            (F.max("test_time_s") - F.min("test_time_s")).alias("duration_s"), F.count(F.lit(1)).alias("n_rows")]
    for c, name in (("voltage_v", "voltage"), ("current_a", "current")):
        if c in have:
            aggs += [F.avg(c).alias(f"mean_{name}"), F.min(c).alias(f"min_{name}")]
    if "resistance_ohm" in have:
        aggs.append(F.avg("resistance_ohm").alias("mean_resistance"))
    if "temperature_c" in have:
        aggs += [F.avg("temperature_c").alias("avg_temp"), F.max("temperature_c").alias("max_temp")]
    if "cohort" in have:
        aggs.append(F.first("cohort").alias("cohort"))
    return log.groupBy("cell_id", "cycle").agg(*aggs)


def temperature_conditions(discharges: DataFrame, k: int = 5, cold_c: float = 15.0, drift_c: float = 5.0) -> DataFrame:
    """Per cell: median temperature of the first and last k discharges, and why they cannot be compared."""
    rows = discharges.where("avg_temp IS NOT NULL")
    mid = lambda d, n: d.groupBy("cell_id").agg(F.percentile("avg_temp", 0.5).alias(n))
    both = mid(first_rows(rows, ["cell_id"], ["cycle"], k), "reference_c").join(
        mid(first_rows(rows, ["cell_id"], [F.desc("cycle")], k), "recent_c"), "cell_id")
    low = F.least("reference_c", "recent_c") < cold_c
    moved = F.abs(F.col("recent_c") - F.col("reference_c")) > drift_c
    return both.withColumn("reason", F.when(low, "measured in the cold").when(
        moved, "reference and recent discharges differ in temperature").otherwise(""))


def round_robin_cells(frame: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """Cells taken from the cohorts in turn, in a repeatable shuffled order inside each."""
    cells = frame.select("cohort", "cell_id").distinct().withColumn("_h", draw(seed, text_number(F.col("cell_id"))))
    turn = with_ordinal(cells, ["cohort"], ["_h", "cell_id"], F.floor(F.col("_h") / 2_097_152), "turn")
    return turn.drop("_h").orderBy("turn", "cohort").limit(budget)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Runs with differing columns as one table; a column a run lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sequence_windows(frame: DataFrame, features: Sequence[str], rows: int = 10) -> DataFrame:
    """The last ``rows`` feature rows of every row, the first one repeated in front; n_pad says how many."""
    size = BLOCK_ROWS
    point = F.array(*[F.col(f).cast("double") for f in features])
    out = near_window(in_cycle_order(frame, size), ["cell_id"], "pos", {
        "_w": (F.collect_list(point), -(rows - 1), 0)}, before=rows - 1, size=size)
    pad = rows - F.size("_w")
    return out.withColumns({"n_pad": pad, "window": F.concat(
        F.array_repeat(F.get("_w", F.lit(0)), pad), F.col("_w"))}).drop("_w", "pos")


def method_availability(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: missing, without spread, or usable by a method that needs it."""
    from voltloom.operators.cohorts import long_form
    agg = long_form(frame, [], features).groupBy("feature").agg(
        F.count("value").alias("n"), F.stddev_pop("value").alias("sd"))
    return agg.withColumn("status", F.when(F.col("n") == 0, "missing feature").when(
        F.coalesce(F.col("sd") == 0, F.lit(True)), "zero-variance feature").otherwise("available"))


def shuffled_within_cells(frame: DataFrame, column: str = "capacity_ah", seed: int = 5) -> DataFrame:
    """The column permuted inside each cell: the k-th row by cycle takes the k-th value in a repeatable shuffle."""
    size = BLOCK_ROWS
    rows = in_cycle_order(frame.drop(column), size, "_k")
    mixed = frame.select("cell_id", "cycle", column).withColumn("_h", draw(seed, text_number(F.col("cell_id")), F.col("cycle")))
    chunk = None if size is None else F.floor(F.col("_h") / 2_097_152)
    values = with_ordinal(mixed, ["cell_id"], ["_h", "cycle"], chunk, "_k").select("cell_id", "_k", column)
    return rows.join(values, ["cell_id", "_k"]).drop("_k")
