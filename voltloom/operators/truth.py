"""Field readings against laboratory labels, and how far off they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.operators.curves import first_rows
from voltloom.operators.ordered import exact_quantiles, spearman
from voltloom.operators.phases import CELL


def cycler_cycles(discharges: DataFrame, samples: DataFrame) -> DataFrame:
    """(cell, cycle, cycler_cycle): the cycler's own number at each discharge start.

    A discharge starts at one of its samples, so this is an equality join on
    (cell, time), not a search.
    """
    starts = discharges.select("cell_id", "cycle", "start_time_s")
    at = samples.select("cell_id", F.col("test_time_s").alias("start_time_s"), "seq", F.col("cycle").alias("cycler_cycle"))
    return starts.join(at, ["cell_id", "start_time_s"]).groupBy("cell_id", "cycle").agg(
        F.min_by("cycler_cycle", "seq").alias("cycler_cycle"))


def label_join(readings: DataFrame, numbers: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Readings with ``soh_true``: the label over the median of the cell's first k labels."""
    ref = first_rows(labels.where("capacity_ah IS NOT NULL"), CELL, ["cycler_cycle"], k).groupBy("cell_id").agg(
        F.percentile("capacity_ah", 0.5).alias("_ref"))
    truth = labels.join(ref, "cell_id").select(
        "cell_id", "cycler_cycle", F.when(F.col("_ref") > 0, F.col("capacity_ah") / F.col("_ref")).alias("soh_true"))
    return readings.join(numbers, ["cell_id", "cycle"]).join(truth, ["cell_id", "cycler_cycle"])


def accuracy(joined: DataFrame, keys: Sequence[str], estimate: str, truth: str = "soh_true") -> DataFrame:
    """Per key: labelled and read discharges, bias, mean, median and p90 absolute error, rank correlation."""
    e = F.col(estimate) - F.col(truth)
    rows = joined.withColumn("_e", F.abs(e))
    sums = rows.groupBy(*keys).agg(
        F.count(truth).alias("n_labelled"), F.count("_e").alias("n_read"), F.count_distinct("cell_id").alias("n_cells"),
        F.avg(e).alias("bias"), F.avg("_e").alias("mae"))
    spread = exact_quantiles(rows, keys, "_e", {"median_error": 0.5, "p90_error": 0.9})
    rho = spearman(joined, keys, estimate, truth).drop("n")
    return sums.join(spread, list(keys), "left").join(rho, list(keys), "left").withColumn(
        "share_read", F.try_divide(F.col("n_read"), F.col("n_labelled")))
