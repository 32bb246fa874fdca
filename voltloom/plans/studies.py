"""Studies composed of the operators: errors by bin, by window, by number of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordered import exact_quantiles

# Bins of true remaining cycles.
HORIZON_BINS = ((0, 25), (25, 50), (50, 100), (100, 200), (200, 400), (400, 10_000))


def bin_label(x: Column, bins: tuple[tuple[int, int], ...] = HORIZON_BINS) -> Column:
    out = None
    for low, high in bins:
        text = f"{low}-{high}" if high < 10_000 else f"{low}+"
        hit = (x >= low) & (x < high)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def horizon_table(scored: DataFrame, by: str = "rul_true", tolerance: float = 20.0) -> DataFrame:
    """Errors of remaining-life estimates by bin of the truth (or of the prediction)."""
    rows = scored.where("error IS NOT NULL").withColumn("bin", bin_label(F.col(by))).where("bin IS NOT NULL")
    mid = exact_quantiles(rows, ["bin"], "error", {"median_bias": 0.5}).join(
        exact_quantiles(rows, ["bin"], F.abs("error"), {"median_abs_error": 0.5}), "bin")
    agg = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"),
                                  F.avg((F.abs("error") <= tolerance).cast("double")).alias("within"))
    return agg.join(mid, "bin")


def error_bands(scored: DataFrame) -> DataFrame:
    """Per prediction bin: quantiles of true minus predicted, and how often the cell lasted."""
    later = F.col("rul_true") - F.col("rul_pred")
    rows = scored.where("rul_pred IS NOT NULL").withColumns({"bin": bin_label(F.col("rul_pred")), "later": later})
    q = exact_quantiles(rows, ["bin"], "later", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    agg = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"),
                                  F.avg((F.col("later") >= 0).cast("double")).alias("share_at_least"))
    return agg.join(q, "bin")


def window_agreement(first: DataFrame, second: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Two window estimates of one discharge: how often they disagree, and by how much."""
    a = first.select("cell_id", "cycle", F.col("soh_window").alias("a"))
    b = second.select("cell_id", "cycle", F.col("soh_window").alias("b"))
    both = a.join(b, ["cell_id", "cycle"], "full")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(gap).alias("n_both"), F.count_if(gap > tolerance).alias("n_flagged"),
        F.avg(gap).alias("mean_gap"))


def resistance_growth(steps: DataFrame, k: int = 25) -> DataFrame:
    """Median step resistance of the first and the last k discharges of each cell."""
    from voltloom.operators.curves import first_rows
    rows = steps.where("r_step_ohm IS NOT NULL")
    mid = lambda d, n: d.groupBy("cell_id").agg(F.percentile("r_step_ohm", 0.5).alias(n))
    early = mid(first_rows(rows, ["cell_id"], ["cycle"], k), "r_first")
    late = mid(first_rows(rows, ["cell_id"], [F.desc("cycle")], k), "r_last")
    return early.join(late, "cell_id").withColumn("growth", F.try_divide(F.col("r_last"), F.col("r_first")))


def pivot_arms(table: DataFrame, arms: list[str]) -> DataFrame:
    """(cell, cycle) by arm."""
    return table.groupBy("cell_id", "cycle").pivot("arm", arms).agg(F.first("soh_window"))


def calendar_ageing(storage: DataFrame, initial: DataFrame) -> DataFrame:
    """Capacity lost in storage, and its rank correlation with charge level and temperature."""
    from voltloom.operators.ordered import spearman
    loss = storage.join(initial, "item_id").withColumn(
        "loss_pct", 100.0 * (F.col("initial_ah") - F.col("post_ah")) / F.col("initial_ah")).withColumn(
        "soc_temp", F.col("storage_soc") * F.col("storage_temp_c"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                      for f in ("storage_soc", "storage_temp_c", "soc_temp")])
    return spearman(loss.select("loss_pct", F.inline(cells)), ["feature"], "x", "loss_pct")
