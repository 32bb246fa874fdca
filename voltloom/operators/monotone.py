"""Monotone fits: how much of a target is trend, and voltage against charge.

A fit needs a series in order. What reaches a task is one row per distinct x
of a key (the cycles of a battery, the samples of one discharge), never the
samples of a battery: equal x are averaged with their weight before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordered import spearman

MIN_ROWS, MIN_POINTS = 10, 3


def pooled(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing series nearest to y in weighted squares (adjacent violators pooled)."""
    sums: list[float] = []
    weights: list[float] = []
    lengths: list[int] = []
    for value, weight in zip(y.tolist(), w.tolist()):
        total, size, n = value * weight, weight, 1
        while sums and sums[-1] * size >= total * weights[-1]:
            total, size, n = total + sums.pop(), size + weights.pop(), n + lengths.pop()
        sums.append(total)
        weights.append(size)
        lengths.append(n)
    return np.repeat(np.array(sums) / np.array(weights), lengths) if sums else np.zeros(0)


def cell_signal(frame: DataFrame, target: str) -> DataFrame:
    """(cell, n, signal_ss, noise_ss): squares of the monotone trend and of what is left.

    The direction is the sign of the rank correlation with the cycle. Cells
    with under ten values, under three cycles or one value are left out.
    """
    rows = frame.select("cell_id", F.col("cycle").cast("double").alias("x"), F.col(target).cast("double").alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL")
    points = rows.groupBy("cell_id", "x").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * F.count(F.lit(1))).alias("within"))
    usable = rows.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("x").alias("_x"), F.var_pop("y").alias("_v")).where(
        (F.col("_n") >= MIN_ROWS) & (F.col("_x") >= MIN_POINTS) & (F.col("_v") > 0))
    turn = spearman(rows, ["cell_id"], "x", "y").select(
        "cell_id", F.when(F.col("rho") >= 0, 1.0).otherwise(-1.0).alias("turn"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        y, n, turn = part["y"].to_numpy(), part["n"].to_numpy(np.float64), float(part["turn"].iloc[0])
        trend = turn * pooled(turn * y, n)
        mean = (y * n).sum() / n.sum()
        return pd.DataFrame({
            "cell_id": [part["cell_id"].iloc[0]], "n": [int(n.sum())], "signal_ss": [(n * (trend - mean) ** 2).sum()],
            "noise_ss": [float(part["within"].sum()) + (n * (y - trend) ** 2).sum()]})

    return points.join(usable.select("cell_id"), "cell_id").join(turn, "cell_id").groupBy("cell_id").applyInPandas(
        fit, "cell_id string, n long, signal_ss double, noise_ss double")


def signal_fraction(frame: DataFrame, target: str) -> DataFrame:
    """One row: the share of within-cell variance that is trend, which bounds any model's R²."""
    total = F.sum("signal_ss") + F.sum("noise_ss")
    return cell_signal(frame, target).agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.try_divide(F.sum("signal_ss"), F.sum("n")).alias("signal_variance"),
        F.try_divide(F.sum("noise_ss"), F.sum("n")).alias("noise_variance"),
        F.when(total > 0, F.sum("signal_ss") / total).alias("signal_fraction")).select(F.lit(target).alias("target"), "*")


def falling_voltage(curves: DataFrame) -> DataFrame:
    """Discharge curves whose voltage is the nearest non-increasing one along the charge.

    A task reads its samples in the order of their curves, many curves in one
    batch; a curve that a batch cuts waits for its rest.
    """
    def whole(part: pd.DataFrame) -> pd.DataFrame:
        opens = _opens(part)
        q = part["capacity_ah_curve"].to_numpy()
        place = np.cumsum(opens | (q != np.roll(q, 1))) - 1
        n = np.bincount(place).astype(np.float64)
        means = np.bincount(place, weights=part["voltage_v"].to_numpy()) / n
        ends = [*place[np.flatnonzero(opens)].tolist(), len(n)]
        fit = np.concatenate([-pooled(-means[i:j], n[i:j]) for i, j in zip(ends, ends[1:])])
        return part.assign(voltage_v=fit[place])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for part in batches:
            if part.empty:
                continue
            at = np.flatnonzero(_opens(part, waiting[-1] if waiting else None))
            if len(at):
                done = pd.concat([*waiting, part[:at[-1]]], ignore_index=True)
                if len(done):
                    yield whole(done)
                waiting, part = [], part[at[-1]:]
            waiting.append(part)
        if waiting:
            yield whole(pd.concat(waiting, ignore_index=True))

    cols = ["cell_id", "cycle", "test_time_s", "seq", "voltage_v", "capacity_ah_curve"]
    known = curves.select(*cols).where(
        "voltage_v IS NOT NULL AND NOT isnan(voltage_v) AND capacity_ah_curve IS NOT NULL AND NOT isnan(capacity_ah_curve)")
    ordered = known.repartition("cell_id", "cycle").sortWithinPartitions(
        "cell_id", "cycle", "capacity_ah_curve", "test_time_s", "seq")
    return ordered.mapInPandas(fit, known.schema)


def _opens(part: pd.DataFrame, before: pd.DataFrame | None = None) -> np.ndarray:
    """Which rows open a curve; ``before`` ends with the row in front of the first one."""
    opens = np.zeros(len(part), bool)
    for c in ("cell_id", "cycle"):
        x = part[c].to_numpy()
        other = np.r_[True, x[1:] != x[:-1]]
        if before is not None:
            other[0] = x[0] != before[c].iloc[-1]
        opens |= other
    return opens
