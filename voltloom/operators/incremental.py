"""Incremental capacity: dQ/dV of smoothed curves, and the features of its peak.

Each curve is put on an even grid of volts, so it holds a bounded number of
points, whatever the sampling rate: one grouped row per curve. The convolution
runs on batches of curves in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.operators.partial import on_voltage_grid

LOW_V, HIGH_V, POINTS = 2.0, 4.2, 1000
WINDOW, DEGREE = 51, 3
#: Slopes that agree in so many decimals are one peak's; the lowest voltage is named.
PEAK_DECIMALS = 9
#: A curve's samples are few bytes and much work: they are dealt out to so many tasks, which adaptive execution keeps.
CURVE_PARTITIONS = 192


def smoothing_weights(window: int = WINDOW, degree: int = DEGREE) -> np.ndarray:
    """Row r holds the weights that evaluate, at place r, the polynomial fitted to a window of values.

    The middle row is the convolution of inner points; the others serve the
    points near a curve's ends, which use the first or the last whole window.
    """
    place = np.linspace(-1.0, 1.0, window)
    basis, _ = np.linalg.qr(np.vander(place, degree + 1, increasing=True))
    return basis @ basis.T


def _slopes(step: float, window: int, degree: int):
    """Slopes of the convolution of a batch of curves; products are added from a window's first to its last."""
    weights = smoothing_weights(window, degree)

    @F.pandas_udf("array<double>")
    def slopes(values: pd.Series) -> pd.Series:
        def one(q):
            if len(q) < window:
                return None
            q, at = np.asarray(q, dtype=float), np.arange(len(q))
            start = np.clip(at - window // 2, 0, len(q) - window)
            y = np.zeros(len(q))
            for k in range(window):
                y = y + q[start + k] * weights[at - start, k]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(q) - 1)
            return (y[after] - y[before]) / ((after - before) * step)
        return pd.Series([one(q) for q in values], dtype=object)

    return slopes


def incremental_capacity(curves: DataFrame, cycles: Sequence[int] | None = None, low: float = LOW_V, high: float = HIGH_V,
                         points: int = POINTS, window: int = WINDOW, degree: int = DEGREE) -> DataFrame:
    """(cell_id, cycle, n_grid, first_volt, volt_step, dqdv): an array of slopes per curve.

    ``dqdv`` is null where fewer grid points than a window lie inside the
    curve's own range. ``cycles`` restricts the curves read; None takes all.
    Samples without voltage or charge take no part.
    """
    step = (high - low) / (points - 1)
    read = curves.where("voltage_v IS NOT NULL AND capacity_ah_curve IS NOT NULL")
    if cycles is not None:
        read = read.where(F.col("cycle").isin(*cycles))
    read = read.repartition(CURVE_PARTITIONS, "cell_id", "cycle")
    one = on_voltage_grid(read, low, high, points).groupBy("cell_id", "cycle", "_g").agg(F.max("_q").alias("_q"))
    rows = one.groupBy("cell_id", "cycle").agg(
        F.sort_array(F.collect_list(F.struct("_g", "_q"))).alias("_s"), F.count(F.lit(1)).cast("int").alias("n_grid"))
    smooth = rows.withColumn("dqdv", _slopes(step, window, degree)(F.col("_s._q")))
    return smooth.select("cell_id", "cycle", "n_grid", (low + F.get("_s", F.lit(0))["_g"] * step).alias("first_volt"),
                         F.lit(step).alias("volt_step"), "dqdv")


def peak_features(slopes: DataFrame) -> DataFrame:
    """(cell_id, cycle, n_grid, ica_peak_height, ica_peak_voltage, ica_area) of ``incremental_capacity``."""
    d, h = F.col("dqdv"), F.col("volt_step")
    ranked = F.transform(d, lambda x, i: F.struct(F.round(F.abs(x), PEAK_DECIMALS).alias("size"), (-i).alias("back"), x.alias("slope")))
    peak = slopes.withColumn("_peak", F.array_max(ranked))
    whole = F.aggregate(d, F.lit(0.0), lambda total, x: total + F.abs(x))
    ends = (F.abs(F.get(d, F.lit(0))) + F.abs(F.element_at(d, -1))) / 2.0
    return peak.select(
        "cell_id", "cycle", "n_grid", F.col("_peak.slope").alias("ica_peak_height"),
        (F.col("first_volt") - F.col("_peak.back") * h).alias("ica_peak_voltage"), ((whole - ends) * h).alias("ica_area"))
