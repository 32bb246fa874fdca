"""Non-increasing voltages, many curves in a batch and curves cut by batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import monotone


def fitted(points):
    """The nearest non-increasing series by its max-min form, equal charges averaged."""
    q = sorted({p[0] for p in points})
    n = np.array([sum(p[0] == x for p in points) for x in q], float)
    z = np.array([-np.mean([p[1] for p in points if p[0] == x]) for x in q])
    mean = lambda a, b: (z[a:b + 1] * n[a:b + 1]).sum() / n[a:b + 1].sum()
    return {x: -max(min(mean(a, b) for b in range(i, len(q))) for a in range(i + 1)) for i, x in enumerate(q)}


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_curves_of_all_lengths(spark, batch):
    rows, noise = [], np.random.default_rng(3)
    for cell in ("a", "b"):
        for cycle in range(1, 12):
            for k in range(cycle * 2):
                rows.append((cell, cycle, float(k), k, 4.0 - 0.05 * k + float(noise.normal(0, 0.1)), float(k // 2 if cycle % 3 == 0 else k)))
    rows += [("a", 3, 90.0, 90, None, 1.0), ("b", 4, 90.0, 90, float("nan"), 1.0), ("b", 5, 90.0, 90, 3.9, None), ("c", 1, 0.0, 0, None, None)]
    frame = spark.createDataFrame(rows, "cell_id string, cycle int, test_time_s double, seq int, voltage_v double, capacity_ah_curve double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = monotone.falling_voltage(frame).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    good = [r for r in rows if r[4] is not None and r[4] == r[4] and r[5] is not None]
    assert sorted((r.cell_id, r.cycle, r.seq) for r in got) == sorted((r[0], r[1], r[3]) for r in good)
    for r in got:
        want = fitted([(x[5], x[4]) for x in good if x[:2] == (r.cell_id, r.cycle)])
        assert r.voltage_v == pytest.approx(want[r.capacity_ah_curve])


def test_no_call_for_each_curve(spark):
    frame = spark.range(1).select(F.lit("a").alias("cell_id"), F.lit(1).alias("cycle"), F.lit(0.0).alias("test_time_s"), F.lit(0).alias("seq"),
                                  F.lit(4.0).alias("voltage_v"), F.lit(0.0).alias("capacity_ah_curve"))
    assert "FlatMapGroups" not in monotone.falling_voltage(frame)._jdf.queryExecution().toString()
