"""The cohort sweep on odd tables."""

import pytest

from voltloom.operators import coverage, evaluate

ROWS = "cell_id string, cohort string, cycle int, avg_temp double, y double"


def table(spark, cohorts, cells=2):
    rows = [(f"{c}{k}", c, t, 20.0 + t % 5 + i, 0.01 * t + 0.002 * i + 0.001 * (t * 7 % 3))
            for i, c in enumerate(cohorts) for k in range(cells) for t in range(12)]
    return spark.createDataFrame(rows + [("x0", "x", 1, 20.0, 0.1), ("a9", "a", 1, None, None), ("n0", None, 1, 20.0, 0.1)], ROWS)


def test_every_size_is_swept_and_small_cohorts_are_left_out(spark):
    points = coverage.coverage_sweep(table(spark, "abcde"), [evaluate.AGE_LINEAR], "y", repeats=2).collect()
    assert sorted((r["n_cohorts"], r["repeat"]) for r in points) == [(3, 0), (3, 1), (4, 0), (4, 1), (5, 0)]
    assert all(r["n_cells"] == 2 * r["n_cohorts"] and r["n_rows"] == 24 * r["n_cohorts"] for r in points)
    assert all(r["gap"] == pytest.approx(r["loco_r2"] - r["lobo_r2"]) and r["lobo_r2"] > 0.9 for r in points)


def test_two_cohorts_cannot_be_swept(spark):
    assert coverage.coverage_sweep(table(spark, "ab"), [evaluate.AGE_LINEAR], "y").collect() == []
