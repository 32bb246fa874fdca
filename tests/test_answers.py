"""Monotone fits, sibling lives, constant-current runs and the label join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators.answers import log_facts, stage_availability
from voltloom.operators.extract import constant_current_runs
from voltloom.operators.monotone import cell_signal, pooled
from voltloom.operators.priors import sibling_fit
from voltloom.operators.truth import label_join


def max_min(y, w):
    """Isotonic regression by its max-min formula."""
    n = len(y)
    mean = {(a, b): np.dot(y[a:b + 1], w[a:b + 1]) / w[a:b + 1].sum() for a in range(n) for b in range(a, n)}
    return np.array([max(min(mean[a, b] for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_pooled_equals_the_max_min_formula():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 17):
        y, w = rng.normal(size=n).round(1), rng.integers(1, 4, n).astype(float)
        assert np.allclose(pooled(y, w), max_min(y, w))
    assert len(pooled(np.zeros(0), np.zeros(0))) == 0


def test_signal_of_a_falling_series_and_of_refused_cells(spark):
    rng = np.random.default_rng(5)
    rows = [("down", c, float(-0.01 * c + rng.normal(0, 0.02))) for c in range(30) for _ in range(2)]
    rows += [("few", c, float(c)) for c in range(9)] + [("flat", c, 1.0) for c in range(20)] + [("none", 1, None)]
    got = cell_signal(spark.createDataFrame(rows, "cell_id string, cycle int, y double"), "y").collect()
    assert [r["cell_id"] for r in got] == ["down"]
    y = np.array([r[2] for r in rows if r[0] == "down"])
    means = y.reshape(30, 2).mean(1)
    trend = -max_min(-means, np.full(30, 2.0))
    assert got[0]["n"] == 60
    assert got[0]["signal_ss"] == pytest.approx(2 * ((trend - y.mean()) ** 2).sum())
    assert got[0]["noise_ss"] == pytest.approx(((y - np.repeat(trend, 2)) ** 2).sum())


def test_sibling_fit_equals_refitting_without_each_cell(spark):
    rng = np.random.default_rng(9)
    rate = np.exp(rng.normal(-6, 0.4, 12))
    life = np.exp(-1.0 - 0.9 * np.log(rate) + rng.normal(0, 0.1, 12))
    rows = [(True, float(l), float(r)) for l, r in zip(life, rate)] + [(False, 10.0, 0.1), (True, 500.0, -0.1)]
    got = sibling_fit(spark.createDataFrame(rows, "crossed boolean, life double, early_rate double")).first()
    x, y, left = np.log(rate), np.log(life), []
    for i in range(12):
        b, a = np.polyfit(np.delete(x, i), np.delete(y, i), 1)
        left.append(y[i] - a - b * x[i])
    b, a = np.polyfit(x, y, 1)
    assert (got["a"], got["b"], got["q10"]) == pytest.approx((a, b, np.quantile(left, 0.1)))
    assert got["n"] == 12 and got["median_life"] == pytest.approx(np.median([*life, 500.0]))


def test_runs_are_cut_at_rate_steps_and_refused_with_a_reason(spark):
    rows = []
    for cycle, amps in ((1, [-1.0] * 5 + [-2.0] * 7), (2, [1.0] * 6), (3, [-1.0] * 3), (4, [-1.0, -1.0, 0.0] * 4)):
        rows += [("a", cycle, float(t), t, i, 4.0 - 0.05 * t, 0.5 + t) for t, i in enumerate(amps)]
    runs = constant_current_runs(spark.createDataFrame(
        rows, "cell_id string, cycle int, test_time_s double, seq int, current_a double, voltage_v double, "
              "capacity_ah_counter double"), min_points=5)
    assert {r["cycle"]: r["refusal"] for r in runs.cycles.collect()} == {
        1: "", 2: "no discharge samples", 3: "too few discharge samples in the cycle", 4: "longest run too short"}
    kept = runs.curves.orderBy("test_time_s").collect()
    assert [r["test_time_s"] for r in kept] == [float(t) for t in range(5, 12)]
    assert kept[0]["capacity_ah_curve"] == 0.0 and kept[0]["run_current_a"] == -2.0


def test_labels_join_on_the_cyclers_number(spark):
    labels = spark.createDataFrame([("a", c, 2.0 - 0.1 * c) for c in range(8)] + [("a", 9, None)],
                                   "cell_id string, cycler_cycle int, capacity_ah double")
    numbers = spark.createDataFrame([("a", 1, 0), ("a", 2, 7), ("a", 3, 9), ("a", 4, 50)],
                                    "cell_id string, cycle int, cycler_cycle int")
    readings = numbers.select("cell_id", "cycle", F.lit(0.9).alias("soh"))
    got = {r["cycle"]: r["soh_true"] for r in label_join(readings, numbers, labels).collect()}
    assert got == {1: pytest.approx(2.0 / 1.8), 2: pytest.approx(1.3 / 1.8), 3: None}


def test_stages_name_the_channels_they_lack(spark):
    rows = [("a", 0.0, 1.0, 20.0, 50.0), ("b", 0.0, 1.0, None, 50.0), ("c", 0.0, 1.0, None, None)]
    log = spark.createDataFrame(rows, "cell_id string, test_time_s double, current_a double, temperature_c double, soc double")
    got = {r["cell_id"]: (r["available"], r["missing"]) for r in stage_availability(log_facts(log)).collect()}
    assert got == {"a": (True, ""), "b": (False, "temperature_c"), "c": (False, "temperature_c, soc")}
