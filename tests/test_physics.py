"""The fade law: exact recovery, odd rows, refusals."""

import math

import numpy as np
import pytest

from voltloom.operators import evaluate, physics

ROWS = "cell_id string, cohort string, cycle int, avg_temp double, fade double"


def law(t, n, ea=40.0, z=0.6, ln_a=9.0):
    return math.exp(ln_a - ea * 1000 / 8.314462618 / (t + 273.15)) * n ** z


def table(spark, temps, noise=0.0, extra=()):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", f"p{i % 3}", n, float(t + n % 4), law(t + n % 4, n) * math.exp(noise * rng.normal()))
            for i, t in enumerate(temps) for n in range(1, 15)]
    return spark.createDataFrame(rows + list(extra), ROWS)


def folds(frame, confound=None):
    got = physics.cross_validate_fade_law(frame, "fade", "cell_id", "LOBO", confound=confound)
    return {r["held_out"]: r for r in got.collect()}


def test_the_law_is_recovered_exactly(spark):
    odd = [("c0", "p0", 0, 20.0, 0.5), ("c0", "p0", 3, -300.0, 0.5), ("c0", "p0", 4, None, 0.5), ("c1", "p1", 4, 25.0, -0.1)]
    got = folds(table(spark, [5, 15, 25, 35, 45], extra=odd), evaluate.AGE_LINEAR)
    assert set(got) == {f"c{i}" for i in range(5)}
    assert all(r["error"] is None and r["activation_kj_per_mol"] == pytest.approx(40.0, rel=1e-6) for r in got.values())
    assert got["c2"]["r2_vs_global_mean"] == pytest.approx(1.0, abs=1e-9)
    assert got["c0"]["n_test"] == 16 and got["c0"]["n_used"] == 4 * 14 and got["c0"]["mae"] > 0  # two rows get the mean


def test_folds_equal_least_squares(spark):
    frame = table(spark, [5, 15, 25, 35], noise=0.2)
    rows = [r.asDict() for r in frame.collect()]
    got = folds(frame)
    for cell, r in got.items():
        train, test = [[q for q in rows if (q["cell_id"] == cell) == held] for held in (False, True)]
        x = lambda q: [1.0, 1 / (q["avg_temp"] + 273.15), math.log(q["cycle"])]
        c = np.linalg.lstsq(np.array([x(q) for q in train]), np.log([q["fade"] for q in train]), rcond=None)[0]
        err = [q["fade"] - math.exp(np.dot(c, x(q))) for q in test]
        assert r["mae"] == pytest.approx(np.mean(np.abs(err)), rel=1e-6)
        assert r["activation_kj_per_mol"] == pytest.approx(-c[1] * 8.314462618 / 1000, rel=1e-5)


def test_one_temperature_is_refused_and_too_few_rows_fall_back(spark):
    flat = spark.createDataFrame([(f"c{i}", f"p{i}", n, 25.0, 0.01 * n) for i in range(3) for n in range(1, 13)], ROWS)
    assert {r["error"] for r in folds(flat).values()} == {"fit is not determined"}
    bare = spark.createDataFrame([(f"c{i}", f"p{i}", n, 25.0, 0.0) for i in range(3) for n in range(1, 13)], ROWS)
    assert all(r["error"] is None and r["n_used"] == 0 and r["mae"] == 0 for r in folds(bare).values())
    assert folds(flat.where("false")) == {}
