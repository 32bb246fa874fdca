"""Few-cell calibration against models refitted from rows, and on odd tables."""

import numpy as np
import pytest

from voltloom.operators import evaluate, few_cells

ROWS = "cell_id string, cohort string, cycle int, avg_temp double, y double"


def rows_of(cohorts="abcd", cells=4, seed=3):
    rng = np.random.default_rng(seed)
    return [(f"{c}{k}", c, t, 20.0 + 3 * i + t % 4, float(0.01 * t * (1 + 0.2 * i) + 0.05 * i + 0.002 * k + rng.normal(0, 0.001)))
            for i, c in enumerate(cohorts) for k in range(cells) for t in range(1, 13)]


def by_rows(rows, picks, model):
    """R2 of each arm in each draw, refitted from the rows."""
    data = {}
    for cell, cohort, cycle, temp, y in rows:
        data.setdefault((cohort, cell), []).append((cycle if model == "age_linear" else temp, y))
    out = {}
    for (cohort, k, draw), (own, foreign) in picks.items():
        def stack(keep):
            got = [v for key, v in data.items() if keep(key)]
            return np.array([p for v in got for p in v]).T
        tx, ty = stack(lambda c: c[0] != cohort)
        cx, cy = stack(lambda c: c in own)
        hx, hy = stack(lambda c: c[0] == cohort and c not in own)
        fx, fy = stack(lambda c: c in foreign)
        raw = np.polyfit(tx, ty, 1)
        at = lambda q: np.polyval(raw, q)
        mine, other = np.polyfit(at(cx), cy, 1), np.polyfit(at(fx), fy, 1)
        local, pooled = np.polyfit(cx, cy, 1), np.polyfit(np.r_[tx, cx], np.r_[ty, cy], 1)
        pred = {"raw": at(hx), "affine": np.polyval(mine, at(hx)), "offset_only": at(hx) + (cy - at(cx)).mean(),
                "local_fit": np.polyval(local, hx), "pooled": np.polyval(pooled, hx), "cell_mean": np.full_like(hy, cy.mean()),
                "shuffled": np.polyval(other, at(hx))}
        out[cohort, k, draw] = {a: 1 - ((hy - p) ** 2).sum() / ((hy - ty.mean()) ** 2).sum() for a, p in pred.items()}
    return out


def picks_of(spark, rows):
    cells = spark.createDataFrame(sorted({(r[1], r[0]) for r in rows}), "cohort string, cell_id string")
    numbered, cohorts = few_cells.numbered_cells(cells)
    name = {r["_g"]: (r["cohort"], r["cell_id"]) for r in numbered.collect()}
    assert sorted(name) == list(range(len(name)))
    picks = {}
    for r in few_cells.drawn_cells(cohorts, draws=5).collect():
        picks.setdefault((r["cohort"], r["k"], r["draw"]), (set(), set()))[0 if r["own"] else 1].add(name[r["_g"]])
    return picks


def test_draws_take_different_cells_of_the_right_cohorts(spark):
    picks = picks_of(spark, rows_of())
    assert len(picks) == 4 * 2 * 5
    for (cohort, k, _), (own, foreign) in picks.items():
        assert len(own) == len(foreign) == k
        assert all(c == cohort for c, _ in own) and all(c != cohort for c, _ in foreign)


def test_floyds_draws_are_even(spark):
    from pyspark.sql import functions as F
    sets = spark.range(6000).select(few_cells.without_repeats(F.lit(2).cast("bigint"), F.lit(5).cast("bigint"), 1, F.col("id")).alias("s"))
    count = {}
    for r in sets.collect():
        assert len(set(r["s"])) == 2
        count[frozenset(r["s"])] = count.get(frozenset(r["s"]), 0) + 1
    assert len(count) == 10 and all(450 < n < 750 for n in count.values())
    none = spark.range(1).select(few_cells.without_repeats(F.lit(2).cast("bigint"), F.lit(1).cast("bigint"), 1, F.col("id")).alias("s"))
    assert none.first()["s"] is None


@pytest.mark.parametrize("model", [evaluate.AGE_LINEAR, evaluate.ols("temp", ["avg_temp"])], ids=lambda m: m.name)
def test_every_arm_equals_models_refitted_from_rows(spark, model):
    rows = rows_of()
    want = by_rows(rows, picks_of(spark, rows), model.name)
    got = few_cells.few_cell_draws(spark.createDataFrame(rows, ROWS), model, "y", draws=5).collect()
    assert len(got) == len(want)
    for r in got:
        for arm, value in want[r["cohort"], r["k"], r["draw"]].items():
            assert r[arm] == pytest.approx(value, rel=1e-6, abs=1e-6), arm


def test_small_cohorts_nulls_and_empty_tables(spark):
    odd = [("z0", "z", 1, 20.0, 0.1), ("z0", "z", 2, 20.0, 0.2), ("n", None, 1, 20.0, 0.1), (None, "a", 1, 20.0, 0.1), ("a0", "a", 1, None, None)]
    frame = spark.createDataFrame(rows_of("ab", 2) + odd, ROWS)
    got = {(r["cohort"], r["k"]): r for r in few_cells.few_cell_calibration(frame, [evaluate.AGE_LINEAR], "y", draws=3).collect()}
    assert sorted(got) == [("a", 1), ("b", 1)] and got["a", 1]["n_cells"] == 2
    alone = few_cells.few_cell_calibration(spark.createDataFrame(rows_of("a", 3), ROWS), [evaluate.AGE_LINEAR], "y", draws=2).collect()
    assert {r["k"] for r in alone} == {1, 2} and all(r["raw"] is None and r["shuffled"] is None for r in alone)
    folds = few_cells.few_cell_calibration(frame.where("false"), [evaluate.AGE_LINEAR], "y")
    assert folds.count() == 0 and few_cells.few_cell_risk(folds).count() == 0 and few_cells.few_cell_paired(folds).count() == 0


def test_a_shifted_cohort_is_mended_by_its_own_cells_only(spark):
    rows = [(f"{c}{k}", c, t, 20.0, 0.01 * t + (0.5 if c == "d" else 0.0) + 1e-4 * (k + t % 3))
            for c in "abcd" for k in range(4) for t in range(1, 13)]
    folds = few_cells.few_cell_calibration(spark.createDataFrame(rows, ROWS), [evaluate.AGE_LINEAR], "y")
    d = folds.where("cohort = 'd' AND k = 1").first()
    assert d["affine"] > 0.99 and d["offset_only"] > 0.99 and d["local_fit"] > 0.99 and d["raw"] < 0.5 and d["shuffled"] < 0.5
    paired = {r["rival"]: r for r in few_cells.few_cell_paired(folds).collect()}
    assert paired["raw"]["n_folds"] == 8 and paired["raw"]["verdict"] == "better" and paired["raw"]["wins"] == 8
    risk = {r["arm"]: r for r in few_cells.few_cell_risk(folds).collect()}
    assert risk["affine"]["n_folds"] == 8 and risk["affine"]["worst"] > 0.9 and risk["affine"]["below_zero"] == 0
