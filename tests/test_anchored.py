"""Anchored overpotential, envelopes and horizon folds against brute force on small tables."""

import numpy as np
import pytest

from voltloom.operators import anchored, cohorts
from voltloom.plans import horizons

LOG = "cell_id string, cycle int, capacity_ah_curve double, voltage_v double"


def curve_rows():
    rng = np.random.default_rng(4)
    rows = []
    for cell in "ab":
        for cycle in range(1, 9):
            q = np.sort(rng.uniform(0.0, 1.0, 40))
            q[0], q[-1] = 0.0, 1.0 - 0.01 * cycle
            rows += [(cell, cycle, float(x), float(4.1 - 0.5 * x - 0.01 * cycle)) for x in q if x <= q[-1] or x == q[-1]]
    rows += [("a", 9, 0.0, 4.0), ("a", 9, 0.9, 3.5), ("a", 10, None, 4.0), ("a", 11, 0.3, None), ("c", 1, 0.0, 4.0), ("b", 9, 0.5, 3.9)]
    return rows


def expected(rows, base, rest):
    out = {}
    for cell in sorted({r[0] for r in rows}):
        cycles = sorted({r[1] for r in rows if r[0] == cell})
        block = {c: sorted((q, v) for k, n, q, v in rows if (k, n) == (cell, c) and q is not None and v is not None) for c in cycles}
        totals = [max((q for k, n, q, _ in rows if (k, n) == (cell, c) and q is not None), default=np.nan) for c in cycles[:5]]
        ref = np.nanmedian(totals)
        if not ref > 0:
            continue
        grid = np.linspace(0.05, 0.15, 21) * ref
        on = {c: np.interp(grid, *np.array(b).T) for c, b in block.items() if len(b) >= 3 and b[0][0] <= grid[0] and b[-1][0] >= grid[-1]}
        first = sorted(on)[:5]
        levels = [base[cell, c] for c in first if (cell, c) in base]
        if not levels:
            continue
        floor = np.median([rest[cell, c] for c in first]) - 0.03
        middle = np.median([on[c] for c in first], axis=0)
        for c in cycles:
            fine = c in on and rest.get((cell, c), -1) >= floor
            out[cell, c] = np.median(middle - on[c]) if fine else None, np.median(levels)
    return out


def test_anchored_equals_interpolation(spark):
    rows = curve_rows()
    base = {(k, c): 0.01 * c for k in "ab" for c in range(1, 9)}
    rest = {(k, c): 4.2 - (0.1 if c == 7 else 0.0) for k in "ab" for c in range(1, 9)}
    got = anchored.anchored_overpotential(
        spark.createDataFrame(rows, LOG),
        spark.createDataFrame([(*k, v) for k, v in base.items()], "cell_id string, cycle int, ir_drop_v double"),
        spark.createDataFrame([(*k, v) for k, v in rest.items()], "cell_id string, cycle int, v_rest_v double")).collect()
    want = expected(rows, base, rest)
    assert {(r.cell_id, r.cycle) for r in got} == set(want)
    for r in got:
        offset, level = want[r.cell_id, r.cycle]
        if offset is None:
            assert r.anchor_offset_v is None and r.ir_drop_v is None
        else:
            assert r.anchor_offset_v == pytest.approx(offset) and r.ir_drop_v == pytest.approx(level + offset)
    assert sum(r.anchor_offset_v is not None for r in got) == 14


def test_anchored_of_nothing(spark):
    assert anchored.anchored_overpotential(spark.createDataFrame([], LOG)).count() == 0


def test_channels_of_odd_texts(spark):
    samples = spark.createDataFrame(
        [("f", "003", 0.0, 1.0, 4.0, 0.0, 1), ("f", "003", 9.0, 1.0, 3.9, 2.0, 1), ("f", "003", 10.0, None, 3.9, 5.0, 1),
         ("f", "004", 0.0, 1.0, 4.0, 1.0, 1), ("g", "003", 0.0, 1.0, 4.0, None, 1)],
        "file string, channel string, time_s double, current_a double, voltage_v double, discharge_ah double, cycle int")
    info = spark.createDataFrame([("f", "CH-3 PLN - 12, ch - 9 pln-7"), ("g", "ch-03 PLN-1"), ("f", None), ("f", "no item")],
                                 "file string, text string")
    got = sorted((r.cell_id, r.time_s, r.soc, r.capacity_ah) for r in anchored.scan_characterisation(samples, info).collect())
    assert got == [("PLN_001", 0.0, None, None), ("PLN_012", 0.0, 100.0, None), ("PLN_012", 9.0, 0.0, 2.0)]


def test_too_many_cohorts_are_refused(spark, monkeypatch):
    seen = spark.createDataFrame([("x", 1.0), ("y", 50.0), ("z", None)], "cell_id string, t double")
    bounds = spark.createDataFrame([("p", "t", 0.0, 2.0, 5, 1), ("q", "t", 1.0, 9.0, 7, 1)],
                                   "cohort string, feature string, low double, high double, n_rows long, n_cells long")
    got = {r.cell_id: (r.cohort, r.nearest, r.n_violations, r.violations, r.n_matches)
           for r in cohorts.identify_cohorts(seen, bounds, ["t"]).collect()}
    assert got == {"x": ("q", "q", 0, "", 2), "y": (None, "q", 1, "t", 0), "z": (None, "q", 1, "t", 0)}
    monkeypatch.setattr(cohorts, "MAX_COHORTS", 1)
    with pytest.raises(Exception, match="more than 1 cohorts"):
        cohorts.identify_cohorts(seen, bounds, ["t"]).collect()


def test_horizon_folds_refuse_with_reasons(spark):
    rows = [(1, c, k, n, float(x), 0.1 + 0.02 * x + s) for c, k, s in (("a", "p", 0.0), ("b", "p", 0.0), ("c", "q", 1.0))
            for n, x in enumerate(range(20, 28))] + [(1, "d", "p", 1, 22.0, 0.54)]
    got = {r.cell_id: r for r in horizons.horizon_folds(spark.createDataFrame(
        rows, "horizon int, cell_id string, cohort string, cycle int, x double, y double")).collect()}
    assert got["c"].refusal == "no other battery of the cohort" and got["d"].refusal == "too few rows"
    assert got["a"].refusal == "" and got["a"].mae == pytest.approx(0.0, abs=1e-9) and got["a"].slope == pytest.approx(0.02)
