"""Incremental capacity against polynomial fits in numpy."""

import numpy as np

from voltloom.operators import incremental


def brute(v, q, points=1000, window=51):
    grid = np.linspace(2.0, 4.2, points)
    order = np.argsort(v)
    v, q = v[order], q[order]
    inside = (grid >= v[0]) & (grid <= v[-1])
    x, y = grid[inside], np.interp(grid, v, q)[inside]
    if len(x) < window:
        return None
    smooth = np.empty(len(x))
    for i in range(len(x)):
        start = min(max(i - window // 2, 0), len(x) - window)
        k = np.arange(window) - window // 2
        smooth[i] = np.polyval(np.polyfit(k, y[start:start + window], 3), i - start - window // 2)
    d = np.gradient(smooth, x)
    peak = np.argmax(np.round(np.abs(d), incremental.PEAK_DECIMALS))
    return d[peak], x[peak], np.sum((np.abs(d[1:]) + np.abs(d[:-1])) / 2 * np.diff(x)), len(x)


def test_peaks_equal_polynomial_fits(spark):
    rng = np.random.default_rng(3)
    curves = {}
    for c in range(3):
        v = np.sort(rng.uniform(2.9 + 0.1 * c, 4.1, 300))[::-1]
        curves["A", c] = v, 2.0 / (1 + np.exp((v - 3.6) * (8 + c))) + rng.normal(0, 1e-3, 300)
    curves["B", 0] = np.array([3.55, 3.5]), np.array([0.0, 0.1])  # fewer volts than a window
    rows = [(cell, c, float(t), float(v), float(q)) for (cell, c), (vs, qs) in curves.items() for t, (v, q) in enumerate(zip(vs, qs))]
    rows += [("A", 0, 999.0, None, 1.0), ("A", 0, 999.5, 3.3, None), ("C", 0, 1.0, 3.3, 0.1)]
    df = spark.createDataFrame(rows, "cell_id string, cycle int, test_time_s double, voltage_v double, capacity_ah_curve double")
    got = {(r["cell_id"], r["cycle"]): r for r in incremental.peak_features(incremental.incremental_capacity(df)).collect()}
    assert set(got) == set(curves)
    for key, (v, q) in curves.items():
        want, r = brute(v, q), got[key]
        if want is None:
            assert r["ica_peak_height"] is None and r["ica_area"] is None
        else:
            np.testing.assert_allclose([r["ica_peak_height"], r["ica_peak_voltage"], r["ica_area"], r["n_grid"]], want, rtol=1e-6)
    some = incremental.incremental_capacity(df, cycles=(1,)).select("cell_id", "cycle").collect()
    assert [tuple(r) for r in some] == [("A", 1)]
