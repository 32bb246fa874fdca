"""Phases against a sample-by-sample brute force, at several chunk lengths."""

import numpy as np
import pytest

from voltloom.operators import curves, phases, soh


def brute(current, times, threshold=0.5, least=3):
    labels = ["rest" if i is None or abs(i) < threshold else "discharge" if i < 0 else "charge" for i in current]
    runs = []
    for p, lab in enumerate(labels):
        if runs and runs[-1][0] == lab:
            runs[-1][2] = p
        else:
            runs.append([lab, p, p])
    kept, merged = None, []
    for n, (lab, a, b) in enumerate(runs):
        if n == 0 or b - a + 1 >= least:
            kept = lab
        if merged and merged[-1][0] == kept:
            merged[-1][2] = b
        else:
            merged.append([kept, a, b])
    out = []
    for kind, a, b in merged:
        good = [(times[p], abs(current[p])) for p in range(a, b + 1) if current[p] is not None]
        ah = sum((x1 + x0) / 2 * (t1 - t0) for (t0, x0), (t1, x1) in zip(good, good[1:])) / 3600
        out.append((kind, times[a], times[b], b - a + 1, ah))
    return out


def noisy_series(seed, n=400):
    rng = np.random.default_rng(seed)
    level = np.repeat(rng.choice([-1.5, 0.0, 2.0], size=n // 8), 8)
    current = [None if rng.random() < 0.05 else 0.1 if rng.random() < 0.1 else float(c) for c in level]
    return current, np.cumsum(rng.integers(1, 40, size=len(current))).astype(float).tolist()


@pytest.mark.parametrize("chunk_s,limit", [(45.0, None), (600.0, 5), (1e9, None)])
def test_segment_matches_brute_force(spark, chunk_s, limit):
    rows, want = [], {}
    for seed in range(4):
        current, times = noisy_series(seed)
        want[f"c{seed}"] = brute(current, times)
        rows += [(f"c{seed}", t, i, 3.5) for t, i in zip(times, current)]
    df = spark.createDataFrame(rows, "cell_id string, test_time_s double, current_a double, voltage_v double")
    got = phases.segment(phases.Log(df, chunk_s=chunk_s), limit=limit).table.toPandas()
    for cell, expected in want.items():
        mine = got[got["cell_id"] == cell].sort_values("phase_no")
        assert mine["phase_no"].tolist() == list(range(1, len(expected) + 1))
        assert mine["kind"].tolist() == [e[0] for e in expected]
        assert mine["start_time_s"].tolist() == [e[1] for e in expected]
        assert mine["n_samples"].tolist() == [e[3] for e in expected]
        assert mine["charge_ah"].tolist() == pytest.approx([e[4] for e in expected])


def test_planted_fade_is_recovered(spark):
    """A cell whose capacity falls 20 % over 40 discharges of the same curve shape."""
    rows, t = [], 0.0
    for n in range(40):
        size = 1.0 - 0.2 * n / 39
        for kind, count, amps in (("rest", 5, 0.0), ("dis", 30, -1.0), ("rest", 5, 0.0), ("chg", 30, 1.0)):
            for k in range(count):
                t += 60.0 * (size if kind in ("dis", "chg") else 1.0)
                v = {"rest": 4.2, "dis": 4.1 - 0.9 * k / 29, "chg": 3.2 + 0.9 * k / 29}[kind]
                rows.append(("c", t, amps, v if kind != "rest" or k else 4.2))
    df = spark.createDataFrame(rows, "cell_id string, test_time_s double, current_a double, voltage_v double")
    cut = phases.segment(phases.Log(df, chunk_s=900.0))
    charges = curves.charges_by_cycle(curves.discharge_curves(cut), curves.discharge_steps(cut))
    table = soh.field_gates(soh.soh_table(charges), cut.discharges)
    report = soh.current_soh(table, cut.discharges).first()
    assert report["refusal"] == ""
    assert report["soh"] == pytest.approx(0.83, abs=0.02)


def test_low_step_is_screened_against_past_steps_only(spark):
    values = [0.1, 0.11, 0.01, 0.12, None, 0.02, 0.13, 0.14, 0.015, 0.2]
    df = spark.createDataFrame([("c", n + 1, v) for n, v in enumerate(values)], "cell_id string, cycle int, r_step_ohm double")
    out = curves.screen_steps(df).orderBy("cycle").toPandas()["r_ok_ohm"].tolist()
    want = [0.1, 0.11, None, 0.12, None, None, 0.13, 0.14, None, 0.2]
    assert [None if v != v or v is None else v for v in out] == want
