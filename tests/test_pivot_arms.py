"""The samples behind set_pivot_arms are labelled once, and runs and brackets need no struct comparisons."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.catalog import CATALOG
from voltloom.operators import curves, phases
from voltloom.operators.ordered import near_window, running

LOG = "cell_id string, test_time_s double, seq int, current_a double, voltage_v double, temperature_c double"


def odd_log(spark, cells=3, n=300):
    """Null and small currents inside every label, null volts, equal times told apart by seq."""
    rng = np.random.default_rng(7)
    rows = []
    for c in range(cells):
        level = np.repeat(rng.choice([-1.5, 0.0, 2.0], size=n // 6), 6)
        t = np.cumsum(rng.integers(0, 40, size=len(level))).astype(float)
        rows += [(f"c{c}", float(x), k, None if rng.random() < 0.15 else 0.1 if rng.random() < 0.1 else float(i),
                  None if rng.random() < 0.1 else float(4.0 - 0.05 * (k % 12)), 20.0 + k % 3)
                 for k, (x, i) in enumerate(zip(t, level))]
    return spark.createDataFrame(rows, LOG)


def duty_table(spark, folder, suppliers=6, lines=260):
    start = dt.datetime(1995, 1, 2)
    rows = [(s * 1000 + k, k % 50, s, k % 7, float(k % 50), 100.0 + k, (k % 11) / 100.0, (k % 9) / 100.0, "N", "O",
             start + dt.timedelta(days=(k * 37 + s) % 2400)) for s in range(suppliers) for k in range(lines)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                "l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_the_log_is_labelled_once(spark, tmp_path, monkeypatch):
    folder, calls, own = duty_table(spark, tmp_path), [], phases.Log.labelled
    monkeypatch.setattr(phases.Log, "labelled", lambda log: calls.append(1) or own(log))
    got = CATALOG.builds["set_pivot_arms"](spark, folder)
    assert got.count() > 0 and got.where("plain IS NOT NULL").count() > 0
    assert len(calls) == 1


@pytest.mark.parametrize("chunk_s", [90.0, 1e9])
def test_stored_samples_give_the_same_curves(spark, chunk_s):
    log = phases.Log(odd_log(spark), chunk_s=chunk_s)
    once, twice = phases.segment(log, store=True), phases.segment(log)
    assert rows(once.table) == rows(twice.table)
    assert rows(curves.discharge_curves(once)) == rows(curves.discharge_curves(twice))
    assert once.discharges is once.discharges


@pytest.mark.parametrize("chunk_s", [90.0, 1e9])
def test_partial_runs_match_their_samples(spark, chunk_s):
    s = phases.Log(odd_log(spark), chunk_s=chunk_s).labelled()
    made = phases.partial_runs(s)
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["cell_id"], r["chunk"], r["run"]): r for r in made.collect()}
    by_run = {}
    for r in sorted(s.collect(), key=lambda r: (r["cell_id"], r["test_time_s"], r["seq"])):
        by_run.setdefault((r["cell_id"], r["_chunk"], r["_run"]), []).append(r)
    assert set(got) == set(by_run)
    for key, part in by_run.items():
        run, finite = got[key], [(r["test_time_s"], r["current_a"]) for r in part if r["current_a"] is not None]
        raw = [(r["test_time_s"], r["current_a"], r["voltage_v"]) for r in part]
        assert (run["n"], run["i_n"], {r["_label"] for r in part}) == (len(part), len(finite), {run["label"]})
        assert (tuple(run["raw0"]), tuple(run["raw1"])) == (raw[0], raw[-1])
        assert [run["fin0"] and tuple(run["fin0"]), run["fin1"] and tuple(run["fin1"])] == (
            [finite[0], finite[-1]] if finite else [None, None])
        ah = sum((abs(a) + abs(b)) / 2 * (u - t) for (t, a), (u, b) in zip(finite, finite[1:])) / 3600
        q = sum(abs(a + b) / 2 * (u - t) for (t, a), (u, b) in zip(finite, finite[1:])) / 3600
        assert (run["ah"], run["q"]) == (pytest.approx(ah), pytest.approx(q))


@pytest.mark.parametrize("size", [3, 50])
def test_running_takes_the_block_that_near_window_left(spark, size):
    df = spark.range(1, 41).select(F.lit("a").alias("k"), "id", F.pmod("id", F.lit(5)).alias("x"))
    near = near_window(df, ["k"], "id", {"was": (F.lag("x", 1), None, None)}, before=1, size=size, block="_at")
    got = running(near, ["k"], "id", sums={"total": F.col("x")}, size=size, block="_at").orderBy("id").collect()
    assert [r["total"] for r in got] == [sum(p % 5 for p in range(1, r["id"] + 1)) for r in got] and len(got) == 40
    assert "_at" not in got[0].asDict() and got[7]["was"] == 2


def test_window_charge_at_equal_voltages(spark):
    """Below a border the last of equal voltages counts, above it the first."""
    curve = [(0.0, 4.0, 0.0), (1.0, 3.9, 1.0), (2.0, 3.9, 2.0), (3.0, 3.7, 3.0), (4.0, 3.6, 4.0), (5.0, 3.6, 5.0), (6.0, 3.5, 6.0)]
    df = spark.createDataFrame([("c", 1, t, 0, v, q) for t, v, q in curve],
                               "cell_id string, cycle int, test_time_s double, seq int, voltage_v double, capacity_ah_curve double")
    got = curves.window_charge(df, ["cell_id", "cycle"], F.lit(3.6), F.lit(3.9)).first()
    assert got["window_charge_ah"] == pytest.approx(5.0 - 2.0)
