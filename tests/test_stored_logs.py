"""Logs that several steps read are made once; curves are dealt out to many tasks."""

from __future__ import annotations

from voltloom import fixtures
from voltloom.catalog import answers, memory, sequence
from voltloom.operators import incremental, phases

SF = "/root/testdata/sf0.001"


def test_memory_takes_stored_pieces(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(memory.Memory, "absorb", lambda self, pieces, chunk_s: seen.extend(pieces.inputFiles()))
    memory.remembered(spark, SF)
    assert seen and not [f for f in seen if "lineitem" in f]


def test_labelled_makes_its_log_once(spark, monkeypatch):
    made, duty = [], fixtures.duty
    monkeypatch.setattr(fixtures, "duty", lambda *a: made.append(a) or duty(*a))
    assert answers.labelled(spark, SF).count() > 0
    assert len(made) == 1


def test_curves_are_dealt_out(spark):
    lines = spark.createDataFrame(
        [("a", 2, float(k), k, 4.1 - k / 100, k / 50) for k in range(120)] + [("b", 2, float(k), k, 4.1 - k / 100, k / 50) for k in range(4)],
        "cell_id string, cycle int, test_time_s double, seq int, voltage_v double, capacity_ah_curve double")
    out = incremental.incremental_capacity(lines)
    assert f"{incremental.CURVE_PARTITIONS}" in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    found = {r.cell_id: r for r in out.collect()}
    assert found["b"].dqdv is None and len(found["a"].dqdv) == found["a"].n_grid
    assert all(abs(x + 2.0) < 1e-6 for x in found["a"].dqdv)  # a straight line of -2 Ah a volt


def test_charges_take_a_log_of_the_caller(spark):
    log = phases.Log(fixtures.duty(spark, SF), chunk_s=sequence.CHUNK_S)
    mine, theirs = sequence.gated_table(spark, SF, log)[1], sequence.gated_table(spark, SF)[1]
    assert sorted(map(str, mine.select("cell_id", "cycle", "soh_window_accepted").collect())) == sorted(
        map(str, theirs.select("cell_id", "cycle", "soh_window_accepted").collect()))
