"""Stored tables are small files with many rows: joins do not send them to the driver."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voltloom import session
from voltloom.operators import anchored, curves, phases
from voltloom.session import join_side, staged

CYCLE = [0.0] * 4 + [-1.5] * 8 + [0.0] * 4 + [2.0] * 4


def cut_log(spark, cells=3, cycles=5):
    rows = [(f"c{c}", 10.0 * (k * len(CYCLE) + n), 1, i, 4.1 - 0.04 * n - 0.01 * k, 20.0 + c)
            for c in range(cells) for k in range(cycles) for n, i in enumerate(CYCLE)]
    return phases.segment(phases.Log(staged(spark.createDataFrame(
        rows, "cell_id string, test_time_s double, seq int, current_a double, voltage_v double, temperature_c double")), chunk_s=150.0))


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_many_rows_in_a_small_file_are_merged(spark):
    many = staged(spark.range(session.BROADCAST_ROWS + 1).select(F.format_string("c%d", F.floor(F.col("id") / 1000)).alias("cell_id"), F.lit(1.5).alias("x")))
    few = staged(spark.createDataFrame([("c1", 7), ("c2", None), (None, 8)], "cell_id string, y int"))
    by_size = many.join(many.groupBy("cell_id").agg(F.max("x").alias("m")), "cell_id")
    assert "BroadcastHashJoin" in plan(by_size)
    side = join_side(many)
    assert "BroadcastHashJoin" not in plan(many.join(side.where("x > 1").groupBy("cell_id").agg(F.max("x").alias("m")), "cell_id"))
    assert "BroadcastHashJoin" in plan(many.join(join_side(few), "cell_id"))
    assert rows(side.join(few, "cell_id").groupBy("cell_id", "y").count()) == rows(many.join(few, "cell_id").groupBy("cell_id", "y").count())


def test_steps_runs_and_curves_of_many_discharges_are_merged(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(curves, "staged", lambda df: seen.append(plan(df)) or staged(df))

    def made():
        seen.clear()
        cut = cut_log(spark)
        numbered = phases.numbered_runs(cut.runs.drop("run_no"))
        lines = curves.discharge_curves(cut)
        return [rows(df) for df in (curves.discharge_steps(cut), numbered.select("cell_id", "chunk", "run", "run_no"), lines)], [
            *seen, plan(numbered)], lines._jdf.queryExecution().optimizedPlan().toString()

    want, plans, optimized = made()
    assert sum("BroadcastHashJoin" in p for p in plans) >= 4 and "strategy=merge" not in optimized
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    got, plans, optimized = made()
    assert got == want and all(got)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert len(re.findall(r"phase_no.*rightHint=\(strategy=merge\)", optimized)) == 1


def test_anchored_merges_a_row_per_discharge(spark, monkeypatch):
    cut = cut_log(spark)
    rest = staged(curves.step_resistance(cut.discharges, cut.log.rest_below_a))
    base = rest.withColumn("ir_drop_v", F.lit(0.1))

    def made():
        return anchored.anchored_overpotential(staged(curves.discharge_curves(cut)), base, rest, band=(0.2, 0.6))

    out = made()
    assert not re.findall(r"BroadcastHashJoin \[cell_id#\d+, cycle#\d+L?\]", plan(out))
    found = rows(out)
    assert len(found) == 15 and "anchor_offset_v=None" not in "".join(found)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert rows(made()) == found
