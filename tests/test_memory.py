"""A battery's memory of pieces against the whole log."""

import itertools
import tempfile

from pyspark.sql import functions as F

from voltloom.operators import curves, phases, soh
from voltloom.operators.memory import Memory

CYCLES = 14


def log(spark, batteries=("A", "B"), cycles=CYCLES):
    """Rest, 16 samples of discharge, rest, charge; cells age, and one step of B is far too low."""
    rows = []
    for k, b in enumerate(batteries):
        for c in range(cycles):
            for pos in range(30):
                amps = -1.5 if 4 <= pos < 20 else 3.0 if pos >= 22 else 0.0
                drop = 0.001 if (k, c) == (1, 6) else 0.06 + 0.004 * c * (k + 1)
                volts = 4.1 if pos < 4 else 4.1 - drop - 0.05 * (pos - 4) * (1 + 0.01 * c) if pos < 20 else 3.4 if pos < 22 else 3.6 + 0.06 * (pos - 22)
                n = c * 30 + pos
                rows.append((b, n, n * 60.0, amps, volts, 25.0 + c, c))
    return spark.createDataFrame(
        rows, "battery_id string, seq long, test_time_s double, current_a double, voltage_v double, temperature_c double, c int")


def whole(df):
    cut = phases.segment(phases.Log(df.withColumnRenamed("battery_id", "cell_id"), chunk_s=7200.0))
    drops = curves.discharge_steps(cut)
    charges = curves.charges_by_cycle(curves.discharge_curves(cut), drops)
    table = soh.field_gates(soh.soh_table(charges), cut.discharges)
    return rows(table), rows(soh.current_soh(table, cut.discharges))


def rows(df):
    names = [c for c in ("cell_id", "cycle", "window_charge_ah", "cycle_charge_ah", "ir_drop_v", "r_trailing_ohm",
                         "soh_window_accepted", "soh", "n_discharges", "refusal") if c in df.columns]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def pieces(df, per):
    return df.withColumn("piece_id", F.floor(F.col("c") / per)).drop("c")


def test_pieces_in_any_order_and_twice_equal_the_whole_log(spark):
    df = log(spark)
    memory = Memory(spark, tempfile.mkdtemp())
    cut = pieces(df, 5)
    taken = [memory.absorb(cut.where(F.col("piece_id") == p), chunk_s=7200.0) for p in (2, 0, 1)]
    assert taken == [2, 2, 2]
    assert memory.absorb(cut.withColumn("piece_id", F.col("piece_id") + 100), chunk_s=7200.0) == 0
    table, _ = memory.table()
    assert (rows(table), rows(memory.current().drop("telemetry_pieces"))) == whole(df)
    assert {r["telemetry_pieces"] for r in memory.current().collect()} == {3}


def test_a_delivery_touches_its_own_batteries_only(spark):
    memory = Memory(spark, tempfile.mkdtemp())
    cut = pieces(log(spark), 100)
    memory.absorb(cut.where("battery_id = 'A'"), chunk_s=7200.0)
    before = rows(memory.charges())
    memory.absorb(cut.where("battery_id = 'B'"), chunk_s=7200.0)
    assert [r for r in rows(memory.charges()) if r[0] == "A"] == before
    only = spark.createDataFrame([("B",)], "battery_id string")
    assert {r["cell_id"] for r in memory.current(only).collect()} == {"B"}


def test_a_new_battery_is_refused_with_a_reason(spark):
    memory = Memory(spark, tempfile.mkdtemp())
    memory.absorb(pieces(log(spark, ("A",), 3), 100), chunk_s=7200.0)
    (row,) = memory.current().collect()
    assert row["soh"] is None and row["n_discharges"] == 3 and row["refusal"]


def test_a_batch_without_keys_does_not_count(spark):
    memory = Memory(spark, tempfile.mkdtemp())
    cut = pieces(log(spark, ("A",), 6), 3)
    memory.absorb(cut.where("piece_id = 0"), chunk_s=7200.0)
    left = memory.discharges().drop("cycle", "batch", "bucket").withColumn("start_time_s", F.col("start_time_s") + 1e6)
    memory._write(left, "discharges", "9-lost")
    assert memory.discharges().count() == 3
    memory.absorb(cut.where("piece_id = 1"), chunk_s=7200.0)
    assert memory.discharges().count() == 6
    assert list(itertools.chain.from_iterable(memory.discharges().select("cycle").orderBy("cycle").collect())) == [1, 2, 3, 4, 5, 6]


def test_an_empty_memory(spark):
    memory = Memory(spark, tempfile.mkdtemp())
    assert memory.current().collect() == [] and memory.absorb(pieces(log(spark, ("A",), 3).limit(0), 2)) == 0
