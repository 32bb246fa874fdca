"""Results that were wrong once: equal samples, missing capacities, mixed units, unordered sums."""

from pyspark.sql import functions as F

from voltloom.operators.series import interval_cycles
from voltloom.operators.twin import piece_keys
from voltloom.sources.scan import nested_blocks, runs_with_manifest


def test_equal_samples_stay(spark):
    rows = spark.createDataFrame([("a", 5.0, 1.0), ("a", 5.0, 1.0), ("a", 9.0, 1.0), ("a", 99.0, 1.0)],
                                 "cell_id string, test_time_s double, current_a double")
    cycles = spark.createDataFrame([("a", 1, 0.0, 8.0), ("a", 2, 5.0, 20.0)],
                                   "cell_id string, cycle int, start_time_s double, end_time_s double")
    got = sorted((r["test_time_s"], r["cycle"]) for r in interval_cycles(rows, cycles, 4.0).collect())
    assert got == [(5.0, 2), (5.0, 2), (9.0, 2)]


def test_discharge_without_capacity_uses_the_nominal_one(spark):
    runs = spark.createDataFrame([(f, float(t), -1.0, t) for f in "xyz" for t in (0, 1800, 3600)],
                                 "filename string, test_time_s double, current_a double, seq int")
    manifest = spark.createDataFrame([("b", 1, "discharge", "x", 2.0), ("b", 2, "discharge", "y", None),
                                      ("b", 3, "discharge", "z", 0.0)],
                                     "battery_id string, uid int, type string, filename string, capacity double")
    got = {(r["filename"], r["test_time_s"]): (r["soc"], r["capacity_ah"]) for r in runs_with_manifest(runs, manifest).collect()}
    assert got["x", 3600.0] == (50.0, 2.0)
    assert got["y", 3600.0] == (50.0, None) and got["z", 3600.0] == (50.0, None)
    assert got["y", 0.0] == (100.0, None)


def test_units_are_told_for_each_cell(spark):
    block = "blocks map<string,struct<t:array<double>,v:array<double>,q:array<double>,temp:array<double>>>"
    rows = [(c, 1, {"m": ([0.0], [3.0], [q], [25.0])}) for c, q in (("mah", 740.0), ("ah", 0.74), ("odd", 30.0))]
    got = {r["cell_id"]: (r["capacity_ah_curve"], r["unit"])
           for r in nested_blocks(spark.createDataFrame(rows, f"cell_id string, cycle int, {block}"), 0.74).collect()}
    assert got == {"mah": (0.74, "mAh"), "ah": (0.74, "Ah"), "odd": (30.0, "unknown")}


def test_piece_keys_do_not_hang_on_the_order_of_rows(spark):
    df = spark.range(3000).select(F.lit("b").alias("battery_id"), F.lit("p").alias("piece_id"),
                                  *(F.rand(k).alias(c) for k, c in enumerate(("test_time_s", "current_a", "voltage_v"))))
    df = spark.createDataFrame(df.collect(), df.schema)
    keys = {piece_keys(df.repartition(n)).first()["content_key"] for n in (1, 2, 5, 9)}
    assert len(keys) == 1
