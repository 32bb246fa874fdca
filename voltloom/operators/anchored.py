"""Total overpotential anchored at full charge, and characterisation blocks and sheets.

A discharge curve is read at fixed charges near its start. A sample falls into
one of the spaces between them, so a discharge is reduced to the first and the
last sample of each space before anything is gathered; what is interpolated
are a few numbers of one discharge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.curves import first_rows, small_median
from voltloom.operators.phases import CELL
from voltloom.session import join_side, staged

BAND = (0.05, 0.15)
POINTS = 21
REST_TOLERANCE_V = 0.03
REFERENCE_CYCLES = 5
DISCHARGE = "C1dc"
# Fixed value: how an info text names a channel and its item.
CHANNEL_ITEM = r"(?i)ch\s*-\s*(\d+)\s*PLN\s*-\s*(\d+)"


def curve_on_grid(curves: DataFrame, reference_cycles: int = REFERENCE_CYCLES,
                  band: tuple[float, float] = BAND) -> DataFrame:
    """(cell, cycle, grid): voltage at each of the fixed charges, null where the curve does not span them.

    The charges are shares of the cell's reference charge, the median of its
    first cycles. A cell without a positive reference charge has no rows.
    """
    q, v = F.col("capacity_ah_curve"), F.col("voltage_v")
    totals = staged(curves.groupBy("cell_id", "cycle").agg(F.max(q).alias("_total")))
    ref = join_side(staged(first_rows(totals, CELL, ["cycle"], reference_cycles).groupBy("cell_id")
                           .agg(F.percentile("_total", 0.5).alias("_ref")).where("_ref > 0")))
    step = (band[1] - band[0]) / (POINTS - 1)
    share = F.col("capacity_ah_curve") / F.col("_ref")
    place = F.least(F.lit(POINTS - 1), F.greatest(F.lit(-1), F.floor((share - band[0]) / step))).cast("int")
    spaces = (curves.where(q.isNotNull() & v.isNotNull()).join(ref, "cell_id").withColumn("_at", place)
              .groupBy("cell_id", "cycle", "_ref", "_at").agg(
                  F.count(F.lit(1)).alias("n"), F.min(q).alias("q0"), F.min_by(v, q).alias("v0"),
                  F.max(q).alias("q1"), F.max_by(v, q).alias("v1")))
    # At most POINTS + 1 spaces.
    discharges = spaces.groupBy("cell_id", "cycle", "_ref").agg(
        F.sum("n").alias("_n"), F.min("q0").alias("_low"), F.max("q1").alias("_high"),
        F.collect_list(F.struct("_at", "q0", "v0", "q1", "v1")).alias("_spaces"))

    def charge(i: Column) -> Column:
        return (F.lit(band[0]) + i * F.lit(step)) * F.col("_ref")

    def reading(i: Column) -> Column:
        below = F.array_max(F.transform(F.filter("_spaces", lambda s: s["_at"] < i), lambda s: F.struct(s["q1"].alias("q"), s["v1"].alias("v"))))
        above = F.array_min(F.transform(F.filter("_spaces", lambda s: s["_at"] >= i), lambda s: F.struct(s["q0"].alias("q"), s["v0"].alias("v"))))
        part = F.try_divide(charge(i) - below["q"], above["q"] - below["q"])
        # Without a sample below, the first one lies on the charge itself.
        return F.coalesce(below["v"] + part * (above["v"] - below["v"]), above["v"], below["v"])

    spans = (F.col("_n") >= 3) & (F.col("_low") <= charge(F.lit(0))) & (F.col("_high") >= charge(F.lit(POINTS - 1)))
    grids = discharges.select("cell_id", "cycle", F.when(spans, F.transform(
        F.sequence(F.lit(0), F.lit(POINTS - 1)), reading)).alias("grid"))
    return totals.select("cell_id", "cycle").join(ref.select("cell_id"), "cell_id", "left_semi").join(
        grids, ["cell_id", "cycle"], "left")


def anchored_overpotential(curves: DataFrame, base: DataFrame | None = None, rest: DataFrame | None = None,
                           reference_cycles: int = REFERENCE_CYCLES, band: tuple[float, float] = BAND) -> DataFrame:
    """(cell, cycle, ir_drop_v, anchor_offset_v): ohmic level of the reference and the growth since.

    The offset is the median, over the fixed charges, of reference voltage
    minus present voltage; the reference is the median of the first cycles that
    span the charges. ``rest`` (cell, cycle, v_rest_v) admits only discharges
    that start near the reference's rest voltage; ``base`` (cell, cycle,
    ir_drop_v) gives the level, and a cell without one is left out. A discharge
    that cannot be anchored keeps its row with nulls. Both tables have a row
    per discharge, as the grids have, and are merged with them at any size.
    """
    grids = staged(curve_on_grid(curves, reference_cycles, band))
    first = join_side(staged(first_rows(grids.where("grid IS NOT NULL"), CELL, ["cycle"], reference_cycles)))
    lists = first.groupBy("cell_id").agg(F.collect_list("grid").alias("_lists"))  # of reference_cycles grids
    cells = lists.select("cell_id", F.transform(
        F.sequence(F.lit(0), F.lit(POINTS - 1)),
        lambda i: small_median(F.transform("_lists", lambda g: F.get(g, i)))).alias("_ref"))
    now = grids
    from_full, level = F.lit(True), F.lit(0.0)
    if rest is not None:
        rests = rest.select("cell_id", "cycle", "v_rest_v").hint("merge")
        floors = (first.select("cell_id", "cycle").join(rests, ["cell_id", "cycle"]).where("v_rest_v IS NOT NULL")
                  .groupBy("cell_id").agg((F.percentile("v_rest_v", 0.5) - REST_TOLERANCE_V).alias("_floor")))
        cells = cells.join(floors, "cell_id", "left")
        now = now.join(rests, ["cell_id", "cycle"], "left")
        from_full = F.col("_floor").isNull() | F.coalesce(F.col("v_rest_v") >= F.col("_floor"), F.lit(False))
    if base is not None:
        drops = base.select("cell_id", "cycle", "ir_drop_v").hint("merge")
        levels = (first.select("cell_id", "cycle").join(drops, ["cell_id", "cycle"]).where("ir_drop_v IS NOT NULL")
                  .groupBy("cell_id").agg(F.percentile("ir_drop_v", 0.5).alias("_level")))
        cells, level = cells.join(levels, "cell_id"), F.col("_level")
    offset = F.when(from_full & F.col("grid").isNotNull(),
                    small_median(F.zip_with("_ref", "grid", lambda a, b: a - b)))
    return now.join(cells, "cell_id").select(
        "cell_id", "cycle", (level + offset).alias("ir_drop_v"), offset.alias("anchor_offset_v"))


def summarize_characterisation(telemetry: DataFrame, measurement: str = DISCHARGE) -> DataFrame:
    """One row per (cell, cycle) of one kind of block; capacity is the largest charge, whatever its sign."""
    t = F.col("test_time_s")
    return telemetry.where(F.col("measurement") == measurement).groupBy("cell_id", "cycle").agg(
        F.max(F.abs("capacity_ah_curve")).alias("capacity_ah"), F.count(F.lit(1)).alias("n_samples"),
        F.avg("voltage_v").alias("mean_voltage_v"), F.min("voltage_v").alias("min_voltage_v"),
        F.avg("temperature_c").alias("avg_temp"), F.max("temperature_c").alias("max_temp"),
        (F.max(t) - F.min(t)).alias("cycle_duration_s"))


def scan_characterisation(samples: DataFrame, info: DataFrame) -> DataFrame:
    """Channel tables as telemetry: item from the info text, charge level, capacity on the last sample.

    ``samples`` (file, channel, time_s, current_a, voltage_v, discharge_ah,
    cycle) and ``info`` (file, text) with texts such as "ch-03 PLN-12". A
    channel without an item is left out, and so are samples without current or
    voltage. A channel without a positive charge has neither level nor capacity.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(CHANNEL_ITEM), F.lit(1)).alias("channel"),
                         F.regexp_extract_all("text", F.lit(CHANNEL_ITEM), F.lit(2)).alias("item"))
    found = info.select(F.col("file").alias("_file"), F.explode(pairs).alias("_p")).select(
        "_file", F.ltrim(F.col("_p.channel"), F.lit("0")).alias("_channel"), F.col("_p.item").alias("item"))
    items = found.groupBy("_file", "_channel").agg(F.min(F.col("item").cast("int")).alias("item_id"))
    rows = samples.where("current_a IS NOT NULL AND voltage_v IS NOT NULL")
    ends = rows.groupBy("file", "channel").agg(
        F.max("discharge_ah").alias("_final"), F.max("time_s").alias("_last")).withColumn(
        "_final", F.when(F.col("_final") > 0, F.col("_final")))
    known = ends.join(items, (ends["file"] == items["_file"]) & (
        F.ltrim(ends["channel"], F.lit("0")) == items["_channel"])).drop("_file", "_channel")
    level = 100.0 * (1.0 - F.col("discharge_ah") / F.col("_final"))
    return rows.join(known, ["file", "channel"]).select(
        F.format_string("PLN_%03d", "item_id").alias("cell_id"), "item_id", "cycle",
        "time_s", "current_a", "voltage_v",
        F.when(level.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), level))).alias("soc"),
        F.when(F.col("time_s") == F.col("_last"), F.col("_final")).alias("capacity_ah"), F.col("file").alias("source_file"))


def initial_capacity(telemetry: DataFrame) -> DataFrame:
    """(item_id, initial_capacity_ah) from the channels' last samples."""
    return telemetry.where("capacity_ah IS NOT NULL").select("item_id", F.col("capacity_ah").alias("initial_capacity_ah"))
