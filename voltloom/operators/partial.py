"""Readings beyond the fixed discharge window: charges, learned windows, full discharges, curve change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.curves import (
    first_rows, screen_steps, step_resistance, trailing_resistance, window_charge,
)
from voltloom.operators.ordered import exact_quantiles, with_ordinal
from voltloom.operators.phases import CELL, Phases, with_phase
from voltloom.session import staged

CHARGE_HIGH, CHARGE_LOW = 4.00, 3.75
LEARN_DISCHARGES, BAND_MARGIN, SETTLE_SAMPLES = 10, 0.15, 2
MIN_SPAN_V, MAX_SPAN_V, SCAN_STEP_V = 0.10, 0.30, 0.01
MIN_STEEPNESS, MAX_STEEPNESS = 0.40, 2.0


def charge_curves(phases: Phases) -> DataFrame:
    numbers = phases.charges.select("cell_id", "phase_no", "cycle")
    return with_phase(phases, "charge", numbers).select(
        "cell_id", "cycle", "test_time_s", "seq", "voltage_v", "current_a", "capacity_ah_curve")


def charge_readings(phases: Phases) -> DataFrame:
    """One reading per charge phase; the window moves UP by current times resistance."""
    steps = step_resistance(phases.charges, phases.log.rest_below_a, direction=-1)
    trailing = trailing_resistance(screen_steps(staged(steps)), phases.size).select(
        "cell_id", "cycle", "r_step_ohm", "r_trailing_ohm")
    curves = staged(charge_curves(phases))
    level = curves.groupBy("cell_id", "cycle").agg(F.percentile(F.abs("current_a"), 0.5).alias("_i"))
    known = staged(trailing.join(level, ["cell_id", "cycle"]).withColumn("_rise", F.col("_i") * F.col("r_trailing_ohm")))
    read = window_charge(curves.join(known.where("_rise IS NOT NULL").select("cell_id", "cycle", "_rise"), ["cell_id", "cycle"]),
                         ["cell_id", "cycle"], CHARGE_LOW + F.col("_rise"), CHARGE_HIGH + F.col("_rise"))
    return known.drop("_i", "_rise").join(read, ["cell_id", "cycle"], "left")


def charge_soh(readings: DataFrame, k: int = 5) -> DataFrame:
    """SOH per charge against the median of the first measurable charges."""
    usable = readings.where("window_charge_ah IS NOT NULL")
    ref = first_rows(usable, CELL, ["cycle"], k).groupBy("cell_id").agg(F.percentile("window_charge_ah", 0.5).alias("_ref"))
    counts = readings.groupBy("cell_id").agg(F.count("window_charge_ah").alias("_n"))
    out = readings.join(counts, "cell_id").join(ref, "cell_id", "left").withColumn(
        "_ratio", F.when(F.col("_n") > k, F.col("window_charge_ah") / F.col("_ref")))
    bad = ~F.col("_ratio").between(0.5, 1.10)
    few = F.col("_n") <= k
    return out.withColumns({
        "soh": F.when(~bad, F.col("_ratio")),
        "refusal": F.when(few, F.concat(F.lit("only "), F.col("_n").cast("string"), F.lit(
            " charge(s) spanned the 4.00-3.75 V window; 5 are needed to form the reference and one more to measure")))
        .when(F.col("window_charge_ah").isNull(), "charge did not span the window")
        .when(bad, "ratio outside the plausible 0.5-1.10").otherwise("")}).drop("_n", "_ref", "_ratio")


def learn_window(curves: DataFrame, rated_ah: float, learn: int = LEARN_DISCHARGES) -> DataFrame:
    """Per cell: the flattest window inside the band its first discharges all cover.

    Every candidate window of a cell is tried on its first ten discharges: the
    candidates are a sequence of a few dozen starts, joined by cell.
    """
    cycles = curves.select("cell_id", "cycle").distinct()
    early_cycles = first_rows(cycles, CELL, ["cycle"], learn)
    early = staged(curves.join(early_cycles, ["cell_id", "cycle"]))
    w = Window.partitionBy("cell_id", "cycle").orderBy("test_time_s", "seq")
    n = F.count(F.lit(1)).over(Window.partitionBy("cell_id", "cycle"))
    settled = (F.row_number().over(w) > SETTLE_SAMPLES) | (n <= SETTLE_SAMPLES + 2)
    ends = early.withColumn("_ok", settled).groupBy("cell_id", "cycle").agg(
        F.max(F.when(F.col("_ok"), F.col("voltage_v"))).alias("_top"), F.min("voltage_v").alias("_bottom"))
    band = ends.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_early"), F.min("_top").alias("band_high"),
                                       F.max("_bottom").alias("band_low"))
    margin = BAND_MARGIN * (F.col("band_high") - F.col("band_low"))
    band = band.withColumns({"_hi": F.col("band_high") - margin, "_lo": F.col("band_low") + margin}).withColumn(
        "_span", F.least(F.lit(MAX_SPAN_V), F.col("_hi") - F.col("_lo")))
    usable = band.where((F.col("n_early") >= learn) & (F.col("_span") >= MIN_SPAN_V))
    count = F.floor((F.col("_hi") - F.col("_span") + 1e-9 - F.col("_lo")) / SCAN_STEP_V).cast("int")
    tries = usable.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0))))).select(
        "cell_id", "_k", F.round(F.col("_lo") + F.col("_k") * SCAN_STEP_V, 3).alias("_vl"),
        F.round(F.col("_lo") + F.col("_k") * SCAN_STEP_V + F.col("_span"), 3).alias("_vh"))
    read = window_charge(early.join(tries, "cell_id"), ["cell_id", "cycle", "_k"], F.col("_vl"), F.col("_vh"),
                         extra=[F.first("_vl").alias("_vl"), F.first("_vh").alias("_vh")])
    steep = read.where("window_charge_ah > 0").withColumn(
        "_s", (F.col("_vh") - F.col("_vl")) / (F.col("window_charge_ah") / rated_ah))
    per = steep.groupBy("cell_id", "_k", "_vl", "_vh").agg(F.percentile("_s", 0.5).alias("_s"))
    best = per.groupBy("cell_id").agg(F.min_by(F.struct("_vl", "_vh", "_s"), F.struct("_s", "_k")).alias("b"))
    out = band.join(best, "cell_id", "left")
    s = F.col("b._s")
    refusal = (F.when(F.col("n_early") < learn, "too few discharges to learn a window from")
               .when(F.col("_span") < MIN_SPAN_V, "the band every early discharge covers is too narrow")
               .when(s.isNull(), "no window inside the usage band could be read on the early discharges")
               .when(s > MAX_STEEPNESS, "the flattest window lies in the knee of the curve")
               .when(s < MIN_STEEPNESS, "the flattest window is flatter than any window validated").otherwise(""))
    ok = refusal == ""
    return out.select("cell_id", "n_early", "band_high", "band_low", s.alias("steepness"),
                      F.when(ok, F.col("b._vl")).alias("v_low"), F.when(ok, F.col("b._vh")).alias("v_high"),
                      refusal.alias("refusal"))


def learned_charges(curves: DataFrame, drops: DataFrame, windows: DataFrame) -> DataFrame:
    """Window charge per discharge on each cell's learned window.

    The window was learned in terminal voltage, so it moves up by the early
    discharges' median drop and then down by each discharge's own.
    """
    known = drops.where("ir_drop_v IS NOT NULL").select("cell_id", "cycle", "ir_drop_v", "r_trailing_ohm")
    early = first_rows(known, CELL, ["cycle"], LEARN_DISCHARGES).groupBy("cell_id").agg(
        F.percentile("ir_drop_v", 0.5).alias("_ref"))
    spec = windows.where("refusal = ''").join(early, "cell_id").select(
        "cell_id", (F.col("v_low") + F.col("_ref")).alias("_vl"), (F.col("v_high") + F.col("_ref")).alias("_vh"))
    rows = curves.join(known.join(spec, "cell_id"), ["cell_id", "cycle"])
    return window_charge(rows, ["cell_id", "cycle"], F.col("_vl") - F.col("ir_drop_v"), F.col("_vh") - F.col("ir_drop_v"),
                         extra=[F.first("ir_drop_v").alias("ir_drop_v"), F.first("r_trailing_ohm").alias("r_trailing_ohm")])


def full_discharges(discharges: DataFrame, tolerance_v: float = 0.10, fraction: float = 0.8) -> DataFrame:
    """Grade discharges of at least five samples: does it reach the cut-off, is it full.

    The cut-off is the median of the max(5, 0.5 %) lowest end voltages of 1.5 V
    and above. ``discharges`` carries min_voltage_v and charge_ah.
    """
    rows = staged(discharges.where("n_samples >= 5 AND min_voltage_v IS NOT NULL"))
    real = rows.where("min_voltage_v >= 1.5")
    k = real.groupBy("cell_id").agg(F.greatest(F.lit(5), F.ceil(F.count(F.lit(1)) * 0.005)).alias("_k"),
                                    F.count(F.lit(1)).alias("_n"))
    # The median of the k lowest is one or two order statistics of the cell.
    ranked = with_ordinal(real, CELL, ["min_voltage_v", "cycle"], F.floor(F.col("min_voltage_v") * 200), "_r").join(k, "cell_id")
    size = F.least("_k", "_n")
    middle = (F.col("_r") >= F.floor((size - 1) / 2) + 1) & (F.col("_r") <= F.floor(size / 2) + 1)
    cut = ranked.where(middle).groupBy("cell_id").agg(F.avg("min_voltage_v").alias("cutoff_v"))
    graded = rows.join(cut, "cell_id", "left").withColumn(
        "reaches_cutoff", F.coalesce(F.col("min_voltage_v") <= F.col("cutoff_v") + tolerance_v, F.lit(False)))
    graded = staged(graded)
    reach = exact_quantiles(graded, ["cell_id"], F.when(F.col("reaches_cutoff"), F.col("charge_ah")), {"_a": 0.99})
    every = exact_quantiles(graded, ["cell_id"], "charge_ah", {"_b": 0.99})
    top = graded.groupBy("cell_id").agg(F.max("charge_ah").alias("_max"))
    joined = graded.join(reach, "cell_id").join(every, "cell_id").join(top, "cell_id").withColumn(
        "capability_ah", F.coalesce("_a", "_b"))
    bad = F.coalesce(F.try_divide(F.col("capability_ah"), F.col("_max")) < 0.2, F.lit(False))
    full = F.col("reaches_cutoff") & (F.col("charge_ah") >= fraction * F.col("capability_ah")) & (F.col("charge_ah") > 0)
    return joined.withColumns({"is_full": full & ~bad, "cell_refused": bad}).drop("_a", "_b", "_max")


def on_voltage_grid(curves: DataFrame, low: float = 2.0, high: float = 4.2, points: int = 1000) -> DataFrame:
    """(cell_id, cycle, _g, _q): charge at even volts, none outside a curve's own range.

    Each segment between neighbouring samples covers a few grid points, which
    it produces itself; curves and grid are never joined against each other.
    A grid point on the border of two segments comes twice.
    """
    w = Window.partitionBy("cell_id", "cycle").orderBy("voltage_v", "test_time_s")
    step = (high - low) / (points - 1)
    seg = curves.withColumns({"_v1": F.lead("voltage_v").over(w), "_q1": F.lead("capacity_ah_curve").over(w)}).where(
        "_v1 IS NOT NULL AND _v1 > voltage_v")
    first = F.greatest(F.ceil((F.col("voltage_v") - low) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("_v1") - low) / step), F.lit(points - 1)).cast("int")
    laid = seg.withColumn("_g", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn(
        "_x", low + F.col("_g") * step)
    q = F.col("capacity_ah_curve") + (F.col("_q1") - F.col("capacity_ah_curve")) * (
        (F.col("_x") - F.col("voltage_v")) / (F.col("_v1") - F.col("voltage_v")))
    return laid.select("cell_id", "cycle", "_g", q.alias("_q"))


def delta_q_variance(curves: DataFrame, cycle_a: int, cycle_b: int, low: float = 2.0, high: float = 4.2,
                     points: int = 1000, least: int = 50) -> DataFrame:
    """log10 of the variance of Q_b(V) - Q_a(V) over a voltage grid; null under 50 usable volts."""
    laid = on_voltage_grid(curves.where(F.col("cycle").isin(cycle_a, cycle_b)), low, high, points)
    on_grid = laid.groupBy("cell_id", "_g").agg(
        F.max(F.when(F.col("cycle") == cycle_a, F.col("_q"))).alias("_a"),
        F.max(F.when(F.col("cycle") == cycle_b, F.col("_q"))).alias("_b"))
    diff = F.col("_b") - F.col("_a")
    agg = on_grid.groupBy("cell_id").agg(F.count(diff).alias("n_grid"), F.var_pop(diff).alias("_var"))
    return agg.select("cell_id", "n_grid", F.when((F.col("n_grid") >= least) & (F.col("_var") > 0),
                                                  F.log10("_var")).alias("delta_q_log_variance"))
