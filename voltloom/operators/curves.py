"""Step resistance, trailing resistance and charge between two voltages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import forward_fill, near_window, running_total
from voltloom.operators.phases import CELL, Phases, with_phase
from voltloom.session import join_side, staged

V_HIGH, V_LOW = 3.90, 3.60
MIN_COVERAGE = 0.95
MAX_STEP_GAP_S = 60.0
MIN_STEP_CURRENT_A = 0.05
QUIET_FRACTION = 0.05
TRAILING_STEPS = 11
MIN_R_FRACTION = 0.25
REFERENCE_STEPS = 5


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows per key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def small_median(values: Column) -> Column:
    """Median of a short array."""
    s = F.array_sort(values)
    n = F.size(s)
    mid = F.floor((n - 1) / 2.0).cast("int")
    return F.when(n > 0, (F.get(s, mid) + F.get(s, F.floor(n / 2.0).cast("int"))) / 2.0)


def step_resistance(discharges: DataFrame, rest_below_a: float, direction: int = 1) -> DataFrame:
    """Resistance from the last quiet sample to the first loaded one.

    ``direction`` is 1 for a discharge (voltage falls), -1 for a charge.
    """
    now, was = F.col("first_sample"), F.col("sample_before")
    quiet = F.greatest(F.lit(float(rest_below_a)), QUIET_FRACTION * F.abs(now["i"]))
    clean = (was["t"].isNotNull() & (F.abs(was["i"]) <= quiet)
             & (now["t"] - was["t"] <= MAX_STEP_GAP_S))
    d_i = F.abs(now["i"] - was["i"])
    d_v = (was["v"] - now["v"]) * direction
    return discharges.where(F.col("n_samples") >= 2).select(
        "cell_id", "cycle", "phase_no", "mean_current_a",
        F.when(clean, was["v"]).alias("v_rest_v"),
        F.when(clean & (d_i >= MIN_STEP_CURRENT_A) & (d_v > 0), d_v / d_i).alias("r_step_ohm"))


def screen_steps(steps: DataFrame) -> DataFrame:
    """Null the steps below a quarter of the median of the first five accepted.

    Only past steps count. After five acceptances the limit never changes, so
    it is found by five small per-cell aggregates instead of a walk along the
    cell. Each uses the one before once, so the plan grows with their number,
    not with two to its power.
    """
    finite = steps.where("r_step_ohm IS NOT NULL").select("cell_id", "cycle", "r_step_ohm")
    hit = F.struct(F.col("cycle").alias("c"), F.col("r_step_ohm").alias("r"))
    accepted = finite.groupBy("cell_id").agg(F.array(F.min(hit)).alias("acc"))
    for _ in range(REFERENCE_STEPS - 1):
        last = F.element_at("acc", -1)["c"]
        limit = MIN_R_FRACTION * small_median(F.transform("acc", lambda a: a["r"]))
        following = (F.col("cycle") > last) & (F.col("r_step_ohm") >= limit)
        accepted = finite.join(accepted, "cell_id").groupBy("cell_id").agg(
            F.first("acc").alias("acc"), F.min(F.when(following, hit)).alias("more")).select(
            "cell_id", F.when(F.col("more").isNotNull(), F.concat("acc", F.array("more")))
            .otherwise(F.col("acc")).alias("acc"))
    past = F.transform(F.filter("acc", lambda a: a["c"] < F.col("cycle")), lambda a: a["r"])
    low = F.col("r_step_ohm") < MIN_R_FRACTION * small_median(past)
    joined = steps.join(accepted, "cell_id", "left")
    return joined.withColumn(
        "r_ok_ohm", F.when(F.coalesce(low, F.lit(False)), None).otherwise(F.col("r_step_ohm"))).drop("acc")


def trailing_resistance(screened: DataFrame, size: int | None = 65_536) -> DataFrame:
    """Median of the last 11 screened steps, carried forward; the ohmic drop with it.

    Running sums and fills read their input twice, so the steps, a row per
    discharge, are staged before each: no task holds the screening four times.
    The numbered steps are staged too: the join that numbers them may run in
    one task, where the medians must not follow it.
    """
    numbered = staged(running_total(join_side(staged(screened)), CELL, "cycle", {"step_no": F.lit(1)}, size))
    rolled = staged(near_window(numbered, CELL, "step_no", {
        "_median": (F.percentile("r_ok_ohm", 0.5), -(TRAILING_STEPS - 1), 0)},
        before=TRAILING_STEPS - 1, size=size))
    filled = forward_fill(join_side(rolled), CELL, "step_no", {"r_trailing_ohm": F.col("_median")}, size)
    return filled.withColumn(
        "ir_drop_v", F.abs("mean_current_a") * F.col("r_trailing_ohm")).drop("_median", "step_no")


def discharge_steps(phases: Phases) -> DataFrame:
    """(cell, cycle, phase) with step, screened and trailing resistance; staged, compact."""
    steps = join_side(staged(step_resistance(phases.discharges, phases.log.rest_below_a)))
    return staged(trailing_resistance(screen_steps(steps), phases.size))


def bracket(v: Column, q: Column, at: Column, x: Column, name: str) -> list[Column]:
    """The samples just below and just above a voltage, as aggregates.

    At equal voltage the lower bracket is the last sample in time, the upper
    the first.
    """
    point = F.struct(v.alias("v"), at.alias("at"), q.alias("q"))
    ok = v.isNotNull() & q.isNotNull()
    return [F.max(F.when(ok & (v <= x), point)).alias(f"{name}_a"),
            F.min(F.when(ok & (v >= x), point)).alias(f"{name}_b")]


def interpolated(name: str, x: Column) -> Column:
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    share = F.try_divide(x - a["v"], b["v"] - a["v"])
    return F.when(a["v"] == b["v"], a["q"]).otherwise(a["q"] + (b["q"] - a["q"]) * share)


def window_charge(curves: DataFrame, keys: Sequence[str], lo: Column, hi: Column,
                  extra: Sequence[Column] = (), min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Charge between two voltages per group, without sorting the curve.

    ``lo`` and ``hi`` are constant inside a group (a fixed window, or one
    shifted by the group's ohmic drop). Null where the group does not cover
    the window.
    """
    work = curves.withColumns({"_lo": lo, "_hi": hi})
    v, q = F.col("voltage_v"), F.col("capacity_ah_curve")
    at = F.struct("test_time_s", "seq")
    ok = v.isNotNull() & q.isNotNull()
    agg = work.groupBy(*keys).agg(
        F.count_if(ok).alias("_n"), F.min(F.when(ok, v)).alias("_vmin"),
        F.max(F.when(ok, v)).alias("_vmax"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.max(q).alias("cycle_charge_ah"), *bracket(v, q, at, F.col("_lo"), "l"),
        *bracket(v, q, at, F.col("_hi"), "h"), *extra)
    covered = F.least("_vmax", "_hi") - F.greatest("_vmin", "_lo")
    readable = (F.col("_n") >= 2) & (covered >= min_coverage * (F.col("_hi") - F.col("_lo")))
    charge = F.abs(interpolated("l", F.col("_lo")) - interpolated("h", F.col("_hi")))
    return agg.withColumn("window_charge_ah", F.when(readable, charge)).drop(
        "_n", "_vmin", "_vmax", "_lo", "_hi", "l_a", "l_b", "h_a", "h_b")


def discharge_curves(phases: Phases) -> DataFrame:
    """Samples of every discharge with the running charge, tagged with its cycle number."""
    numbers = join_side(phases.discharges).where("n_samples >= 2").select("cell_id", "phase_no", "cycle")
    return with_phase(phases, "discharge", numbers).select(
        "cell_id", "cycle", "test_time_s", "seq", "voltage_v", "current_a", "capacity_ah_curve")


def charges_by_cycle(curves: DataFrame, drops: DataFrame | None = None,
                     v_low: float = V_LOW, v_high: float = V_HIGH) -> DataFrame:
    """Window charge per discharge; with ``drops`` the window moves down by each ohmic drop.

    A discharge whose drop is unknown is left out rather than read uncorrected.
    """
    if drops is None:
        return window_charge(curves, ["cell_id", "cycle"], F.lit(v_low), F.lit(v_high)).withColumn(
            "ir_drop_v", F.lit(0.0))
    known = drops.where("ir_drop_v IS NOT NULL").select(
        "cell_id", "cycle", "ir_drop_v", "r_trailing_ohm")
    drop = F.col("ir_drop_v")
    return window_charge(
        curves.join(known, ["cell_id", "cycle"]), ["cell_id", "cycle"], v_low - drop, v_high - drop,
        extra=[F.first("ir_drop_v").alias("ir_drop_v"),
               F.first("r_trailing_ohm").alias("r_trailing_ohm")])
