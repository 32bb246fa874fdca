"""State of health from window charge: table, gates, report, uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.curves import V_HIGH, V_LOW, first_rows
from voltloom.operators.phases import CELL

REFERENCE_CYCLES = 5
REPORT_CYCLES = 5
MIN_DISCHARGE_FRACTION = 0.50
MIN_SOH, MAX_SOH = 0.50, 1.10
MAX_IMPLAUSIBLE = 0.20
MAX_REFERENCE_EFC = 20.0
RECENT_READINGS = 10
CONSISTENT_BELOW = 0.01
MEDIAN_SE = 1.2533   # standard error of a median, in median absolute deviations / sqrt(n)

TOO_LITTLE = ("discharge delivered under 50% of the reference charge: either it was cut short or the "
              "cell has lost more than half its capacity, and the window cannot tell which")
IMPLAUSIBLE = ("window ratio below 0.5; a cell at that charge would be scrap, so the window is not "
               "tracking capacity here")
CELL_REFUSED = ("more than 20% of this cell's measurable cycles are physically implausible; the whole "
                "cell is refused")
TOO_HIGH = ("window ratio above 1.1; this discharge did not span the same part of the curve as the "
            "reference")


def state_from_soh(soh: Column) -> Column:
    return (F.when(soh >= 0.95, "HEALTHY").when(soh >= 0.90, "WARNING")
            .when(soh >= 0.80, "DEGRADED").when(soh.isNotNull(), "CRITICAL"))


def reference_of(charges: DataFrame, k: int = REFERENCE_CYCLES) -> DataFrame:
    """Per cell: medians over its first k usable cycles."""
    usable = charges.where("window_charge_ah IS NOT NULL")
    return first_rows(usable, CELL, ["cycle"], k).groupBy("cell_id").agg(
        F.percentile("window_charge_ah", 0.5).alias("window_reference_ah"),
        F.percentile("cycle_charge_ah", 0.5).alias("cycle_charge_reference_ah"),
        F.count(F.lit(1)).alias("n_reference"), F.max("cycle").alias("last_reference_cycle"))


def soh_table(charges: DataFrame, k: int = REFERENCE_CYCLES,
              min_fraction: float = MIN_DISCHARGE_FRACTION) -> DataFrame:
    """SOH per discharge against the cell's own first usable discharges.

    A later rule overrides the refusal text of an earlier one.
    """
    table = charges.join(reference_of(charges, k), "cell_id", "left")
    ref, total = F.col("window_reference_ah"), F.col("cycle_charge_reference_ah")
    partial = F.coalesce((total > 0) & (F.col("cycle_charge_ah") < min_fraction * total), F.lit(False))
    table = table.withColumn("partial_discharge", partial).withColumn(
        "soh_window", F.when(~F.col("partial_discharge") & (ref > 0), F.col("window_charge_ah") / ref))
    table = table.withColumn("implausible", F.coalesce(F.col("soh_window") < MIN_SOH, F.lit(False)))
    share = table.where("soh_window IS NOT NULL").groupBy("cell_id").agg(
        F.avg(F.col("implausible").cast("double")).alias("cell_implausible_fraction"))
    table = table.join(share, "cell_id", "left").withColumn(
        "cell_refused", F.coalesce(F.col("cell_implausible_fraction") > MAX_IMPLAUSIBLE, F.lit(False)))
    refused = F.col("implausible") | F.col("cell_refused")
    return table.withColumns({
        "refusal": F.when(F.col("cell_refused"), CELL_REFUSED).when(F.col("implausible"), IMPLAUSIBLE)
        .when(F.col("partial_discharge"), TOO_LITTLE).otherwise(""),
        "soh_window_accepted": F.when(~refused, F.col("soh_window")),
    })


def field_gates(table: DataFrame, discharges: DataFrame, k: int = REFERENCE_CYCLES,
                max_efc: float = MAX_REFERENCE_EFC) -> DataFrame:
    """Withhold ratios above 1.10, and every cell whose reference formed too late."""
    ends = table.select("cell_id", "last_reference_cycle", "n_reference",
                        "cycle_charge_reference_ah").distinct().where(F.col("n_reference") >= k)
    used = (discharges.select("cell_id", "cycle", "charge_ah")
            .join(ends.select("cell_id", "last_reference_cycle"), "cell_id")
            .where("cycle <= last_reference_cycle")
            .groupBy("cell_id").agg(F.sum("charge_ah").alias("_delivered")))
    efc = F.when(F.col("cycle_charge_reference_ah") > 0,
                 F.col("_delivered") / F.col("cycle_charge_reference_ah"))
    out = table.join(used, "cell_id", "left").withColumn("reference_efc", efc).drop("_delivered")
    late = ~F.coalesce(F.col("reference_efc") <= max_efc, F.lit(False))
    high = F.coalesce(F.col("soh_window") > MAX_SOH, F.lit(False))
    where = F.coalesce(F.concat(F.lit("after "), F.format_string("%.0f", F.bround("reference_efc", 0)),
                                F.lit(" equivalent full cycles")), F.lit("never"))
    late_text = F.concat(
        F.lit("the reference was formed "), where,
        F.lit(", not within the first 20, so it is not this cell as new and every reading against it "
              "would be offset"))
    return out.withColumns({
        "reference_late": late,
        "refusal": F.when(late, late_text).when(high, TOO_HIGH).otherwise(F.col("refusal")),
        "cell_refused": F.col("cell_refused") | late,
        "soh_window_accepted": F.when(~late & ~high, F.col("soh_window_accepted")),
    })


def _scatter(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds |value - median| per cell; the rows are a few per cell."""
    cell = Window.partitionBy("cell_id")
    return rows.withColumn("_x", value).withColumn("_mid", F.percentile("_x", 0.5).over(cell)).withColumn(
        name, F.abs(F.col("_x") - F.col("_mid"))).drop("_x", "_mid")


def _line_residual() -> Column:
    cell = Window.partitionBy("cell_id")
    y, x = F.col("soh_window_accepted"), -F.col("_back").cast("double")
    return y - (F.regr_intercept(y, x).over(cell) + F.regr_slope(y, x).over(cell) * x)


def current_soh(table: DataFrame, discharges: DataFrame, k: int = REFERENCE_CYCLES,
                window: str = f"{V_HIGH:.2f}-{V_LOW:.2f} V", mode: str = "fixed",
                compensated: bool = True) -> DataFrame:
    """One row per cell: the reported SOH, or the reason there is none.

    Scatter is judged on the first five and the last ten accepted readings of
    a cell, picked by a row limit that runs before the shuffle.
    """
    accepted = table.where("soh_window_accepted IS NOT NULL")
    heads = _scatter(first_rows(accepted, CELL, ["cycle"], k), F.col("window_charge_ah"), "_off")
    heads = heads.groupBy("cell_id").agg(
        (F.percentile("_off", 0.5) / F.percentile("window_charge_ah", 0.5)).alias("_ref_mad"),
        F.count(F.lit(1)).alias("_n_ref"), F.max("cycle").alias("_cut"),
        F.percentile("r_trailing_ohm", 0.5).alias("resistance_reference_ohm"))
    after = accepted.join(heads.select("cell_id", "_cut"), "cell_id").where("cycle > _cut")
    last = Window.partitionBy("cell_id").orderBy(F.desc("cycle"))
    tail = after.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= RECENT_READINGS)
    near = F.col("_back") <= REPORT_CYCLES
    tails = _scatter(tail, _line_residual(), "_off").groupBy("cell_id").agg(
        F.percentile("_off", 0.5).alias("_recent_mad"), F.count(F.lit(1)).alias("_n_recent"),
        F.percentile(F.when(near, F.col("soh_window_accepted")), 0.5).alias("soh"),
        F.max("cycle").alias("at_cycle"),
        F.percentile(F.when(near, F.col("r_trailing_ohm")), 0.5).alias("resistance_now_ohm"))
    per_cell = table.groupBy("cell_id").agg(
        F.count("window_charge_ah").alias("n_measurable"),
        F.count("soh_window_accepted").alias("n_accepted"),
        F.max("cell_refused").alias("_refused"),
        F.min_by("refusal", F.when(F.col("cell_refused"), F.col("cycle"))).alias("_why"))
    counts = discharges.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_discharges"))
    joined = (counts.join(per_cell, "cell_id", "left").join(heads, "cell_id", "left")
              .join(tails, "cell_id", "left"))
    n_meas, n_acc = F.col("n_measurable"), F.col("n_accepted")

    def few(n: Column) -> Column:
        return F.concat(F.lit("only "), n.cast("string"), F.lit(
            f" discharge(s) crossed the {window} window; {k} are needed to form the reference and at "
            "least one more to measure against it"))

    unread = ("no discharge was preceded by a clean rest-to-load step, so the cell's resistance - and "
              "with it the ohmic correction - is unknown" if compensated
              else "no discharge produced a usable curve")
    refusal = (F.when(n_meas.isNull(), unread).when(n_meas <= k, few(n_meas))
               .when(F.col("_refused"), F.col("_why"))
               .when(F.col("soh").isNull(), few(n_acc)).otherwise(""))
    ok = refusal == ""
    out = joined.withColumns({
        "refusal": refusal,
        "uncertainty": F.when(ok & (F.col("_n_ref") >= k) & (F.col("_n_recent") >= 4), F.sqrt(
            F.pow(MEDIAN_SE * F.col("_ref_mad") / F.sqrt("_n_ref"), F.lit(2.0))
            + F.pow(MEDIAN_SE * F.col("_recent_mad") / F.sqrt(F.lit(float(REPORT_CYCLES))), F.lit(2.0)))),
    })
    good = F.col("refusal") == ""
    r0, r1 = F.col("resistance_reference_ohm"), F.col("resistance_now_ohm")
    return out.select(
        "cell_id", F.when(good, F.col("soh")).alias("soh"), F.when(good, F.col("at_cycle")).alias("at_cycle"),
        "n_measurable", "n_accepted", "n_discharges", F.lit(compensated).alias("compensated"),
        F.lit(window).alias("window"), F.lit(mode).alias("window_mode"), "refusal",
        F.when(good, r0).alias("resistance_reference_ohm"), F.when(good, r1).alias("resistance_now_ohm"),
        F.when(good & (r0 > 0), r1 / r0).alias("resistance_growth"), "uncertainty",
        F.coalesce(F.col("uncertainty") <= CONSISTENT_BELOW, F.lit(False)).alias("consistent"))


def per_cell_fit(table: DataFrame) -> DataFrame:
    """Slope, bias and error of the estimate against measured SOH, per cell."""
    both = F.col("soh_window").isNotNull() & F.col("soh").isNotNull()
    x, y = F.when(both, F.col("soh")), F.when(both, F.col("soh_window"))
    agg = table.groupBy("cell_id").agg(
        F.count(x).alias("n"), (F.max(x) - F.min(x)).alias("_spread"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_bias"),
        F.avg(F.abs(y - x)).alias("_mae"))
    ok = (F.col("n") >= 10) & (F.col("_spread") > 0)
    return agg.select("cell_id", "n", *[
        F.when(ok, F.col(f"_{c}")).alias(a)
        for c, a in (("slope", "slope"), ("bias", "bias"), ("mae", "mae"), ("spread", "spread_soh"))])
