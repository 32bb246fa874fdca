"""Constant-current stretches of a cycle, and a check of counted charge against a known load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import lagged, with_ordinal
from voltloom.operators.phases import CELL, Phases, with_phase

RATE_FRACTION, RATE_STEP = 0.5, 0.15   # fixed values: eligible above half the median rate; a step ends a run
MIN_POINTS, MIN_SPAN_V = 50, 0.1


@dataclass(frozen=True)
class CurveRuns:
    """Per (cell, cycle) its longest constant-current run, and what refused the others."""

    samples: DataFrame
    cycles: DataFrame

    @property
    def curves(self) -> DataFrame:
        """Samples of the kept runs; the charge counter starts at zero."""
        kept = self.cycles.where("refusal = ''").select(*CELL, "cycle", "run", "run_current_a", "_q0")
        rows = self.samples.where("eligible AND voltage_v IS NOT NULL AND capacity_ah_counter IS NOT NULL")
        return rows.join(kept, [*CELL, "cycle", "run"]).select(
            *CELL, "cycle", "test_time_s", "run_current_a", "voltage_v",
            (F.col("capacity_ah_counter") - F.col("_q0")).alias("capacity_ah_curve"))

    @property
    def refusals(self) -> DataFrame:
        """(refusal, n): cycles by reason; kept cycles have the empty reason."""
        return self.cycles.groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


def constant_current_runs(samples: DataFrame, phase: str = "discharge", min_points: int = MIN_POINTS,
                          rate_fraction: float = RATE_FRACTION, rate_step: float = RATE_STEP,
                          min_span_v: float = MIN_SPAN_V) -> CurveRuns:
    """Cut the samples of each cycle where the rate steps or falls below its half.

    ``samples`` has cell_id, cycle, test_time_s, seq, current_a, voltage_v and
    capacity_ah_counter. Windows are over one cycle of one battery.
    """
    sign = -1.0 if phase == "discharge" else 1.0
    w = Window.partitionBy(*CELL, "cycle").orderBy("test_time_s", "seq")
    rows = samples.where("cycle IS NOT NULL").withColumn("_m", F.col("current_a") * sign)
    m = F.col("_m")
    rate = rows.groupBy(*CELL, "cycle").agg(
        F.count_if(m > 0).alias("n_right"), F.percentile(F.when(m > 0, m), 0.5).alias("_median"),
        F.max(m).alias("_peak"))
    marked = rows.join(rate, [*CELL, "cycle"]).withColumn(
        "eligible", F.coalesce(m >= rate_fraction * F.col("_median"), F.lit(False)))
    was_on = F.coalesce(F.lag("eligible").over(w), F.lit(False))
    stepped = F.abs(m - F.lag("_m").over(w)) > rate_step * F.col("_peak")
    opens = F.col("eligible") & (~was_on | stepped)
    cut = marked.withColumn("run", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = F.col("voltage_v").isNotNull() & F.col("capacity_ah_counter").isNotNull()
    v, q = F.when(both, F.col("voltage_v")), F.when(both, F.col("capacity_ah_counter"))
    runs = cut.where("eligible").groupBy(*CELL, "cycle", "run").agg(
        F.count(F.lit(1)).alias("n_run"), F.count(v).alias("_n_finite"), (F.max(v) - F.min(v)).alias("_span"),
        F.min(q).alias("_q0"), F.percentile("current_a", 0.5).alias("run_current_a"))
    # A longer run wins, the earlier one on a tie.
    names = ["run", "n_run", "_n_finite", "_span", "_q0", "run_current_a"]
    best = runs.groupBy(*CELL, "cycle").agg(
        F.max_by(F.struct(*names), F.struct("n_run", -F.col("run"))).alias("_best")).select(*CELL, "cycle", "_best.*")
    n = F.coalesce("n_right", F.lit(0))
    refusal = (F.when(n == 0, f"no {phase} samples")
               .when(n < min_points, f"too few {phase} samples in the cycle")
               .when(F.col("n_run").isNull(), f"no constant-current {phase} run")
               .when(F.col("n_run") < min_points, "longest run too short")
               .when(F.col("_n_finite") < min_points, "too few pairs of voltage and charge")
               .when(F.col("_span") < min_span_v, "voltage span too small").otherwise(""))
    return CurveRuns(cut, rate.join(best, [*CELL, "cycle"], "left").withColumn("refusal", refusal))


def load_cross_check(phases: Phases, load_ohm: float) -> DataFrame:
    """(cell, phase, counted_ah, load_ah): the largest discharge, counted and from V/R of a known load."""
    top = phases.discharges.groupBy("cell_id").agg(
        F.max_by("phase_no", F.struct(F.round("charge_ah", 9), -F.col("phase_no"))).alias("phase_no"),
        F.max("charge_ah").alias("counted_ah"))
    rows = with_phase(phases, "discharge").join(top, ["cell_id", "phase_no"]).select(
        "cell_id", "phase_no", "counted_ah", "test_time_s", "seq", "voltage_v")
    placed = with_ordinal(rows, CELL, ["test_time_s", "seq"], F.floor(F.col("test_time_s") / phases.log.chunk_s))
    near = lagged(placed, CELL, "ordinal", {"_v": "voltage_v", "_t": "test_time_s"})
    step = (F.col("voltage_v") + F.col("_v")) / 2.0 / load_ohm * (F.col("test_time_s") - F.col("_t")) / 3600.0
    return near.groupBy("cell_id", "phase_no").agg(
        F.first("counted_ah").alias("counted_ah"), F.coalesce(F.sum(step), F.lit(0.0)).alias("load_ah")).withColumn(
        "ratio", F.try_divide("counted_ah", "load_ah"))
