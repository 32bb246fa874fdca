"""Charge, discharge and rest phases, and what is measured on them.

The samples are shuffled once, by (cell, time chunk). Inside a chunk
consecutive samples with one label become a partial run; from there on only
the run table is used, which has one row per run instead of one per sample.
Runs that a chunk border cut are joined again, so the chunk length never
changes a result, and a battery that holds a third of all samples is spread
over its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import BLOCK_ROWS, near_window, running, running_total
from voltloom.session import join_side, staged

REST_BELOW_A = 0.5
MIN_PHASE_SAMPLES = 3
COMPLETE_FRACTION = 0.80
DAY_S = 86_400.0

CELL = ["cell_id"]


def label_of(current: Column, rest_below_a: float | Column = REST_BELOW_A) -> Column:
    return (F.when(current.isNull() | (F.abs(current) < rest_below_a), "rest")
            .when(current < 0, "discharge").otherwise("charge"))


@dataclass(frozen=True)
class Log:
    """An elapsed-time log and how it is cut: order is (test_time_s, seq)."""

    df: DataFrame
    chunk_s: float = DAY_S
    rest_below_a: float = REST_BELOW_A
    min_samples: int = MIN_PHASE_SAMPLES

    def labelled(self) -> DataFrame:
        """Samples with their chunk, partial run and trapezoid step.

        ``step_ah`` is the charge since the last finite sample of the same
        partial run; ``step_q`` the same with the mean current's magnitude.
        ``_opens`` and ``_closes`` mark a partial run's first and last sample,
        ``_fin0_i`` is the current of its first finite sample, and
        ``_fin1_i``, at its last sample, that of its last finite one.
        """
        missing = [c for c in ("cell_id", "test_time_s", "current_a") if c not in self.df.columns]
        if missing:
            raise ValueError(f"segmentation needs {missing}; neither can be inferred")
        df = self.df if "seq" in self.df.columns else self.df.withColumn("seq", F.lit(0))
        # The hash goes first, made after the shuffle: sorting compares one number for nearly all pairs.
        w = Window.partitionBy("_spot", "cell_id", "_chunk").orderBy("test_time_s", "seq")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        t, i, label = F.col("test_time_s"), F.col("current_a"), F.col("_label")

        def finite_before(c: Column) -> Column:
            return F.last(F.when(i.isNotNull(), c), ignorenulls=True).over(earlier)

        marked = df.where(t.isNotNull()).withColumns({
            "_chunk": F.floor(t / self.chunk_s),
            "_label": label_of(i, self.rest_below_a),
        }).repartition("cell_id", "_chunk").withColumn("_spot", F.xxhash64("cell_id", "_chunk"))
        seen = marked.withColumns({
            "_opens": ~F.lag("_label").over(w).eqNullSafe(label),
            "_closes": ~F.lead("_label").over(w).eqNullSafe(label),
            "_prev_t": finite_before(t), "_prev_i": finite_before(i), "_prev_label": finite_before(label),
        })
        # Samples between the last finite one and this one are rests: both are of one run
        # when their labels are equal and no run opens here.
        same = ~F.col("_opens") & F.coalesce(F.col("_prev_label") == label, F.lit(False))
        linked = i.isNotNull() & same
        dt = (t - F.col("_prev_t")) / 3600.0
        before = F.col("_prev_i")
        return seen.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(so_far)).withColumns({
            "step_ah": F.when(linked, (F.abs(i) + F.abs(before)) / 2.0 * dt).otherwise(F.lit(0.0)),
            "step_q": F.when(linked, F.abs((i + before) / 2.0) * dt).otherwise(F.lit(0.0)),
            "_fin0_i": F.when(~same, i),
            "_fin1_i": F.when(F.col("_closes"), F.coalesce(i, F.when(same, before))),
        }).drop("_spot", "_prev_t", "_prev_i", "_prev_label")


def stored_samples(log: Log) -> DataFrame:
    """The labelled samples with the columns that phases are measured by, written once."""
    samples = log.labelled()
    channels = [c for c in ("voltage_v", "temperature_c", "soc") if c in samples.columns]
    return staged(samples.select(
        "cell_id", "test_time_s", "seq", "current_a", *channels, "_chunk", "_run", "_label", "_opens", "_closes",
        "step_ah", "step_q", "_fin0_i", "_fin1_i"))


def partial_runs(s: DataFrame) -> DataFrame:
    """One row per run of equal labels inside a chunk, from labelled samples.

    The marks of the samples make a run's first and last values sums of plain
    numbers, which a hash aggregate takes without sorting or comparing structs.
    """
    at = F.struct("test_time_s", "seq")
    t, i = F.col("test_time_s"), F.col("current_a")

    def only(mark: str, c: str) -> Column:
        return F.max(F.when(F.col(mark), F.col(c)))

    aggs = [
        F.count(F.lit(1)).alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"),
        F.sum("step_ah").alias("ah"), F.sum("step_q").alias("q"),
        F.sum(i).alias("i_sum"), F.count(i).alias("i_n"),
        F.when(F.count(i) > 0, F.struct(F.min(F.when(i.isNotNull(), t)).alias("t"), F.max("_fin0_i").alias("i"))).alias("fin0"),
        F.when(F.count(i) > 0, F.struct(F.max(F.when(i.isNotNull(), t)).alias("t"), F.max("_fin1_i").alias("i"))).alias("fin1"),
    ]
    if "voltage_v" in s.columns:
        aggs += [F.struct(end(t).alias("t"), only(mark, "current_a").alias("i"), only(mark, "voltage_v").alias("v")).alias(name)
                 for name, end, mark in (("raw0", F.min, "_opens"), ("raw1", F.max, "_closes"))]
    if "temperature_c" in s.columns:
        aggs += [F.sum("temperature_c").alias("temp_sum"), F.count("temperature_c").alias("temp_n"),
                 F.max("temperature_c").alias("temp_max")]
    if "soc" in s.columns:
        has = F.when(F.col("soc").isNotNull(), at)
        aggs += [F.min_by("soc", has).alias("soc0"), F.max_by("soc", has).alias("soc1")]
    return s.groupBy(F.col("cell_id"), F.col("_chunk").alias("chunk"), F.col("_run").alias("run"),
                     F.col("_label").alias("label")).agg(*aggs)


def numbered_runs(runs: DataFrame) -> DataFrame:
    """``run_no`` counts the runs of a cell over all its chunks.

    The starts, a row per chunk, are staged: with their size known, a join
    never gathers the runs instead of them, nor the starts of many chunks.
    """
    starts = join_side(staged(runs.groupBy("cell_id", "chunk").agg(F.max("run").alias("_n")).select(
        "cell_id", "chunk", F.coalesce(F.sum("_n").over(
            Window.partitionBy("cell_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_start"))))
    return runs.join(starts, ["cell_id", "chunk"]).withColumn(
        "run_no", F.col("_start") + F.col("run")).drop("_start")


@dataclass(frozen=True)
class Phases:
    """Run table with phase numbers, and the phase table.

    The numbered phases of a kind are staged when first asked for: curves and
    steps use the same.
    """

    log: Log
    runs: DataFrame
    table: DataFrame
    size: int | None = None   # None: every cell has few runs, plain windows are safe
    samples: DataFrame | None = None   # the labelled samples, where they are stored

    @cached_property
    def discharges(self) -> DataFrame:
        return staged(numbered(self.table, "discharge", self.size))

    @cached_property
    def charges(self) -> DataFrame:
        return staged(numbered(self.table, "charge", self.size))


def _bridge(now: Column, before: Column, signed: bool) -> Column:
    """Trapezoid between the last finite sample before a border and the first after."""
    dt = (now["t"] - before["t"]) / 3600.0
    mean = (F.abs(now["i"]) + F.abs(before["i"])) / 2.0
    if signed:
        mean = F.abs((now["i"] + before["i"]) / 2.0)
    return F.coalesce(mean * dt, F.lit(0.0))


def _kept_label(min_samples: int) -> Column:
    """The label of a run that is long enough, counting its parts across chunk borders.

    Every part has a sample, so ``min_samples - 1`` neighbours on each side
    decide. The first run of a cell is kept at any length.
    """
    label, reach = F.col("label"), min_samples - 1
    length, first = F.col("n"), F.col("run_no") == 1
    for side in ("b", "a"):
        joined = F.lit(True)
        for k in range(1, reach + 1):
            near = F.col(f"_{side}{k}")
            joined = joined & F.coalesce(near["label"] == label, F.lit(False))
            length = length + F.when(joined, near["n"]).otherwise(F.lit(0))
            if side == "b":
                first = first | (joined & (F.col("run_no") == k + 1))
    return F.when((length >= min_samples) | first, label)


def segment(log: Log, limit: int | None = None, store: bool = False) -> Phases:
    """Runs shorter than ``min_samples`` take the label before them, then equal labels merge.

    With ``store`` the labelled samples are written once, for ``with_phase`` to
    read again; of the log's own columns they keep the channels alone.
    """
    samples = stored_samples(log) if store else None
    stored = staged(partial_runs(log.labelled() if samples is None else samples))
    size = BLOCK_ROWS if limit is None else limit
    runs = numbered_runs(stored)
    volts = "raw1" in runs.columns
    reach = log.min_samples - 1
    near = F.struct("label", "n")
    around = {f"_b{k}": (F.lag(near, k), None, None) for k in range(1, reach + 1)}
    around.update({f"_a{k}": (F.lead(near, k), None, None) for k in range(1, reach + 1)})
    if volts:
        around["raw_before"] = (F.lag("raw1", 1), None, None)
    depth = max(reach, 1)
    close = near_window(runs, CELL, "run_no", around, before=depth, after=depth, size=size, block="_at").withColumn(
        "_kept", _kept_label(log.min_samples)).drop(*[c for c in around if c != "raw_before"])
    past = staged(running(close, CELL, "run_no", before=True, size=size, block="_at", fills={
        "_kept_before": F.col("_kept"),
        "_fin": F.when(F.col("fin1").isNotNull(), F.struct("run_no", "fin1"))}))
    turn = F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col("_kept_before"))
    placed = running(past, CELL, "run_no", size=size, sums={"phase_no": turn.cast("int")},
                     maxima={"_phase_start": F.when(turn, F.col("run_no"))})
    same = F.col("_fin.run_no") >= F.col("_phase_start")
    linked = placed.withColumns({
        "kind": F.coalesce("_kept", "_kept_before"),
        "gap_ah": F.when(same, _bridge(F.col("fin0"), F.col("_fin.fin1"), False)).otherwise(0.0),
        "gap_q": F.when(same, _bridge(F.col("fin0"), F.col("_fin.fin1"), True)).otherwise(0.0),
    }).drop("_kept", "_kept_before", "_fin", "_phase_start", "fin0", "fin1")
    linked = staged(linked)
    return Phases(log, linked, staged(phase_table(linked)), size, samples)


def phase_table(runs: DataFrame) -> DataFrame:
    """One row per phase from its runs."""
    first = F.col("run_no")
    aggs = [
        F.min("t0").alias("start_time_s"), F.max("t1").alias("end_time_s"),
        (F.sum("ah") + F.sum("gap_ah")).alias("charge_ah"),
        (F.sum("q") + F.sum("gap_q")).alias("curve_ah"),
        F.try_divide(F.sum("i_sum"), F.sum("i_n")).alias("mean_current_a"),
        F.sum("n").alias("n_samples"),
    ]
    have = set(runs.columns)
    if "raw0" in have:
        aggs += [F.min_by("raw0", first).alias("first_sample"),
                 F.min_by("raw_before", first).alias("sample_before")]
    if "temp_n" in have:
        aggs += [F.try_divide(F.sum("temp_sum"), F.sum("temp_n")).alias("avg_temp"),
                 F.max("temp_max").alias("max_temp")]
    if "soc0" in have:
        aggs += [F.min_by("soc0", F.when(F.col("soc0").isNotNull(), first)).alias("soc_start"),
                 F.max_by("soc1", F.when(F.col("soc1").isNotNull(), first)).alias("soc_end")]
    return runs.groupBy("cell_id", "phase_no", "kind").agg(*aggs)


def numbered(phases: DataFrame, kind: str, size: int | None = 65_536) -> DataFrame:
    """The phases of one kind, numbered 1.. per cell as ``cycle``."""
    counted = running_total(phases, CELL, "phase_no", {
        "cycle": (F.col("kind") == kind).cast("int")}, size)
    return counted.where(F.col("kind") == kind)


def measure_cycles(discharges: DataFrame, complete_fraction: float = COMPLETE_FRACTION) -> DataFrame:
    """Capacity per discharge; complete at 0.8 of the cell's largest."""
    largest = discharges.groupBy("cell_id").agg(F.max("charge_ah").alias("largest_ah"))
    out = discharges.join(largest, "cell_id")
    share = F.coalesce(F.try_divide(F.col("charge_ah"), F.col("largest_ah")), F.lit(0.0))
    complete = share >= complete_fraction
    # java's %g differs from C's: amounts are shown with four decimals
    reason = F.format_string(
        "partial discharge: moved %.4f Ah, %.0f%% of the largest observed for this cell (%.4f Ah)",
        F.col("charge_ah"), F.bround(share * 100, 0), F.col("largest_ah"))
    out = out.withColumns({
        "capacity_ah": F.col("charge_ah"), "is_complete": complete,
        "exclusion_reason": F.when(complete, "").otherwise(reason)})
    if "soc_start" in out.columns:
        out = out.withColumn("depth_of_discharge", F.abs(F.col("soc_start") - F.col("soc_end")))
    return out.drop("largest_ah", "charge_ah")


def cycle_frame(measured: DataFrame, complete_only: bool = True,
                size: int | None = 65_536) -> DataFrame:
    """All discharges, or only the complete ones renumbered 1.. per cell."""
    if not complete_only:
        return measured
    renumbered = running_total(measured.withColumnRenamed("cycle", "discharge_no"), CELL,
                               "discharge_no", {"cycle": F.col("is_complete").cast("int")}, size)
    return renumbered.where("is_complete").drop("discharge_no")


def capacity_yield(measured: DataFrame) -> DataFrame:
    out = measured.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_discharges"), F.count_if("is_complete").alias("n_complete"),
        F.max("capacity_ah").alias("largest_ah"))
    return out.withColumns({
        "n_partial": F.col("n_discharges") - F.col("n_complete"),
        "usable_fraction": F.col("n_complete") / F.col("n_discharges")})


def with_phase(phases: Phases, kind: str | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Samples with their phase and the charge moved since the phase began.

    The run table says where each (chunk, run) belongs; samples keep the
    chunk partitioning of the labelling. ``numbers``, a row per (cell_id,
    phase_no), is joined to the run table, so that the samples are joined once.
    """
    runs = phases.runs
    if kind is not None:
        runs = runs.where(F.col("kind") == kind)
    samples = phases.log.labelled() if phases.samples is None else phases.samples
    places = _places(runs, phases.size)
    if numbers is not None:
        places = places.join(numbers, ["cell_id", "phase_no"])
    inside = Window.partitionBy("cell_id", "_chunk", "_run").orderBy("test_time_s", "seq").rowsBetween(
        Window.unboundedPreceding, 0)
    drop = [c for c in ("_opens", "_closes", "_fin0_i", "_fin1_i") if c in samples.columns]
    return samples.drop(*drop).withColumn("_local", F.sum("step_q").over(inside)).join(
        places, ["cell_id", "_chunk", "_run"]).withColumn("capacity_ah_curve", F.col("_offset") + F.col("_local"))


def _places(runs: DataFrame, size: int | None) -> DataFrame:
    """Where each (chunk, run) belongs, and the charge its phase moved before it."""
    moved = F.col("q") + F.col("gap_q")
    totals = running_total(runs.withColumn("_moved", moved), CELL, "run_no",
                           {"_upto": F.col("_moved")}, size)
    starts = totals.groupBy("cell_id", "phase_no").agg(
        F.min_by(F.col("_upto") - F.col("_moved"), F.col("run_no")).alias("_base"))
    return totals.join(starts, ["cell_id", "phase_no"]).select(
        "cell_id", F.col("chunk").alias("_chunk"), F.col("run").alias("_run"), "phase_no", "kind",
        (F.col("_upto") - F.col("q") - F.col("_base")).alias("_offset"))
