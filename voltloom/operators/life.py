"""Targets per cycle, cell screening, and remaining life by extrapolated fade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.ordered import (
    BLOCK_ROWS, exact_quantiles, lagged, near_window, running, spearman, with_ordinal,
)
from voltloom.session import staged

CELL = ["cell_id"]
CHUNK_CYCLES = 10_000
MIN_CYCLES = 10
REFERENCE_QUANTILE = 0.95
SOH_UPPER = 1.05
MAX_OVERSHOOT = 0.10
MAX_MEDIAN_STEP = 0.05
MIN_MEDIAN_SOH = 0.40
MIN_REFERENCE_OVER_MAX = 0.02
HORIZONS = (10, 20, 50)

EOL_THRESHOLD = 0.90
SMOOTH = 11
MIN_HISTORY = 30
MAX_HORIZON_RATIO = 2.0
MIN_SLOPE = 1e-6
STRIDE = 25


def in_cycle_order(df: DataFrame, size: int | None, out: str = "pos") -> DataFrame:
    """Rows of a cycle-level frame numbered per cell."""
    chunk = None if size is None else F.floor(F.col("cycle") / CHUNK_CYCLES)
    return with_ordinal(df, CELL, ["cycle"], chunk, out)


def screen_cells(frame: DataFrame) -> DataFrame:
    """Per cell: can its capacity series carry an SOH target, and why not.

    The first rule that fails gives the reason. The trend is reported, not judged.
    """
    size = BLOCK_ROWS
    rows = staged(in_cycle_order(frame.where("capacity_ah IS NOT NULL AND cycle IS NOT NULL")
                                 .select("cell_id", "cycle", "capacity_ah"), size))
    basic = rows.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_cycles"), F.max("capacity_ah").alias("_max"))
    ref = exact_quantiles(rows, CELL, "capacity_ah",
                          {"reference_capacity_ah": REFERENCE_QUANTILE, "_median_ah": 0.5})
    base = basic.join(ref, "cell_id")
    steps = lagged(rows, CELL, "pos", {"_was": "capacity_ah"}, size=size).withColumn(
        "_step", F.abs(F.col("capacity_ah") - F.col("_was")))
    step = exact_quantiles(steps, CELL, "_step", {"_median_step": 0.5})
    over = (rows.join(base.select("cell_id", "reference_capacity_ah"), "cell_id")
            .groupBy("cell_id").agg(F.avg(
                (F.try_divide(F.col("capacity_ah"), F.col("reference_capacity_ah")) > SOH_UPPER)
                .cast("double")).alias("_over")))
    trend = spearman(rows, CELL, "cycle", "capacity_ah").select(
        "cell_id", F.col("rho").alias("_rho"))
    all_cells = frame.select("cell_id").distinct()
    t = (all_cells.join(base, "cell_id", "left").join(over, "cell_id", "left")
         .join(step, "cell_id", "left").join(trend, "cell_id", "left"))
    r = F.col("reference_capacity_ah")
    few = F.coalesce(F.col("n_cycles"), F.lit(0)) < MIN_CYCLES
    no_ref = ~F.coalesce(r > 0, F.lit(False))
    tiny = F.try_divide(r, F.col("_max")) < MIN_REFERENCE_OVER_MAX
    early = few | no_ref | F.coalesce(tiny, F.lit(False))
    step_share = F.try_divide(F.col("_median_step"), r)
    median_soh = F.try_divide(F.col("_median_ah"), r)
    reason = (F.when(few, "too_few_cycles").when(no_ref, "no_reference_capacity")
              .when(tiny, "reference_far_below_maximum").when(F.col("_over") > MAX_OVERSHOOT, "overshoot")
              .when(step_share > MAX_MEDIAN_STEP, "steps_too_large")
              .when(median_soh < MIN_MEDIAN_SOH, "median_soh_too_low").otherwise(""))
    later = lambda c: F.when(~early, c)
    return t.select(
        "cell_id", (reason == "").alias("admissible"),
        F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"),
        F.when(~few, r).alias("reference_capacity_ah"),
        later(F.col("_over")).alias("overshoot_fraction"), later(F.col("_rho")).alias("capacity_cycle_rho"),
        later(step_share).alias("median_step_fraction"), later(median_soh).alias("median_soh"),
        reason.alias("reason"))


def add_targets(frame: DataFrame, horizons: tuple[int, ...] = HORIZONS, screen: bool = True) -> DataFrame:
    """soh, fade and fade over the next h rows; only where SOH is defined."""
    verdict = screen_cells(frame).select("cell_id", "reference_capacity_ah", "admissible")
    joined = frame.join(verdict, "cell_id", "left")
    admissible = F.coalesce("admissible", F.lit(False)) if screen else F.lit(True)
    raw = F.when((F.col("reference_capacity_ah") > 0) & admissible,
                 F.col("capacity_ah") / F.col("reference_capacity_ah"))
    out = joined.withColumn("soh_admissible", admissible).withColumn("_raw", raw).withColumns({
        "soh": F.when(F.col("_raw") <= SOH_UPPER, F.col("_raw")),
        "soh_outlier": F.coalesce(F.col("_raw") > SOH_UPPER, F.lit(False)),
    }).withColumn("cumulative_fade", 1.0 - F.col("soh")).drop("_raw", "admissible")
    size = BLOCK_ROWS
    ahead = near_window(in_cycle_order(out, size), CELL, "pos", {
        f"_f{h}": (F.lead("cumulative_fade", h), None, None) for h in horizons},
        after=max(horizons), size=size)
    return ahead.withColumns({
        f"horizon_fade_{h}": F.col(f"_f{h}") - F.col("cumulative_fade") for h in horizons
    }).drop("pos", *[f"_f{h}" for h in horizons])


@dataclass(frozen=True)
class Readings:
    """(cell, cycle, soh[, cohort]) numbered per cell, staged, with its block length."""

    df: DataFrame
    size: int | None


def soh_readings(frame: DataFrame) -> Readings:
    keep = [c for c in ("cell_id", "cohort", "cycle", "soh") if c in frame.columns]
    size = BLOCK_ROWS
    return Readings(staged(in_cycle_order(frame.select(*keep).where("soh IS NOT NULL"), size)), size)


def smoothed(readings: Readings, smooth: int = SMOOTH, name: str = "soh_smooth") -> DataFrame:
    """Centred running median, at least 3 readings; the window shrinks at the ends."""
    half = smooth // 2
    out = near_window(readings.df, CELL, "pos", {
        name: (F.percentile("soh", 0.5), -half, half), "_n": (F.count("soh"), -half, half)},
        before=half, after=half, size=readings.size)
    return out.withColumn(name, F.when(F.col("_n") >= 3, F.col(name))).drop("_n")


def observed_eol(smooth: DataFrame, threshold: float = EOL_THRESHOLD) -> DataFrame:
    """(cell, true_eol): first cycle whose smoothed SOH is at or below the threshold."""
    return smooth.groupBy("cell_id").agg(
        F.min(F.when(F.col("soh_smooth") <= threshold, F.col("cycle"))).alias("true_eol"),
        F.count(F.lit(1)).alias("n_readings"), F.min("cycle").alias("first_cycle"),
        *([F.first("cohort").alias("cohort")] if "cohort" in smooth.columns else []))


def fitted_history(readings: Readings, smooth: int = SMOOTH, window: int | None = None) -> DataFrame:
    """Per reading: the line through all smoothed readings up to it.

    The smoothing must not see past the reading. Only the last ``smooth // 2``
    medians of a cut history differ from those of the whole series, so a fit
    is the running sums up to there plus those few medians taken over frames
    that end at the reading: one pass, instead of refitting every history.
    """
    half = smooth // 2
    whole = staged(smoothed(readings, smooth))
    x, y = F.col("cycle").cast("double"), F.col("soh_smooth")
    seen = y.isNotNull()
    totals = running(whole, CELL, "pos", size=readings.size, sums={
        "_n": F.when(seen, 1).otherwise(0), "_x": F.when(seen, x), "_y": F.when(seen, y),
        "_xx": F.when(seen, x * x), "_xy": F.when(seen, x * y)})
    totals = staged(totals)
    names = ("_n", "_x", "_y", "_xx", "_xy")
    exprs: dict[str, tuple] = {f"{m}_t": (F.lag(m, half), None, None) for m in names}
    for k in range(half):
        exprs[f"_m{k}"] = (F.percentile("soh", 0.5), -(half + k), 0)
        exprs[f"_c{k}"] = (F.count("soh"), -(half + k), 0)
        exprs[f"_x{k}"] = (F.lag("cycle", k), None, None) if k else (F.max("cycle"), 0, 0)
    reach = 2 * half
    if window is not None:
        exprs.update({f"{m}_w": (F.lag(m, window), None, None) for m in names})
        reach = max(reach, window)
    exprs["next_cycle"] = (F.lead("cycle", 1), None, None)
    edge = near_window(totals, CELL, "pos", exprs, before=reach, after=1, size=readings.size)
    zero = F.lit(0.0)
    sums = {m: F.coalesce(F.col(f"{m}_t").cast("double"), zero) for m in names}
    if window is not None:
        sums = {m: s - F.coalesce(F.col(f"{m}_w").cast("double"), zero) for m, s in sums.items()}
    for k in range(half):
        ok = (F.col(f"_c{k}") >= 3) & F.col(f"_x{k}").isNotNull()
        xk, yk = F.col(f"_x{k}").cast("double"), F.col(f"_m{k}")
        for m, v in zip(names, (F.lit(1.0), xk, yk, xk * xk, xk * yk)):
            sums[m] = sums[m] + F.when(ok, v).otherwise(zero)
    out = edge.withColumns({f"_s{m}": s for m, s in sums.items()})
    n, sx, sy, sxx, sxy = (F.col(f"_s{m}") for m in names)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    keep = [c for c in ("cell_id", "cohort", "cycle", "soh", "pos", "soh_smooth", "next_cycle")
            if c in out.columns]
    return out.select(*keep, n.alias("n_fit"), slope.alias("slope"),
                      ((sy - slope * sx) / n).alias("intercept"))


def extrapolate(fits: DataFrame, at: Column, first_cycle: Column, threshold: float = EOL_THRESHOLD,
                min_history: int = MIN_HISTORY, max_ratio: float = MAX_HORIZON_RATIO) -> DataFrame:
    """rul_cycles at ``at`` from the fitted line, or the reason there is none."""
    slope = F.col("slope")
    eol = F.try_divide(F.lit(threshold) - F.col("intercept"), slope)
    horizon, observed = eol - at, F.col("cycle") - first_cycle
    few = F.col("pos") < min_history
    thin = F.col("n_fit") < min_history
    flat = ~F.coalesce(-slope >= MIN_SLOPE, F.lit(False))
    past = eol <= at
    far = (observed > 0) & (horizon > max_ratio * observed)
    refusal = (F.when(few, "history_too_short").when(thin, "too_few_points_after_smoothing")
               .when(flat, "no_measurable_fade").when(past, "end_of_life_not_ahead")
               .when(far, "extrapolation_too_far").otherwise(""))
    return fits.withColumns({
        "refusal": refusal,
        "eol_cycle": F.when(~few & ~thin & ~flat, eol),
        "slope_per_cycle": F.when(~few & ~thin, slope),
        "rul_cycles": F.when(few | thin | flat, None).when(past, F.lit(0.0)).when(far, None)
        .otherwise(horizon)})


def rul_error_table(frame: DataFrame, threshold: float = EOL_THRESHOLD, stride: int = STRIDE,
                    smooth: int = SMOOTH, window: int | None = None,
                    min_history: int = MIN_HISTORY) -> DataFrame:
    """An estimate every ``stride`` cycles against the observed end of life.

    A cell that never crosses is listed with that reason and no numbers.
    """
    readings = soh_readings(frame)
    fits = fitted_history(readings, smooth, window)
    ends = observed_eol(smoothed(readings, smooth), threshold).where(F.col("n_readings") >= min_history)
    joined = fits.join(ends.drop("cohort"), "cell_id").where("true_eol IS NOT NULL")
    # Every estimate falls on the last reading at or before it.
    low = F.greatest(F.col("cycle"), F.lit(min_history))
    start = min_history + F.ceil((low - min_history) / F.lit(float(stride))) * stride
    stop = F.least(F.coalesce(F.col("next_cycle"), F.col("true_eol")), F.col("true_eol")) - 1
    at = joined.withColumn("at", F.explode(F.when(start <= stop, F.sequence(
        start.cast("int"), stop.cast("int"), F.lit(stride)))))
    scored = extrapolate(at, F.col("at"), F.col("first_cycle"), threshold, min_history)
    cohort = F.col("cohort") if "cohort" in frame.columns else F.lit("")
    true = F.col("true_eol") - F.col("at")
    hits = scored.select(
        "cell_id", cohort.alias("cohort"), F.col("at").alias("cycle"), F.col("rul_cycles").alias("rul_pred"),
        true.cast("double").alias("rul_true"), (F.col("rul_cycles") - true).alias("error"),
        "slope_per_cycle", "refusal")
    never = ends.where("true_eol IS NULL").select(
        "cell_id", cohort.alias("cohort"), F.lit(None).cast("int").alias("cycle"),
        *[F.lit(None).cast("double").alias(c) for c in ("rul_pred", "rul_true", "error", "slope_per_cycle")],
        F.lit("never_crosses").alias("refusal"))
    return hits.unionByName(never)


def rul_now(cycle_capacity: DataFrame, threshold: float = EOL_THRESHOLD, reference: int = 5,
            smooth: int = SMOOTH) -> DataFrame:
    """Remaining life at each cell's newest cycle, SOH against its own first cycles."""
    from voltloom.operators.curves import first_rows

    frame = cycle_capacity.where("cycle IS NOT NULL AND capacity_ah IS NOT NULL")
    ref = first_rows(frame, CELL, ["cycle"], reference).groupBy("cell_id").agg(
        F.percentile("capacity_ah", 0.5).alias("_ref"))
    ratio = frame.join(ref, "cell_id").withColumn(
        "soh", F.when(F.col("_ref") > 0, F.col("capacity_ah") / F.col("_ref")))
    readings = soh_readings(ratio)
    ends = readings.df.groupBy("cell_id").agg(F.min("cycle").alias("first_cycle"), F.max("cycle").alias("_last"))
    newest = fitted_history(readings, smooth).join(ends, "cell_id").where("cycle = _last")
    return extrapolate(newest, F.col("cycle"), F.col("first_cycle"), threshold).select(
        "cell_id", F.col("cycle").alias("at_cycle"), "rul_cycles", "eol_cycle", "slope_per_cycle",
        F.col("pos").alias("n_history"), "refusal")


def ground_truth_fade(frame: DataFrame) -> DataFrame:
    """Per cell with 5 cycles or more: first capacity, fade rate, fit, 80 % crossing."""
    from voltloom.operators.curves import first_rows

    rows = frame.select("cell_id", "cycle", "capacity_ah").where("capacity_ah IS NOT NULL").dropDuplicates()
    start = first_rows(rows, CELL, ["cycle"], 3).groupBy("cell_id").agg(
        F.avg("capacity_ah").alias("initial_capacity_ah"))
    x, y = F.col("cycle").cast("double"), F.col("capacity_ah")
    return rows.join(start, "cell_id").groupBy("cell_id", "initial_capacity_ah").agg(
        F.count(F.lit(1)).alias("n_cycles"), (-F.regr_slope(y, x)).alias("fade_rate"),
        F.regr_r2(y, x).alias("r_squared"),
        F.min(F.when(y <= 0.8 * F.col("initial_capacity_ah"), F.col("cycle"))).alias("eol_cycle"),
    ).where("n_cycles >= 5").withColumn("reached_eol", F.col("eol_cycle").isNotNull())


def initial_capacity_and_loss(frame: DataFrame, first: int = 5) -> DataFrame:
    """initial = median of the first cycles, loss against it, and SOH in PERCENT."""
    from voltloom.operators.curves import first_rows

    start = first_rows(frame.where("capacity_ah IS NOT NULL"), CELL, ["cycle"], first).groupBy("cell_id").agg(
        F.percentile("capacity_ah", 0.5).alias("initial_capacity_ah"))
    c0 = F.col("initial_capacity_ah")
    return frame.join(start, "cell_id", "left").withColumns({
        "capacity_loss_ah": c0 - F.col("capacity_ah"),
        "soh_pct": F.when(c0 > 0, 100.0 * F.col("capacity_ah") / c0)})


def trailing_features(frame: DataFrame, columns: tuple[str, ...], rows: int = 5, least: int = 2) -> DataFrame:
    """Mean of the previous ``rows`` cycles (this one excluded), and the loss since the last."""
    exprs: dict[str, tuple] = {}
    for c in columns:
        exprs[f"trailing_{c}"] = (F.avg(c), -rows, -1)
        exprs[f"_n_{c}"] = (F.count(c), -rows, -1)
    exprs["_was"] = (F.lag("capacity_ah", 1), None, None)
    size = BLOCK_ROWS
    out = near_window(in_cycle_order(frame, size), CELL, "pos", exprs, before=rows, size=size)
    return out.withColumns({
        **{f"trailing_{c}": F.when(F.col(f"_n_{c}") >= least, F.col(f"trailing_{c}")) for c in columns},
        "capacity_loss": -(F.col("capacity_ah") - F.col("_was")),
    }).drop("pos", "_was", *[f"_n_{c}" for c in columns])


def horizon_pairs(frame: DataFrame, horizon: int) -> DataFrame:
    """Each row with the same cell's row exactly ``horizon`` cycles later."""
    later = frame.select("cell_id", (F.col("cycle") - horizon).alias("cycle"),
                         F.col("capacity_ah").alias("_later"))
    return frame.join(later, ["cell_id", "cycle"]).withColumn(
        "capacity_loss_h", F.col("capacity_ah") - F.col("_later")).drop("_later")


# Intercept and slope of the fitted loss model, Ah per cycle.
LOSS_INTERCEPT, LOSS_PER_DEGREE = -0.0209, 0.0038


def predicted_loss(frame: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Linear loss per cycle; an unknown cohort takes the mean adjustment.

    ``adjustments`` is (cohort, adjustment): one row per cohort.
    """
    mean = adjustments.agg(F.avg("adjustment")).scalar()
    joined = frame.join(adjustments, "cohort", "left")
    shift = F.coalesce(F.col("adjustment"), mean)
    return joined.withColumn(
        "capacity_loss_predicted",
        F.lit(LOSS_INTERCEPT) + shift + LOSS_PER_DEGREE * F.col("trailing_avg_temp")).drop("adjustment")
