"""Fade-rate and life-curve priors over a fleet, and posteriors on a grid.

A history enters only through a few sums, so a grid is laid over one small
row per (cell, estimate), never over the readings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import exact_quantiles, lagged, with_ordinal
from voltloom.session import staged

THRESHOLD = 0.90
SD_FLOOR = 0.25
GRID_POINTS, GRID_SPAN_SD = 801, 5.0
SIGMA_FLOOR, SIGMA_DEFAULT, MIN_FOR_SIGMA = 0.005, 0.01, 10
SHAPES = tuple(round(0.3 + 0.05 * i, 10) for i in range(55))


def _to_crossing(readings: DataFrame, threshold: float) -> DataFrame:
    """Readings up to each cell's first one at or below the threshold, x from its first cycle."""
    ends = readings.groupBy("cell_id").agg(
        F.min("cycle").alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("soh") <= threshold, F.col("cycle"))).alias("_cross"))
    return readings.join(ends.where("_n >= 5"), "cell_id").where(
        F.col("_cross").isNull() | (F.col("cycle") <= F.col("_cross"))).withColumns({
            "_x": (F.col("cycle") - F.col("_first")).cast("double"), "_f": 1.0 - F.col("soh")})


def fade_rates(readings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cell_id, fade_rate): least squares of 1-SOH on cycles through the origin; null when it never fades."""
    rows = _to_crossing(readings, threshold)
    k = F.try_divide(F.sum(F.col("_x") * F.col("_f")), F.sum(F.col("_x") * F.col("_x")))
    return rows.groupBy("cell_id").agg(k.alias("_k")).select(
        "cell_id", F.when(F.col("_k") > 0, F.col("_k")).alias("fade_rate"))


def fade_prior(rates: DataFrame) -> DataFrame:
    """One row: mean and deviation of the log rate; null under three cells."""
    logs = F.ln("fade_rate")
    agg = rates.where("fade_rate > 0").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(logs).alias("_m"),
                                           F.stddev_samp(logs).alias("_s"))
    ok = F.col("n_cells") >= 3
    return agg.select("n_cells", F.when(ok, F.col("_m")).alias("log_mean"),
                      F.when(ok, F.greatest(F.col("_s"), F.lit(SD_FLOOR))).alias("log_sd"))


def life_curves(readings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cell_id, life, shape): fade = c x^p with p on a grid, c in closed form, least error kept.

    The readings are reduced to two sums per grid value in one aggregate.
    """
    rows = _to_crossing(readings, threshold)
    x, f = F.col("_x"), F.col("_f")
    aggs = [F.sum(f * f).alias("_ff")]
    for i, p in enumerate(SHAPES):
        xp = F.pow(x, F.lit(p))
        aggs += [F.sum(xp * f).alias(f"_a{i}"), F.sum(xp * xp).alias(f"_b{i}")]
    sums = rows.groupBy("cell_id").agg(*aggs)
    fits = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_a{i}").alias("a"), F.col(f"_b{i}").alias("b"))
                     for i, p in enumerate(SHAPES)])
    long = sums.select("cell_id", "_ff", F.inline(fits)).where("b > 0 AND a > 0")
    scored = long.withColumns({"c": F.col("a") / F.col("b"), "sse": F.col("_ff") - F.col("a") * F.col("a") / F.col("b")})
    best = scored.groupBy("cell_id").agg(F.min_by(F.struct("c", "p"), F.struct("sse", "p")).alias("s"))
    return best.select("cell_id", F.pow((1.0 - threshold) / F.col("s.c"), 1.0 / F.col("s.p")).alias("life"),
                       F.col("s.p").alias("shape"))


def _residual_sigma(history: DataFrame, keys: list[str]) -> DataFrame:
    """Noise per estimate: 1.4826 MAD of the residuals of a line, with floor and default."""
    fit = history.groupBy(*keys).agg(F.regr_slope("soh", "_dx").alias("_m"), F.regr_intercept("soh", "_dx").alias("_b"),
                                     F.count(F.lit(1)).alias("_n"), (F.max("_dx") - F.min("_dx")).alias("_ptp"))
    res = history.join(fit, keys).withColumn("_r", F.col("soh") - (F.col("_b") + F.col("_m") * F.col("_dx")))
    mid = exact_quantiles(res, keys, "_r", {"_mid": 0.5})
    off = res.join(mid, keys).withColumn("_o", F.abs(F.col("_r") - F.col("_mid")))
    mad = exact_quantiles(off, keys, "_o", {"_mad": 0.5})
    thin = (F.col("_n") < MIN_FOR_SIGMA) | (F.col("_ptp") == 0)
    return fit.join(mad, keys, "left").select(*keys, F.when(thin, SIGMA_DEFAULT).otherwise(
        F.greatest(1.4826 * F.col("_mad"), F.lit(SIGMA_FLOOR))).alias("sigma"))


def posterior_rul(history: DataFrame, prior: DataFrame, threshold: float = THRESHOLD,
                  coverage: float = 0.80) -> DataFrame:
    """Remaining cycles per (cell_id, at_cycle): median and interval of the grid posterior.

    ``history`` holds the readings at or before each estimate (cell_id,
    at_cycle, cycle, soh); ``prior`` is the one-row fade prior.
    """
    keys = ["cell_id", "at_cycle"]
    first = history.groupBy(*keys).agg(F.min("cycle").alias("_x0"))
    rows = history.join(first, keys).withColumn("_dx", (F.col("cycle") - F.col("_x0")).cast("double"))
    f = 1.0 - F.col("soh")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_readings"), F.sum(f * f).alias("_ff"), F.sum(F.col("_dx") * f).alias("_xf"),
        F.sum(F.col("_dx") * F.col("_dx")).alias("_xx"), F.first("_x0").alias("_x0"))
    point = sums.join(_residual_sigma(rows, keys), keys)
    p = prior.select(F.struct("log_mean", "log_sd")).scalar()
    grid = point.withColumn("_p", p).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    half = GRID_SPAN_SD * F.col("_p.log_sd")
    log_k = F.col("_p.log_mean") - half + F.col("_i") * (2.0 * half / (GRID_POINTS - 1))
    z = (log_k - F.col("_p.log_mean")) / F.col("_p.log_sd")
    k = F.exp(log_k)
    sse = F.col("_ff") - 2.0 * k * F.col("_xf") + k * k * F.col("_xx")
    like = F.when(F.col("n_readings") > 1, -0.5 * sse / (F.col("sigma") * F.col("sigma"))).otherwise(0.0)
    elapsed = F.col("at_cycle") - F.col("_x0")
    rul = F.greatest((1.0 - threshold) / k - elapsed, F.lit(0.0))
    laid = grid.select(*keys, "n_readings", "sigma", "_i", (-0.5 * z * z + like).alias("_lp"), rul.alias("_rul"))
    own = Window.partitionBy(*keys)          # 801 grid rows per estimate
    weighed = laid.withColumn("_w", F.exp(F.col("_lp") - F.max("_lp").over(own)))
    order = own.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    cdf = weighed.withColumn("_cdf", F.sum("_w").over(order) / F.sum("_w").over(own))
    tail = (1.0 - coverage) / 2.0
    at = lambda q: F.min(F.when(F.col("_cdf") >= q - 1e-12, F.col("_rul")))
    return cdf.groupBy(*keys).agg(at(0.5).alias("median"), at(tail).alias("lower"), at(1.0 - tail).alias("upper"),
                                  F.first("n_readings").alias("n_readings"), F.first("sigma").alias("sigma"))


# Bands seen in validation, by predicted remaining cycles.
# (low, high, later_q05, later_q50, later_q95, share_at_least, n, cells)
RUL_BANDS = (
    (0.0, 25.0, 1.0, 23.0, 82.0, 0.95, 78, 15),
    (25.0, 50.0, -14.0, 40.0, 129.0, 0.88, 52, 14),
    (50.0, 100.0, -40.0, 60.0, 141.0, 0.85, 85, 12),
    (100.0, 200.0, -86.0, 4.0, 167.0, 0.51, 71, 7),
    (200.0, 100000.0, -109.0, 162.0, 179.0, 0.63, 30, 2),
)


def rul_band(predicted: Column) -> Column:
    """The validation band of a predicted remaining life, as a struct."""
    def band(b: tuple) -> Column:
        names = ("low", "high", "later_q05", "later_q50", "later_q95", "share_at_least", "n", "cells")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, b)])
    out = None
    for b in RUL_BANDS[:-1]:
        hit = (predicted >= b[0]) & (predicted < b[1])
        out = F.when(hit, band(b)) if out is None else out.when(hit, band(b))
    return out.when(predicted.isNotNull(), band(RUL_BANDS[-1]))


def with_rul_band(df: DataFrame, predicted: str = "rul_pred") -> DataFrame:
    p = F.col(predicted)
    out = df.withColumn("_band", rul_band(p))
    b = F.col("_band")
    span = F.when(b["high"] >= 100_000, F.format_string("%.0f+", b["low"])).otherwise(
        F.format_string("%.0f-%.0f", b["low"], b["high"]))
    low, high = F.greatest(p + b["later_q05"], F.lit(0.0)), p + b["later_q95"]
    text = F.concat(
        F.lit("In validation, when the estimate was "), span, F.lit(" cycles, the true remaining life fell between "),
        F.format_string("%.0f", F.bround(low, 0)), F.lit(" and "), F.format_string("%.0f", F.bround(high, 0)),
        F.lit(" cycles in 90% of cases, and the cell lasted at least as long as predicted "),
        F.format_string("%.0f%%", b["share_at_least"] * 100), F.lit(" of the time"),
        F.when(b["cells"] < 5, " (few cells at this range)").otherwise(""), F.lit("."))
    return out.withColumns({"band_low": low, "band_high": high, "band_text": text}).drop("_band")



def sibling_fit(train: DataFrame) -> DataFrame:
    """One row (a, b, q10, median_life, q10_life, n): log life on log early rate over cells that crossed.

    q10 is taken over leave-one-cell-out residuals; for a line these are the
    plain residuals over one minus the leverage, so nothing is refitted.
    """
    crossed = train.where("crossed AND life > 0")
    logs = crossed.where("early_rate > 0").select(
        F.ln("early_rate").alias("x"), F.ln("life").alias("y"))
    line = logs.agg(F.struct(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mx"),
        (F.var_pop("x") * F.count(F.lit(1))).alias("sxx"), F.count(F.lit(1)).alias("n"))).scalar()
    placed = logs.withColumn("_f", line)
    share = 1.0 / F.col("_f.n") + F.try_divide(F.pow(F.col("x") - F.col("_f.mx"), F.lit(2.0)), F.col("_f.sxx"))
    left_out = placed.select("_f", F.try_divide(
        F.col("y") - F.col("_f.a") - F.col("_f.b") * F.col("x"), 1.0 - share).alias("_e"))
    low = exact_quantiles(left_out, [], "_e", {"q10": 0.1}).select("q10").scalar()
    lives = exact_quantiles(crossed, [], "life", {"median_life": 0.5, "q10_life": 0.1})
    return lives.select("median_life", "q10_life").withColumn("_f", line).withColumn("q10", low).select(
        F.col("_f.a").alias("a"), F.col("_f.b").alias("b"), "q10", "median_life", "q10_life", F.col("_f.n").alias("n"))


def sibling_lives(train: DataFrame, test: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Test cells with three predictions: the siblings' median, own early rate kept up, and the fit with its bound."""
    fit = sibling_fit(train).select(F.struct("a", "b", "q10", "median_life", "q10_life")).scalar()
    rate = F.when(F.col("early_rate") > 0, F.col("early_rate"))
    own = F.exp(F.col("_f.a") + F.col("_f.b") * F.ln(rate))
    return test.withColumn("_f", fit).withColumns({
        "sibling_median": F.col("_f.median_life"), "sibling_bound": F.col("_f.q10_life"),
        "own_rate": (1.0 - threshold) / rate, "fitted": own, "fitted_bound": own * F.exp("_f.q10")}).drop("_f")


def sibling_scores(lives: DataFrame) -> DataFrame:
    """Median relative errors on cells that crossed, and how often the bound holds.

    A cell that never crossed counts for the bound only if it outlived it.
    """
    off = {c: F.when(F.col("crossed"), F.abs(F.col(c) - F.col("life")) / F.col("life")) for c in
           ("sibling_median", "own_rate", "fitted")}
    held = F.when(F.col("crossed"), F.col("life") >= F.col("fitted_bound")).when(
        F.col("life") >= F.col("fitted_bound"), F.lit(True))
    rows = lives.select("crossed", held.cast("double").alias("_held"), *[v.alias(f"_{c}") for c, v in off.items()])
    out = rows.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("crossed").alias("n_crossed"),
                   F.avg("_held").alias("bound_coverage"))
    for c in off:
        middle = exact_quantiles(rows, [], f"_{c}", {"m": 0.5}).select("m").scalar()
        out = out.withColumn(f"{c}_error", middle)
    return out


# -- life and shape on a grid -------------------------------------------------
LIFE_POINTS = 241
SHAPE_SD_FLOOR, LARGEST_RHO = 0.2, 0.95
#: Without a population: the middle and half width of the log life's grid.
FLAT_LOG_LIFE, FLAT_HALF = 6.214608098422191, 6.0
TAIL = 1e-4
ESTIMATE = ["cell_id", "at_cycle"]
PRIOR = ("log_life_mean", "log_life_sd", "shape_mean", "shape_sd")


def life_prior(lives: DataFrame) -> DataFrame:
    """One row: mean and deviation of log life and of shape over cells; null under three cells."""
    logs = F.ln("life")
    agg = lives.where("life > 0 AND shape IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(logs).alias("_m"), F.stddev_samp(logs).alias("_s"),
        F.avg("shape").alias("_pm"), F.stddev_samp("shape").alias("_ps"))
    ok = F.col("n_cells") >= 3
    return agg.select("n_cells", F.when(ok, F.col("_m")).alias("log_life_mean"),
                      F.when(ok, F.greatest("_s", F.lit(SD_FLOOR))).alias("log_life_sd"),
                      F.when(ok, F.col("_pm")).alias("shape_mean"),
                      F.when(ok, F.greatest("_ps", F.lit(SHAPE_SD_FLOOR))).alias("shape_sd"))


def _power_sums(rows: DataFrame, first: Column, step: Column) -> DataFrame:
    """Per estimate, for each shape of its grid: sums of x^p f and of x^2p. One aggregate over the history."""
    shapes = [first + j * step for j in range(len(SHAPES))]
    power = [F.pow("_dx", p) for p in shapes]
    return rows.groupBy(*ESTIMATE).agg(
        F.array(*[F.sum(x * F.col("_f")) for x in power]).alias("_xf"), F.array(*[F.sum(x * x) for x in power]).alias("_xx"))


class _Grid:
    """The grid of one estimate, log life by shape: squared errors and log priors, from the estimate's sums alone.

    The error at (L, p), with c = (1 - threshold) / L^p, is ff - 2 c xf + c^2 xx.
    """

    def __init__(self, row, threshold: float):
        self.log_life = row["_l0"] + np.arange(LIFE_POINTS) * row["_l_step"]
        self.shape = row["_p0"] + np.arange(len(SHAPES)) * row["_p_step"]
        c = (1.0 - threshold) * np.exp(-np.outer(self.log_life, self.shape))
        self.sse = row["_ff"] - 2.0 * c * np.asarray(row["_xf"], float) + c * c * np.asarray(row["_xx"], float)
        known = [row[f"_prior_{n}"] for n in PRIOR]
        mean, sd, middle, width = known
        if any(x is None or np.isnan(x) for x in known):
            self.log_prior = np.zeros_like(self.sse)
        else:
            self.log_prior = -0.5 * ((self.log_life - mean) / sd)[:, None] ** 2 - 0.5 * ((self.shape - middle) / width) ** 2

    def likeliest(self) -> tuple[float, float]:
        merit = self.sse - 2.0 * SIGMA_DEFAULT ** 2 * self.log_prior
        i, j = np.unravel_index(np.argmin(np.where(np.isnan(merit), np.inf, merit)), merit.shape)
        return self.log_life[i], self.shape[j]

    def weights(self, has: bool, sigma: float) -> np.ndarray:
        """The posterior of each point; the largest is 1."""
        logs = self.log_prior - 0.5 * self.sse / (sigma * sigma) if has else self.log_prior
        return np.exp(logs - logs.max())


def _at(share: float, weights: np.ndarray, values: np.ndarray) -> float | None:
    """The smallest value at which the distribution function reaches the share."""
    reached = ~(np.cumsum(weights) / weights.sum() < share - 1e-12)
    return float(values[reached].min()) if reached.any() else None


def _per_estimate(points: DataFrame, threshold: float, columns: str, answer: Callable[[dict, _Grid], tuple]) -> DataFrame:
    """(estimate, columns): what ``answer`` reads from each estimate's grid, which lives in its task only."""
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = part.to_dict("records")
            with np.errstate(all="ignore"):
                found = [answer(r, _Grid(r, threshold)) for r in rows]
            yield pd.concat([part[ESTIMATE].reset_index(drop=True), pd.DataFrame(found, columns=names, dtype=float)], axis=1)

    of = dict(points.dtypes)
    slim = points.select(*ESTIMATE, "_l0", "_l_step", "_p0", "_p_step", "_ff", "_xf", "_xx", "_has", *(
        ["sigma"] if "sigma" in of else []), *(["_elapsed"] if "_elapsed" in of else []), *[
            F.col(f"_prior.{n}").alias(f"_prior_{n}") for n in PRIOR])
    return slim.mapInPandas(read, ", ".join(f"{c} {of[c]}" for c in ESTIMATE) + ", " + columns)


def _spans(row: dict, grid: _Grid) -> tuple:
    """Where the posterior lies along either axis, but for its tails."""
    weights = grid.weights(row["_has"], row["sigma"])
    out = []
    for margin, values in ((weights.sum(1), grid.log_life), (weights.sum(0), grid.shape)):
        high = _at(1 - TAIL, margin, values)
        out += [_at(TAIL, margin, values), values.max() if high is None else high]
    return tuple(out)


def _curve_noise(rows: DataFrame, best: DataFrame, threshold: float) -> DataFrame:
    """(estimate, sigma): misfit of the likeliest curve, widened for residuals that follow each other."""
    r = F.col("_f") - (1.0 - threshold) * F.pow(F.col("_dx") / F.exp("_best.log_life"), F.col("_best.shape"))
    res = with_ordinal(rows.join(best, ESTIMATE).withColumn("_r", -r), ESTIMATE, ["cycle", "soh"],
                       F.floor(F.col("cycle") / 65_536.0), "_no")
    follow = lagged(res, ESTIMATE, "_no", {"_before": "_r"})
    agg = follow.groupBy(*ESTIMATE).agg(
        F.count(F.lit(1)).alias("_n"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("_rms"),
        F.stddev_pop("_r").alias("_spread"), F.corr("_before", "_r").alias("_rho"))
    known = (F.col("_spread") > 0) & F.col("_rho").isNotNull() & ~F.isnan("_rho")
    rho = F.least(F.greatest(F.when(known, F.col("_rho")).otherwise(0.0), F.lit(0.0)), F.lit(LARGEST_RHO))
    sigma = F.greatest("_rms", F.lit(SIGMA_FLOOR)) * F.sqrt((1.0 + rho) / (1.0 - rho))
    return agg.select(*ESTIMATE, F.when(F.col("_n") >= MIN_FOR_SIGMA, sigma).otherwise(SIGMA_DEFAULT).alias("_noise"))


def posterior_life(history: DataFrame, prior: DataFrame | None = None, threshold: float = THRESHOLD,
                   coverage: float = 0.80) -> DataFrame:
    """Remaining cycles per (cell_id, at_cycle) under a fade (1 - threshold) (x / life)^shape.

    ``history`` holds the readings at or before each estimate (cell_id,
    at_cycle, cycle, soh), ``prior`` the row of ``life_prior``; without one, or
    with null in it, every life and shape is as likely. A coarse grid over the
    prior's range gives the noise (of the likeliest curve's residuals) and the
    range where the posterior lies; a second grid over that range gives median
    and interval. The history is read three times, as sums, never spread over
    a grid. Null or infinite readings take no part; an estimate without a
    reading has no row.
    """
    if prior is None:
        prior = history.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in (
            "log_life_mean", "log_life_sd", "shape_mean", "shape_sd")))
    read = history.where((F.col("cycle") <= F.col("at_cycle")) & F.col("soh").isNotNull() & ~F.isnan(F.col("soh").cast("double"))
                         & (F.abs("soh") < float("inf")))
    first = read.groupBy(*ESTIMATE).agg(F.min("cycle").alias("_x0"))
    rows = staged(read.join(first, ESTIMATE).select(*ESTIMATE, "cycle", "soh", (F.col("cycle") - F.col("_x0")).cast("double").alias("_dx"),
                                                    (1.0 - F.col("soh")).alias("_f")))
    known = prior.select(F.struct("log_life_mean", "log_life_sd", "shape_mean", "shape_sd")).scalar()
    base = rows.groupBy(*ESTIMATE).agg(
        F.count(F.lit(1)).alias("n_readings"), F.sum(F.col("_f") * F.col("_f")).alias("_ff"),
        (F.max("_dx") > 0).alias("_has"), F.min(F.col("cycle") - F.col("_dx")).alias("_x0")).withColumn("_prior", known)
    middle = F.coalesce("_prior.log_life_mean", F.lit(FLAT_LOG_LIFE))
    half = F.coalesce(GRID_SPAN_SD * F.col("_prior.log_life_sd"), F.lit(FLAT_HALF))
    coarse = F.lit(SHAPES[0]), F.lit(round(SHAPES[1] - SHAPES[0], 10))
    points = staged(base.join(_power_sums(rows, *coarse), ESTIMATE).withColumns({
        "_l0": middle - half, "_l_step": 2.0 * half / (LIFE_POINTS - 1), "_p0": coarse[0], "_p_step": coarse[1]}))
    best = _per_estimate(points.where("_has"), threshold, "log_life double, shape double", lambda row, grid: grid.likeliest()).select(
        *ESTIMATE, F.struct("log_life", "shape").alias("_best"))
    noise = _curve_noise(rows, best, threshold)
    points = staged(points.join(noise, ESTIMATE, "left").withColumn("sigma", F.coalesce("_noise", F.lit(SIGMA_DEFAULT))).drop("_noise"))
    spans = _per_estimate(points, threshold, "_l_lo double, _l_hi double, _p_lo double, _p_hi double", _spans)
    low = F.greatest(F.col("_p_lo") - F.col("_p_step"), F.lit(0.05))
    finer = points.drop("_xf", "_xx").join(spans, ESTIMATE).withColumns({
        "_p_step": (F.col("_p_hi") + F.col("_p_step") - low) / (len(SHAPES) - 1), "_p0": low,
        "_l_step": (F.col("_l_hi") - F.col("_l_lo") + 2.0 * F.col("_l_step")) / (LIFE_POINTS - 1),
        "_l0": F.col("_l_lo") - F.col("_l_step")})
    finer = staged(finer)
    sums = _power_sums(rows.join(finer.select(*ESTIMATE, "_p0", "_p_step"), ESTIMATE), F.col("_p0"), F.col("_p_step"))
    fine = finer.join(sums, ESTIMATE).withColumn("_elapsed", (F.col("at_cycle") - F.col("_x0")).cast("double"))
    tail = (1.0 - coverage) / 2.0

    def remaining(row: dict, grid: _Grid) -> tuple:
        margin = grid.weights(row["_has"], row["sigma"]).sum(1)
        left = np.maximum(np.exp(grid.log_life) - row["_elapsed"], 0.0)
        return tuple(_at(q, margin, left) for q in (0.5, tail, 1.0 - tail))

    return _per_estimate(fine, threshold, "median double, lower double, upper double", remaining).join(
        finer.select(*ESTIMATE, "n_readings", "sigma"), ESTIMATE)
