"""Loss over a horizon on trailing temperature with one level per cohort, each battery held out in turn.

A fold is fitted from sums: all batteries minus the held-out one. Sums are
kept about the cohort means, so nothing is lost where values are large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.operators.life import trailing_features
from voltloom.operators.ordered import exact_quantiles, spearman
from voltloom.session import staged

HORIZONS = (1, 10, 20, 50)
MIN_TEST_ROWS = 5


def horizon_rows(frame: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(horizon, cell, cohort, cycle, x, y): trailing temperature and capacity lost in so many cycles.

    A cycle without its later one has no row at that horizon.
    """
    h = F.explode(F.array(*[F.lit(n) for n in horizons])).alias("horizon")
    later = frame.select("cell_id", "cycle", F.col("capacity_ah").alias("_later"), h).withColumn(
        "cycle", F.col("cycle") - F.col("horizon"))
    now = trailing_features(frame, ("avg_temp",)).select(
        "cell_id", "cohort", "cycle", "capacity_ah", F.col("trailing_avg_temp").alias("x"))
    return now.join(later, ["cell_id", "cycle"]).select(
        "horizon", "cell_id", "cohort", "cycle", "x", (F.col("capacity_ah") - F.col("_later")).alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL AND cohort IS NOT NULL")


def _within(n: str, s: str, t: str, st: str) -> F.Column:
    """Sum of products about the mean, from count, sums and the sum of products; 0 without rows."""
    return F.when(F.col(n) > 0, F.col(st) - F.col(s) * F.col(t) / F.col(n)).otherwise(F.lit(0.0))


def fits(rows: DataFrame) -> DataFrame:
    """(horizon, cohort, cell, n, slope, level_x, level_y, all_slope): each battery's model, fitted without it."""
    n = F.count(F.lit(1))
    cells = staged(rows.groupBy("horizon", "cohort", "cell_id").agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * n).alias("cxx"),
        (F.covar_pop("x", "y") * n).alias("cxy")))
    w = F.sum("n")
    means = cells.groupBy("horizon", "cohort").agg(
        (F.sum(F.col("mx") * F.col("n")) / w).alias("gx"), (F.sum(F.col("my") * F.col("n")) / w).alias("gy"))
    about = cells.join(means, ["horizon", "cohort"]).withColumns({
        "sx": F.col("n") * (F.col("mx") - F.col("gx")), "sy": F.col("n") * (F.col("my") - F.col("gy"))}).withColumns({
            "sxx": F.col("cxx") + F.col("sx") * F.col("sx") / F.col("n"),
            "sxy": F.col("cxy") + F.col("sx") * F.col("sy") / F.col("n")})
    cohorts = staged(about.groupBy("horizon", "cohort").agg(*[F.sum(c).alias(f"k_{c}") for c in ("n", "sxx", "sxy")]))
    whole = cohorts.groupBy("horizon").agg(F.sum("k_sxx").alias("t_sxx"), F.sum("k_sxy").alias("t_sxy"))
    left = about.join(cohorts, ["horizon", "cohort"]).join(whole, "horizon").withColumns({
        "l_n": F.col("k_n") - F.col("n"), "l_x": -F.col("sx"), "l_y": -F.col("sy"),
        "l_xx": F.col("k_sxx") - F.col("sxx"), "l_xy": F.col("k_sxy") - F.col("sxy")}).withColumns({
            "xx": F.col("t_sxx") - F.col("k_sxx") + _within("l_n", "l_x", "l_x", "l_xx"),
            "xy": F.col("t_sxy") - F.col("k_sxy") + _within("l_n", "l_x", "l_y", "l_xy")})
    return left.select(
        "horizon", "cohort", "cell_id", "n", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).alias("slope"),
        (F.col("gx") + F.try_divide("l_x", "l_n")).alias("level_x"), (F.col("gy") + F.try_divide("l_y", "l_n")).alias("level_y"),
        F.when(F.col("t_sxx") > 0, F.col("t_sxy") / F.col("t_sxx")).alias("all_slope"))


def horizon_folds(rows: DataFrame) -> DataFrame:
    """One row per (horizon, battery); a fold that cannot be scored keeps its reason.

    R² is against the battery's own mean.
    """
    rows = staged(rows)
    each = staged(fits(rows).withColumn("refusal", F.when(
        F.col("n") < MIN_TEST_ROWS, "too few rows").when(
        F.col("level_y").isNull(), "no other battery of the cohort").when(
        F.col("slope").isNull(), "temperature does not vary").otherwise("")))
    keys = ["horizon", "cohort", "cell_id"]
    scored = rows.join(each.where("refusal = ''"), keys).withColumn(
        "pred", F.col("level_y") + F.col("slope") * (F.col("x") - F.col("level_x")))
    err = F.col("y") - F.col("pred")
    stats = scored.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("_res"),
                                      (F.var_pop("y") * F.count(F.lit(1))).alias("_own"))
    # The last bit of a sum must not rank equal values.
    near = scored.select(*keys, F.round("pred", 10).alias("_p"), F.round("y", 10).alias("_y"))
    rho = spearman(near, keys, "_p", "_y").select(*keys, F.col("rho").alias("spearman_rho"))
    return each.join(stats, keys, "left").join(rho, keys, "left").select(
        *keys, F.col("n").alias("n_test"), "slope", "all_slope", "mae",
        F.when(F.col("_own") > 0, 1.0 - F.col("_res") / F.col("_own")).alias("r2_vs_own_mean"), "spearman_rho", "refusal")


def horizon_summary(folds: DataFrame) -> DataFrame:
    """Per horizon: what could be tested, and the middle of its scores."""
    sizes = folds.groupBy("horizon").agg(
        F.sum("n_test").alias("n_rows"), F.count(F.lit(1)).alias("n_batteries"), F.count_distinct("cohort").alias("n_cohorts"),
        F.max("all_slope").alias("temp_coefficient"), F.count_if(F.col("refusal") == "").alias("n_testable"),
        F.avg((F.col("r2_vs_own_mean") > 0).cast("double")).alias("share_above_own_mean"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "r2_vs_own_mean", "spearman_rho")])
    mid = exact_quantiles(folds.select("horizon", F.inline(cells)), ["horizon", "metric"], "value", {"mid": 0.5})
    return sizes.join(mid.groupBy("horizon").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("mid"))).alias(f"median_{m}")
        for m in ("mae", "r2_vs_own_mean", "spearman_rho")]), "horizon", "left")
