"""How skill on unseen cells and cohorts depends on the number of cohorts seen.

Every subset of cohorts is a row set of one table, every fold a row of
another: the data are read once, into sums per cell, and each model of each
fold of each subset comes from sums of sums (all of the subset minus its own).
No fold is fitted from rows, and squared errors follow from the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numbers import draw, text_number
from voltloom.operators.evaluate import MIN_TEST_ROWS, Linear, coefficients, complete, moment_columns, moment_names
from voltloom.operators.ordered import exact_quantiles
from voltloom.session import staged

LEAST_COHORTS = 3
LEAST_CELLS = 2
REPEATS = 5
SEED = 17
#: Subsets of all sizes hold about repeats * cohorts^2 / 2 rows; more cohorts than this are refused, none is left out.
MAX_COHORTS = 500
POINT = ["n_cohorts", "repeat"]


def cohort_subsets(cohorts: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(n_cohorts, repeat, cohort): for each size from three up, ``repeats`` seeded draws; all cohorts once."""
    known = cohorts.select("cohort").where("cohort IS NOT NULL").distinct()
    total = staged(known).agg(F.count(F.lit(1)).alias("n")).scalar()
    fits = F.when(total > MAX_COHORTS, F.raise_error(F.lit(f"more than {MAX_COHORTS} cohorts")).cast("bigint")).otherwise(total)
    sizes = known.withColumn("_all", fits).where(F.col("_all") >= LEAST_COHORTS).select(
        "cohort", "_all", F.explode(F.sequence(F.lit(LEAST_COHORTS).cast("bigint"), F.col("_all"))).alias("n_cohorts"))
    drawn = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).where(
        "n_cohorts < _all OR repeat = 0")
    turn = draw(seed, F.col("n_cohorts"), F.col("repeat"), text_number(F.col("cohort")))
    rank = F.row_number().over(Window.partitionBy(*POINT).orderBy(turn, "cohort"))
    return drawn.withColumn("_rank", rank).where("_rank <= n_cohorts").select(*POINT, "cohort")


def squared_error(model: Linear, coef: Column, pick=F.col) -> Column:
    """Sum of squared residuals of a group, from its sums."""
    k = len(model.features) + 1
    b = [F.get(coef, F.lit(i)) for i in range(k)]
    out = pick("_yy")
    for i in range(k):
        out = out - 2.0 * b[i] * pick(f"_xy{i}")
        for j in range(k):
            out = out + b[i] * b[j] * pick(f"_xx{min(i, j)}_{max(i, j)}")
    return out


def _skill(cells: DataFrame, model: Linear, group: str, name: str) -> DataFrame:
    """Median r2 over the folds of each subset, against the training mean; folds under ten rows are not complete."""
    names = ["_yy", *moment_names(model)]
    sums = [F.sum(c).alias(c) for c in names]
    whole = cells.groupBy(*POINT).agg(*[F.sum(c).alias(f"_w{c}") for c in names])
    folds = cells.groupBy(*POINT, group).agg(*sums).where(F.col("_xx0_0") >= MIN_TEST_ROWS).join(whole, POINT)
    rest = folds.withColumns({f"_tr{c}": F.col(f"_w{c}") - F.col(c) for c in names})
    fitted = rest.withColumn("_coef", coefficients(model, lambda c: F.col(f"_tr{c}"))).withColumn(
        "_mean", F.try_divide(F.col("_tr_xy0"), F.col("_tr_xx0_0")))
    m = F.col("_mean")
    base = F.col("_yy") - 2.0 * m * F.col("_xy0") + m * m * F.col("_xx0_0")
    r2 = F.when(F.col("_coef").isNotNull() & (base > 0), 1.0 - squared_error(model, F.col("_coef")) / base)
    scored = staged(fitted.select(*POINT, r2.alias("_r2")))
    counts = scored.groupBy(*POINT).agg(F.count("_r2").alias(f"{name}_folds"))
    return exact_quantiles(scored, POINT, "_r2", {f"{name}_r2": 0.5}).join(counts, POINT)


def coverage_sweep(frame: DataFrame, models: Sequence[Linear], target: str, repeats: int = REPEATS, seed: int = SEED,
                   least_cells: int = LEAST_CELLS) -> DataFrame:
    """(n_cohorts, repeat, model, n_cells, n_rows, lobo_r2, loco_r2, gap) per subset and model.

    ``lobo`` leaves a cell out, ``loco`` a cohort; the gap is what a new cohort
    costs. Cohorts under ``least_cells`` cells are not part of the sweep (a
    cohort of one cell has no gap); under three such cohorts the result is
    empty. A subset whose folds are not complete has null scores.
    """
    sizes = frame.where(F.col(target).isNotNull() & F.col("cohort").isNotNull()).groupBy("cohort", "cell_id").agg(
        F.count(F.lit(1)).alias("_n")).groupBy("cohort").agg(F.count(F.lit(1)).alias("_cells"))
    usable = staged(sizes.where(F.col("_cells") >= least_cells).select("cohort"))
    picked = staged(cohort_subsets(usable, repeats, seed))
    out = None
    for model in models:
        y = F.col(target).cast("double")
        sums = complete(frame, model, target).groupBy("cohort", "cell_id").agg(F.sum(y * y).alias("_yy"), *moment_columns(model, y))
        cells = staged(picked.join(sums, "cohort"))
        size = cells.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("_xx0_0").cast("bigint").alias("n_rows"))
        point = size.join(_skill(cells, model, "cell_id", "lobo"), POINT, "left").join(_skill(cells, model, "cohort", "loco"), POINT, "left")
        point = point.select(*POINT, F.lit(model.name).alias("model"), "n_cells", "n_rows", "lobo_r2", "loco_r2",
                             (F.col("loco_r2") - F.col("lobo_r2")).alias("gap"))
        out = point if out is None else out.unionByName(point)
    return out


def sweep_summary(points: DataFrame) -> DataFrame:
    """Per model and number of cohorts: subsets, mean cells, median scores and gap, and the spread of the gap."""
    return points.groupBy("model", "n_cohorts").agg(
        F.count(F.lit(1)).alias("n_subsets"), F.avg("n_cells").alias("mean_cells"), F.percentile("lobo_r2", 0.5).alias("lobo_r2"),
        F.percentile("loco_r2", 0.5).alias("loco_r2"), F.percentile("gap", 0.5).alias("gap"),
        (F.max("gap") - F.min("gap")).alias("gap_spread"))
