"""Conformal intervals around a linear model, pooled or per cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions.numbers import draw, text_number
from voltloom.operators.evaluate import Linear, coefficients, complete, moment_columns, predicted
from voltloom.operators.ordered import with_ordinal

ALPHA = 0.10
CALIBRATION_SHARE = 0.3
MIN_CALIBRATION_ROWS = 20
_HASH_BUCKET = 2_147_483_647 // 1024


def ranked_cells(frame: DataFrame, seed: int = 7) -> DataFrame:
    """(cell_id, cell_rank): a repeatable shuffle of the cells."""
    cells = frame.select("cell_id").distinct().withColumn("_h", draw(seed, text_number(F.col("cell_id"))))
    return with_ordinal(cells.withColumn("_all", F.lit(0)), ["_all"], ["_h", "cell_id"],
                        F.floor(F.col("_h") / _HASH_BUCKET), "cell_rank").drop("_all", "_h")


def holdout_cells(frame: DataFrame, share: float = CALIBRATION_SHARE, seed: int = 7) -> DataFrame:
    """Whole cells, not rows, go to calibration: (cell_id, is_calibration)."""
    ranks = ranked_cells(frame, seed)
    n = ranks.agg(F.count(F.lit(1))).scalar()
    k = F.greatest(F.lit(1), F.bround(n * F.lit(share), 0))
    return ranks.select("cell_id", (F.col("cell_rank") <= k).alias("is_calibration"))


def rank_quantile(scores: DataFrame, keys: list[str], score: str, alpha: float = ALPHA) -> DataFrame:
    """(keys, n_calibration, quantile): the ceil((n+1)(1-alpha))-th smallest score.

    Null where that rank exceeds n: no finite interval is justified. Ranks come
    from counted values, so a cohort of any size is never gathered.
    """
    from voltloom.operators.ordered import _bucketed, value_counts

    keys = list(keys)
    lone = keys or ["_all"]
    laid = _bucketed(value_counts(scores, keys, score), keys)
    rank = F.ceil((F.col("_total") + 1) * F.lit(1.0 - alpha))
    return laid.groupBy(*lone).agg(
        F.first("_total").alias("n_calibration"),
        F.min(F.when(F.col("_below") + F.col("n") >= rank, F.col("v"))).alias("quantile")
    ).select(*keys, "n_calibration", "quantile")


def fitted(frame: DataFrame, model: Linear, target: str) -> Column:
    """Coefficients of the model on a frame, as a scalar."""
    y = F.col(target).cast("double")
    sums = complete(frame, model, target).agg(*moment_columns(model, y))
    return sums.select(coefficients(model)).scalar()


def intervals(rows: DataFrame, refusal: Column) -> DataFrame:
    """lower/upper where nothing refuses them."""
    out = rows.withColumn("refusal", F.coalesce(refusal, F.lit("")))
    ok = F.col("refusal") == ""
    q = F.col("quantile")
    return out.withColumns({
        "prediction": F.when(ok, F.col("_pred")), "lower": F.when(ok, F.col("_pred") - q),
        "upper": F.when(ok, F.col("_pred") + q)}).drop("_pred")


def split_conformal(train: DataFrame, test: DataFrame, model: Linear, target: str,
                    alpha: float = ALPHA, cohort: str | None = None, max_width: float | None = None,
                    seed: int = 7) -> DataFrame:
    """Intervals for the test rows, or the reason a row gets none.

    With ``cohort`` there is one quantile per cohort, and a cohort not seen in
    calibration is refused rather than given the pooled one.
    """
    marked = complete(train, model, target).join(holdout_cells(train, seed=seed), "cell_id")
    proper, calib = marked.where("NOT is_calibration"), marked.where("is_calibration")
    coef = fitted(proper, model, target)
    scores = calib.withColumn("_coef", coef).withColumn(
        "_score", F.abs(F.col(target) - predicted(model)))
    rows = test.withColumn("_coef", coef).withColumn("_pred", predicted(model)).drop("_coef")
    q = rank_quantile(scores, [cohort] if cohort else [], "_score", alpha)
    if cohort:
        rows = rows.join(q, cohort, "left")
        wide = F.lit(False) if max_width is None else 2 * F.col("quantile") > max_width
        refusal = (F.when(F.col("n_calibration").isNull(), "no calibration data for this cohort")
                   .when(F.col("quantile").isNull(), "no finite interval for this cohort")
                   .when(wide, "interval too wide to be actionable"))
    else:
        one = q.select(F.struct("n_calibration", "quantile")).scalar()
        rows = rows.withColumn("_q", one).withColumns({
            "n_calibration": F.coalesce(F.col("_q.n_calibration"), F.lit(0)),
            "quantile": F.col("_q.quantile")}).drop("_q")
        wide = F.lit(False) if max_width is None else 2 * F.col("quantile") > max_width
        refusal = (F.when(F.col("n_calibration") < MIN_CALIBRATION_ROWS, "insufficient calibration data")
                   .when(F.col("quantile").isNull(), "no finite interval is justified")
                   .when(wide, "interval too wide to be actionable"))
    return intervals(rows, refusal)


def empirical_coverage(quoted: DataFrame, target: str, keys: list[str] | None = None) -> DataFrame:
    """Coverage and mean width over quoted rows; refusals are counted apart."""
    keys = keys or []
    inside = F.coalesce(F.col(target).between(F.col("lower"), F.col("upper")), F.lit(False))
    has = F.col("lower").isNotNull()
    return quoted.groupBy(*keys).agg(
        F.avg(F.when(has, inside.cast("double"))).alias("coverage"),
        F.avg(F.when(has, F.col("upper") - F.col("lower"))).alias("mean_width"),
        F.count_if(has).alias("n_quoted"), F.count_if(~has).alias("n_refused"),
        F.avg((~has).cast("double")).alias("refusal_rate"))


def cohort_coverage(frame: DataFrame, model: Linear, target: str, alpha: float = ALPHA,
                    cohort: str = "cohort", seed: int = 7) -> DataFrame:
    """Leave-one-cohort-out coverage of the pooled interval, all folds in one job.

    For each held-out cohort the other cohorts' cells are split, fitted and
    calibrated. A cell takes part once per cohort other than its own; the fold
    number is a column.
    """
    rows = complete(frame, model, target)
    y = F.col(target).cast("double")
    cohorts = rows.select(F.col(cohort).alias("fold")).distinct()
    every = cohorts.agg(F.array_sort(F.collect_set("fold"))).scalar()
    ranks = ranked_cells(rows, seed)
    per_cell = (rows.groupBy("cell_id", cohort).agg(F.count(F.lit(1)).alias("_n"), *moment_columns(model, y))
                .join(ranks, "cell_id"))
    spread = per_cell.withColumn("fold", F.explode(F.array_remove(every, F.col(cohort))))
    within = with_ordinal(spread.select("fold", "cell_id", "cell_rank"), ["fold"], ["cell_rank"],
                          F.floor(F.col("cell_rank") / 4096), "_r")
    sizes = within.groupBy("fold").agg(F.greatest(F.lit(1), F.bround(
        F.count(F.lit(1)) * F.lit(CALIBRATION_SHARE), 0)).alias("_k"))
    marked = within.join(sizes, "fold").select("fold", "cell_id", (F.col("_r") <= F.col("_k")).alias("_cal"))
    tagged = spread.join(marked, ["fold", "cell_id"])
    names = [c for c in per_cell.columns if c.startswith("_x")]
    fits = tagged.where("NOT _cal").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).select(
        "fold", coefficients(model).alias("_coef"))
    calib = rows.join(marked.where("_cal"), "cell_id").join(fits, "fold")
    scores = calib.withColumn("_score", F.abs(y - predicted(model)))
    q = rank_quantile(scores, ["fold"], "_score", alpha)
    tests = (rows.withColumn("fold", F.col(cohort)).join(fits, "fold").join(q, "fold", "left")
             .withColumn("_pred", predicted(model)))
    refusal = (F.when(F.coalesce("n_calibration", F.lit(0)) < MIN_CALIBRATION_ROWS,
                      "insufficient calibration data")
               .when(F.col("quantile").isNull(), "no finite interval is justified"))
    out = empirical_coverage(intervals(tests, refusal), target, ["fold"])
    return out.withColumnRenamed("fold", "held_out").withColumn("nominal", F.lit(1.0 - alpha))


def coverage_summary(report: DataFrame) -> DataFrame:
    """One row: median and worst coverage, and how many groups fall short."""
    from voltloom.operators.ordered import exact_quantiles

    c = F.col("coverage")
    one = report.agg(
        F.count(c).alias("n_groups"), F.min(c).alias("worst_coverage"),
        F.min_by("held_out", F.struct(c, F.col("held_out"))).alias("worst_group"),
        F.avg((c < F.col("nominal")).cast("double")).alias("share_below_nominal"),
        F.avg("mean_width").alias("mean_width"))
    median = exact_quantiles(report, [], "coverage", {"median_coverage": 0.5}).scalar()
    return one.withColumn("median_coverage", median)
